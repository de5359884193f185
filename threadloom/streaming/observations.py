"""Observations as a stream: late and repeated evidence of any age, without a watermark that would drop it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from threadloom.operators.observations import canonical
from threadloom.sources.store import Migration, Store, StoreError, Table, merging


def fold_into(spark: SparkSession, path: str, schema: str, keys: list[str], payload: list[str], buckets: int = 64):
    """A foreachBatch function that keeps the canonical rows of each key in a store under path.

    A batch rewrites the buckets that its keys fall into, and no others; one that is run again changes nothing.
    """
    steps = [Migration("observations", {"canonical": Table(schema, tuple(keys), buckets)})]
    try:
        store = Store(spark, path, steps)
    except StoreError:
        store = Store.create(spark, path, steps)
    return merging(store, "canonical", "observations", lambda old, new: canonical(old.unionByName(new.select(*old.columns)), keys, payload))


def start(stream: DataFrame, path: str, checkpoint: str, keys: list[str], payload: list[str]):
    """Run what is there to its end; the source's offsets and the commits live in the checkpoint."""
    kinds = dict(stream.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (*keys, *payload, "source_clock", "sequence"))
    fold = fold_into(stream.sparkSession, path, schema, keys, payload)
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64) -> DataFrame:
    """The newest version of the table."""
    return Store(spark, path, [Migration("observations", {"canonical": Table(schema, tuple(keys), buckets)})]).read("canonical")


def canonical_stateful(stream: DataFrame, keys: list[str], payload: str) -> DataFrame:
    """The same rule with keyed state: emits a row whenever a key's winner changes. State is kept for good."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    names = ", ".join(f"{k} {dict(stream.dtypes)[k]}" for k in keys)
    out = f"{names}, {payload} {dict(stream.dtypes)[payload]}, source_clock timestamp, sequence bigint"

    def apply(key, frames, state):
        import pandas as pd

        best = state.get if state.exists else None
        changed = False
        for f in frames:
            for clock, sequence, value in zip(f["source_clock"], f["sequence"], f[payload]):
                us = None if pd.isna(clock) else int(pd.Timestamp(clock).value // 1000)
                mine = (us is not None, us or 0, int(sequence))
                if best is None or mine > (best[0] is not None, best[0] or 0, best[1]):
                    best, changed = (us, int(sequence), value), True
        if changed:
            state.update(best)
            yield pd.DataFrame({**{k: [v] for k, v in zip(keys, key)}, payload: [best[2]], "source_clock": [pd.NaT if best[0] is None else pd.Timestamp(best[0] * 1000)], "sequence": [best[1]]})

    return stream.groupBy(*keys).applyInPandasWithState(apply, out, f"us bigint, sequence bigint, value {dict(stream.dtypes)[payload]}", "update", GroupStateTimeout.NoTimeout)
