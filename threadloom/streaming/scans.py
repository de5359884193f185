"""Thread scans as a running query: progress, revisited pages and the watermark of each repository, with keyed state.

Events are those of families.scan_states, (repo_id, sequence, arrival, action, threads, cursor, status, at_us), and may come in any
order and more than once: each counts once, by its arrival. State holds the events of each scan and what they amount to; a batch folds only the
scans that it adds to, so every order of micro-batches ends as the batch fold does, even where a late event undoes an
end. Nothing is evicted by event time, as an event of any age may come; state is the scan log itself, kept on disk by RocksDB.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "repo_id bigint, sequence bigint, pages bigint, threads bigint, cursor string, status string, revisited bigint, watermark_us bigint, watermark_sequence bigint"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def folded(events: list[dict]) -> dict | None:
    """One scan's state after its events in order of arrival: None before it began.

    A begin sets the cursor to the first page, a page moves it and counts, a finish ends the scan unless it claims to be complete with a
    cursor left. Pages after the end don't count. A page whose next address was read before in the scan is revisited.
    """
    scan, read = None, set()
    for e in sorted(events, key=lambda e: e["arrival"]):
        if e["action"] == "begin":
            if scan is None:
                scan = {"pages": 0, "threads": 0, "cursor": e["cursor"], "status": "in_progress", "revisited": 0, "at_us": e["at_us"]}
            else:
                scan["cursor"] = e["cursor"]
            continue
        if scan is None or scan["status"] != "in_progress":
            continue
        if e["action"] == "page":
            read.add(scan["cursor"])
            scan["pages"] += 1
            scan["threads"] += e["threads"] or 0
            scan["cursor"] = e["cursor"]
            scan["revisited"] += e["cursor"] is not None and e["cursor"] in read
        elif not (e["status"] == "complete" and scan["cursor"] is not None):
            scan["status"] = e["status"]
    return scan


class ScanProcessor(StatefulProcessor):
    """State of a repository: its scans (map from sequence to the events and their fold) and the row last given (value)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.scans = handle.getMapState("scans", "sequence bigint", "events string, result string")
        self.given = handle.getValueState("given", "row string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802
        added: dict[int, dict[int, dict]] = {}
        for r in rows:
            added.setdefault(r["sequence"], {})[r["arrival"]] = {c: r[c] for c in ("arrival", "action", "threads", "cursor", "status", "at_us")}
        for sequence, events in added.items():
            held = self.scans.getValue((sequence,)) if self.scans.containsKey((sequence,)) else None
            known = {e["arrival"]: e for e in json.loads(held[0])} if held else {}
            if all(at in known for at in events):
                continue
            every = list((events | known).values())
            self.scans.updateValue((sequence,), (json.dumps(every), json.dumps(folded(every))))
        found = {s: r for (s,), (_, raw) in self.scans.iterator() if (r := json.loads(raw)) is not None}
        if not found:
            return
        newest, done = max(found), max((s for s, r in found.items() if r["status"] == "complete"), default=None)
        now = {c: found[newest][c] for c in ("pages", "threads", "cursor", "status", "revisited")}
        row = {"repo_id": key[0], "sequence": newest, **now, "watermark_us": None if done is None else found[done]["at_us"], "watermark_sequence": done}
        text = json.dumps(row)
        if not self.given.exists() or self.given.get()[0] != text:
            self.given.update((text,))
            yield Row(**row)

    def close(self) -> None:
        pass


def running(events: DataFrame) -> DataFrame:
    """The state of a repository whenever it changes; the session's state store must be RocksDB's (STATE_STORE)."""
    return events.groupBy("repo_id").transformWithState(ScanProcessor(), OUT, "update", "none")


def start(events: DataFrame, path: str, checkpoint: str):
    """Runs what is there to its end, adding what changes to a table under path, marked with its batch."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)

    def add(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return running(events).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(spark, path: str) -> DataFrame:
    """The newest state of each repository."""
    rows = spark.read.option("basePath", path).parquet(path)
    names = [c for c in rows.columns if c not in ("repo_id", "batch")]
    return rows.groupBy("repo_id").agg(F.max_by(F.struct(*names), "batch").alias("s")).select("repo_id", "s.*")


def batch_states(log: DataFrame) -> DataFrame:
    """The same as one batch over the whole log, by joins and windows."""
    from pyspark.sql import Window

    from threadloom.operators.families import scan_states

    per = scan_states(log)
    own = Window.partitionBy("repo_id", "sequence").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("repo_id", "sequence").orderBy("arrival").rowsBetween(Window.unboundedPreceding, 0)
    rows = log.dropDuplicates(["repo_id", "sequence", "arrival"])
    rows = rows.withColumn("began", F.coalesce(F.max((F.col("action") == "begin").cast("int")).over(own), F.lit(0)) == 1)
    rows = rows.withColumn("left", F.last(F.when((F.col("action") != "finish") & (F.col("began") | (F.col("action") == "begin")), F.struct("cursor")), ignorenulls=True).over(own)["cursor"])
    rows = rows.withColumn("ends", (F.col("action") == "finish") & F.col("began") & ~((F.col("status") == "complete") & F.col("left").isNotNull()))
    rows = rows.withColumn("ended", F.coalesce(F.max(F.col("ends").cast("int")).over(own), F.lit(0)) == 1)
    page = (F.col("action") == "page") & F.col("began") & ~F.col("ended")
    rows = rows.withColumn("read", F.collect_set(F.when(page, F.col("left"))).over(upto))
    back = rows.where(page & F.array_contains("read", F.col("cursor"))).groupBy("repo_id", "sequence").agg(F.count("*").alias("revisited"))
    done = rows.where("ends AND NOT ended AND status = 'complete'").select("repo_id", "sequence")
    begun = rows.where("action = 'begin'").groupBy("repo_id", "sequence").agg(F.min_by("at_us", "arrival").alias("at_us"))
    marks = done.join(begun, ["repo_id", "sequence"]).groupBy("repo_id").agg(F.max_by("at_us", "sequence").alias("watermark_us"), F.max("sequence").alias("watermark_sequence"))
    out = per.join(back, ["repo_id", "sequence"], "left").join(marks, "repo_id", "left")
    return out.select("repo_id", "sequence", "pages", "threads", "cursor", "status", F.coalesce("revisited", F.lit(0).cast("long")).alias("revisited"), "watermark_us", "watermark_sequence")
