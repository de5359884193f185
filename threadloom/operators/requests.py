"""Cutting ordered chunks into requests of bounded number and size, in parallel.

A cut depends on the one before it, but only through the place where a request starts. Chunks of a group are numbered and cut into blocks of
consecutive ones. As a request holds at most `most` chunks, the first start in a block lies among its first `most` places, so a
block is a small function: for each of those entries, the entry of the next block and the requests that start in it. Functions
compose, so a scan by doubling over blocks gives each block its true entry; a second pass numbers the chunks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.clustering import _kept
from threadloom.operators.ordering import dense_index

BLOCK = 16_384


def next_starts(sizes: np.ndarray, most: int, most_bytes: int) -> np.ndarray:
    """For a request that starts at each place, where the next one starts; a chunk beyond most_bytes is a request of its own."""
    upto = np.concatenate([[0], np.cumsum(sizes)])
    by_size = np.searchsorted(upto, upto[:-1] + most_bytes, "right") - 1
    at = np.arange(len(sizes))
    return np.maximum(np.minimum(by_size, at + most), at + 1)


def block_function(sizes: np.ndarray, length: int, most: int, most_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """For each entry, the entry of the next block and the requests that start here; sizes go on past `length` by up to `most`."""
    then = next_starts(sizes, most, most_bytes)
    entries, starts = np.empty(length, np.int64), np.zeros(length, np.int64)
    for i in range(length - 1, -1, -1):
        j = then[i]
        entries[i], starts[i] = (j - length, 1) if j >= length else (entries[j], starts[j] + 1)
    n = min(most, length)
    return entries[:n], starts[:n]


def request_batches(chunks: DataFrame, group: str, most: int, most_bytes: int, block: int = BLOCK) -> DataFrame:
    """chunks with `request`: the number within its group of the request that each goes into.

    In order of thread_id and chunk_index a request takes chunks while it has at most `most` of them and most_bytes in all.
    chunks: group, thread_id, chunk_index, chunk, and other columns that stay. A null chunk has no bytes; chunks of one (thread_id, chunk_index)
    are ordered by their text.
    """
    if most < 1 or block <= most:
        raise ValueError("a block holds more chunks than a request, and a request at least one")
    bytes_ = F.coalesce(F.octet_length("chunk"), F.lit(0)).cast("long")
    numbered = dense_index(chunks.withColumn("_bytes", bytes_), [F.col(group), F.col("thread_id"), F.col("chunk_index"), F.col("chunk")], "_n")
    begin = numbered.groupBy(group).agg(F.min("_n").alias("_begin"))
    rows = numbered.join(begin, numbered[group].eqNullSafe(begin[group])).drop(begin[group]).withColumn("_at", F.col("_n") - F.col("_begin")).drop("_begin")
    rows = _kept(rows.withColumn("_block", F.floor(F.col("_at") / block)).withColumn("_of", F.col("_n") - F.col("_at")))
    # A block also sees the first chunks of the next one, where its last request may end.
    small = rows.select("_of", "_block", (F.col("_at") % block).alias("_i"), "_bytes")
    tail = small.where((F.col("_i") < most) & (F.col("_block") > 0)).select("_of", (F.col("_block") - 1).alias("_block"), (F.col("_i") + block).alias("_i"), "_bytes")
    dealt = small.unionByName(tail)

    def function(key, table):
        import pyarrow as pa

        table = table.sort_by("_i")
        at = table["_i"].to_numpy()
        entries, starts = block_function(table["_bytes"].to_numpy(), int((at < block).sum()), most, most_bytes)
        return pa.table({"_of": pa.array([key[0].as_py()], pa.int64()), "_block": pa.array([key[1].as_py()], pa.int64()), "f": pa.array([entries.tolist()], pa.list_(pa.int64())), "starts": pa.array([starts.tolist()], pa.list_(pa.int64()))})

    functions = _kept(dealt.groupBy("_of", "_block").applyInArrow(function, "_of long, _block long, f array<long>, starts array<long>"))
    entered = _entries(functions)
    count = F.coalesce(F.get("starts", F.col("entry").cast("int")), F.lit(0))  # an entry past a short last block starts nothing
    before = Window.partitionBy("_of").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    entered = entered.select("_of", "_block", "entry", F.coalesce(F.sum(count).over(before), F.lit(0)).alias("base"))

    def number(key, table):
        import pyarrow as pa

        table = table.sort_by("_i")
        at = table["_i"].to_numpy()
        length = int((at < block).sum())
        then = next_starts(table["_bytes"].to_numpy(), most, most_bytes)
        started, i = np.zeros(length, np.int64), table["entry"][0].as_py()
        while i < length:
            started[i] = 1
            i = then[i]
        made = table["base"][0].as_py() - 1 + np.cumsum(started)
        return pa.table({"_m": pa.array(key[0].as_py() + key[1].as_py() * block + np.arange(length), pa.int64()), "request": pa.array(made, pa.int64())})

    numbers = dealt.join(entered, ["_of", "_block"]).groupBy("_of", "_block").applyInArrow(number, "_m long, request long")
    return rows.join(numbers, rows["_n"] == numbers["_m"]).select(*chunks.columns, F.col("request").cast("int").alias("request"))


def _entries(functions: DataFrame) -> DataFrame:
    """_of, _block, entry, starts: each block's function composed with all before it, applied to the group's first chunk.

    Round k composes a block's function with that of 2^k blocks before, which by then covers 2^k blocks: a logarithm of rounds.
    """
    last = functions.agg(F.max("_block").alias("n")).first()["n"] or 0
    whole, step = functions.select("_of", "_block", "f"), 1
    while step <= last:
        earlier = whole.select("_of", (F.col("_block") + step).alias("_block"), F.col("f").alias("g"))
        composed = F.when(F.col("g").isNull(), F.col("f")).otherwise(F.transform("g", lambda x: F.get("f", x.cast("int"))))
        whole, step = _kept(whole.join(earlier, ["_of", "_block"], "left").select("_of", "_block", composed.alias("f"))), step * 2
    through = whole.select("_of", (F.col("_block") + 1).alias("_block"), F.col("f")[0].alias("entry"))
    return functions.join(through, ["_of", "_block"], "left").select("_of", "_block", F.coalesce("entry", F.lit(0).cast("long")).alias("entry"), "starts")
