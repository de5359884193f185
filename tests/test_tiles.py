"""Neighbours over blocks around pivots, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.operators import clustering, tiles


def clumps(seed, clumps, each, width, dims=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clumps, dims))
    return np.concatenate([c / np.linalg.norm(c) + width * rng.normal(size=(each, dims)) for c in centres])


def frames(spark, matrix, name="o/r", first=0):
    ids = range(first, first + len(matrix))
    threads = spark.createDataFrame([(i, name, "issue" if i % 5 else "pull_request", f"word{i % 4} other{i % 3}") for i in ids], "thread_id bigint, full_name string, kind string, title string")
    chunks = spark.createDataFrame([(i, k, [float(x) for x in v[::1 if k == 0 else -1]]) for i, v in zip(ids, matrix) for k in range(1 + (i % 7 == 0))], "thread_id bigint, chunk_index int, vector array<double>")
    return threads, chunks


def brute(threads, chunks, threshold, cross, fanout):
    of = {r["thread_id"]: r for r in threads.collect()}
    vectors = {}
    for r in chunks.collect():
        v = np.array(r["vector"])
        if np.linalg.norm(v) > 0:
            vectors.setdefault(r["thread_id"], []).append(v / np.linalg.norm(v))
    words = {i: set(r["title"].split()) for i, r in of.items()}
    out = {}
    for a in of:
        found = []
        for b in of:
            if a != b and of[a]["full_name"] == of[b]["full_name"]:
                s = max((float(min(x @ y, 1.0)) for x in vectors.get(a, []) for y in vectors.get(b, []) if len(x) == len(y)), default=-9)
                support = len(words[a] & words[b]) / 2 >= clustering.MIN_TITLE_OVERLAP
                if s >= threshold and (s >= clustering.STRONG_SIMILARITY or support) and (of[a]["kind"] == of[b]["kind"] or s >= cross):
                    found.append((-s, b))
        for s, b in sorted(found)[:fanout]:
            out[a, b] = -s
    return out


@pytest.mark.parametrize("width", [0.03, 0.4])
def test_neighbours_over_many_blocks(spark, width):
    threads, chunks = frames(spark, clumps(1, 6, 25, width))
    small = frames(spark, clumps(2, 2, 5, width), "o/small", 1000)
    odd = spark.createDataFrame([(2000, "o/r", "issue", "word1 other1"), (2001, "o/r", "issue", "word1 other1"), (2002, "o/r", "issue", "word1 other1")], threads.schema)
    more = spark.createDataFrame([(2000, 0, [0.0] * 8), (2001, 0, [1.0, 2.0]), (2002, 0, [1.0, 2.1]), (2002, 1, [1.0] * 8)], chunks.schema)
    threads, chunks = threads.unionByName(small[0]).unionByName(odd), chunks.unionByName(small[1]).unionByName(more)
    got = {(r["a"], r["b"]): r["score"] for r in clustering.neighbours(threads, chunks, 0.8, 0.9, 5, block=16).collect()}
    want = brute(threads, chunks, 0.8, 0.9, 5)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and (2001, 2002) in want


def test_clumps_far_apart_are_not_compared(spark):
    threads, chunks = frames(spark, clumps(3, 6, 40, 0.02))
    chunks = chunks.where("chunk_index = 0")
    rows = threads.join(chunks.groupBy("thread_id").agg(F.collect_list("vector").alias("vectors")), "thread_id")
    dealt, every = tiles.tiled(rows, 0.9, 30)
    share = every.agg(F.avg((~F.col("kept")).cast("double"))).first()[0]
    assert share > 0.5
    # Every row meets its own block once, and each kept pair of blocks holds all rows of both.
    own = dealt.where("i = j")
    assert own.count() == 240 and own.select("thread_id").distinct().count() == 240
    blocks = {r["block"]: r["n"] for r in own.groupBy("block").agg(F.count("*").alias("n")).collect()}
    for r in dealt.where("i <> j").groupBy("i", "j").agg(F.count("*").alias("n")).collect():
        assert r["n"] == blocks[r["i"]] + blocks[r["j"]]
