"""A written index for keyword search: postings of tokens with their places, dealt by token, in segments.

Tables under one folder (Parquet), each with a folder for each segment:
  postings/  segment, bucket, token, thread_id, title, body (places in each column, from 0); sorted by token
  lengths/   segment, thread_id, tokens; one row for each thread that the segment holds
  gone/      segment, thread_id: threads whose older entries no longer count, because they were changed or removed
A change writes one more segment and touches no other. A thread's entries are those of the newest segment that names it. merged()
puts segments together, so that searches meet few of them; a manifest names the segments that count, and is replaced at once.
A search reads the buckets of its own terms only, and of them the row groups whose tokens fit; a prefix reads all buckets.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import search_tokens
from threadloom.operators.search import COLUMNS, Part, _bm25, _columns, _matches, leaves_of, let, near_count

BUCKETS = 256


def bucket_of(token, buckets: int):
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def postings_of(threads: DataFrame) -> DataFrame:
    """token, thread_id, title, body: where each token stands. A row's tokens are grouped where the row is, without a shuffle."""
    tokens = threads.select(F.col("thread_id").cast("long").alias("thread_id"), *[search_tokens(F.col(c)).alias(c) for c in COLUMNS])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                lists = [batch.column(c) for c in COLUMNS]
                flat = pa.concat_arrays([x.flatten() for x in lists]).dictionary_encode()
                code = flat.indices.to_numpy(zero_copy_only=False)
                sizes = [x.value_lengths().to_numpy(zero_copy_only=False) for x in lists]
                row = np.concatenate([np.repeat(np.arange(batch.num_rows), n) for n in sizes])
                place = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
                column = np.repeat(np.arange(len(lists)), [n.sum() for n in sizes])
                order = np.lexsort((place, column, code, row))
                row, code, place, column = row[order], code[order], place[order], column[order]
                if not len(row):
                    continue
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (code[1:] != code[:-1])))
                number = np.cumsum(np.bincount(first, minlength=len(row))[: len(row)]) - 1
                places = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(number[column == c], minlength=len(first)))]), pa.int32()), pa.array(place[column == c], pa.int32())) for c in range(len(lists))]
                yield pa.RecordBatch.from_arrays([flat.dictionary.take(pa.array(code[first])), batch.column("thread_id").take(pa.array(row[first])), *places], ["token", "thread_id", *COLUMNS])

    return tokens.mapInArrow(run, "token string, thread_id long, " + ", ".join(f"{c} array<int>" for c in COLUMNS))


def lengths_of(threads: DataFrame) -> DataFrame:
    return threads.select("thread_id", (F.size(search_tokens(F.col("title"))) + F.size(search_tokens(F.col("body")))).alias("tokens"))


def _write(postings: DataFrame, lengths: DataFrame, gone: DataFrame, path: str, segment: int, buckets: int) -> None:
    """One segment. Postings are dealt by ranges of (bucket, token, thread), so that a token of any frequency spreads over tasks."""
    tasks = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = postings.select("token", "thread_id", *COLUMNS).withColumn("bucket", bucket_of(F.col("token"), buckets))
    rows = rows.repartitionByRange(tasks, "bucket", "token", "thread_id").sortWithinPartitions("bucket", "token", "thread_id")
    rows.write.partitionBy("bucket").parquet(f"{path}/postings/segment={segment}")
    lengths.select("thread_id", "tokens").write.parquet(f"{path}/lengths/segment={segment}")
    gone.select("thread_id").distinct().write.parquet(f"{path}/gone/segment={segment}")


class SearchIndex:
    """An index folder as its newest manifest says."""

    def __init__(self, spark: SparkSession, path: str):
        from threadloom.sources.store import Files, StoreError

        self.spark, self.path, self.files = spark, path, Files(spark, path)
        names = self.files.names(f"{path}/_manifests/*.json")
        if not names:
            raise StoreError(f"no index at {path}")
        self.manifest = json.loads(self.files.read(f"{path}/_manifests/{names[-1]}"))

    @classmethod
    def create(cls, threads: DataFrame, path: str, buckets: int = BUCKETS) -> SearchIndex:
        from threadloom.sources.store import Files

        spark = threads.sparkSession
        none = threads.select("thread_id").limit(0)
        _write(postings_of(threads), lengths_of(threads), none, path, 0, buckets)
        Files(spark, path).publish(f"{path}/_manifests/{0:012d}.json", json.dumps({"number": 0, "buckets": buckets, "segments": [0], "next": 1}))
        return cls(spark, path)

    @property
    def segments(self) -> list[int]:
        return self.manifest["segments"]

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    def _publish(self, segments: list[int], following: int) -> None:
        after = {"number": self.manifest["number"] + 1, "buckets": self.buckets, "segments": segments, "next": following}
        self.files.publish(f"{self.path}/_manifests/{after['number']:012d}.json", json.dumps(after))
        self.manifest = after

    def _table(self, name: str, segments: list[int]) -> DataFrame:
        schema = {"postings": "token string, thread_id long, title array<int>, body array<int>, segment int, bucket int", "lengths": "thread_id long, tokens int, segment int", "gone": "thread_id long, segment int"}[name]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/segment={i}" for i in segments])

    def apply(self, changed: DataFrame, removed: DataFrame | None = None) -> None:
        """Threads that are new or changed (whole rows), and those that are gone (thread_id), as one more segment; one that is both is there."""
        gone = changed.select("thread_id")
        if removed is not None:
            gone = gone.unionByName(removed.select("thread_id"))
        number = self.manifest["next"]
        _write(postings_of(changed), lengths_of(changed), gone, self.path, number, self.buckets)
        self._publish([*self.segments, number], number + 1)

    def live(self, segments: list[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """Postings and lengths of some segments, all by default, without entries that a later one of them overrides."""
        of = self.segments if segments is None else segments
        postings, lengths = self._table("postings", of), self._table("lengths", of)
        if len(of) == 1:
            return postings, lengths
        later = self._table("gone", of[1:]).groupBy("thread_id").agg(F.max("segment").alias("_from"))
        own = lambda rows: rows.join(later, "thread_id", "left").where(F.col("_from").isNull() | (F.col("segment") >= F.col("_from"))).drop("_from")
        return own(postings), own(lengths)

    def find(self, tree) -> DataFrame:
        """thread_id, bm25 of the threads that match."""
        return find(*self.live(), tree, self.buckets)

    def merge(self, whole: bool = False) -> None:
        """The segments after the first as one, or all of them: what no longer counts is dropped, older readers keep their files."""
        of = self.segments if whole else self.segments[1:]
        if len(of) < 2:
            return
        postings, lengths = self.live(of)
        gone = self._table("gone", of) if not whole else self._table("gone", of).limit(0)
        number = self.manifest["next"]
        _write(postings, lengths, gone, self.path, number, self.buckets)
        self._publish([number] if whole else [self.segments[0], number], number + 1)

    def vacuum(self) -> list[int]:
        """Removes the segments that the newest manifest doesn't name, and older manifests; their numbers."""
        names = self.files.names(f"{self.path}/lengths/segment=*")
        old = sorted(set(int(n.split("=")[1]) for n in names) - set(self.segments))
        for i in old:
            for table in ("postings", "lengths", "gone"):
                self.files.remove(f"{self.path}/{table}/segment={i}")
        for n in self.files.names(f"{self.path}/_manifests/*.json")[:-1]:
            self.files.remove(f"{self.path}/_manifests/{n}")
        return old


def find(postings: DataFrame, lengths: DataFrame, tree, buckets: int = BUCKETS) -> DataFrame:
    """thread_id, bm25 of the threads that match; only postings of the query's own terms are read and shuffled."""
    spark = postings.sparkSession
    if tree is None:
        return spark.createDataFrame([], "thread_id bigint, bm25 double")
    leaves = list(dict.fromkeys(leaves_of(tree)))
    phrases = [x.near.phrases[x.number] if isinstance(x, Part) else x for x in leaves]
    slots = list(dict.fromkeys((t, p.prefix and k == len(p.tokens) - 1) for p in phrases for k, t in enumerate(p.tokens)))
    is_slot = lambda s: F.col("token").startswith(s[0]) if s[1] else F.col("token") == s[0]
    wanted = postings
    if "bucket" in postings.columns and not any(prefix for _, prefix in slots):
        own = spark.range(1).select(F.array(*[bucket_of(F.lit(t), buckets) for t, _ in slots]).alias("b")).first()["b"]  # of the terms alone
        wanted = wanted.where(F.col("bucket").isin(*sorted(set(own))))
    wanted = wanted.where(reduce(lambda a, b: a | b, map(is_slot, slots)))
    merged = lambda s, c: F.flatten(F.collect_list(F.when(is_slot(s), F.col(c))))
    per = wanted.groupBy("thread_id").agg(*[merged(s, c).alias(f"_{c}{i}") for i, s in enumerate(slots) for c in COLUMNS])

    def places(p, c):
        """Where the phrase begins in column c: places of its first token that the others follow."""
        at = [F.col(f"_{c}{slots.index((t, p.prefix and k == len(p.tokens) - 1))}").alias(f"t{k}") for k, t in enumerate(p.tokens)]

        def whole(s, i):
            out = (i == 0) if p.first else F.lit(True)
            for k in range(1, len(at)):
                out = out & F.array_contains(s[f"t{k}"], i + k)
            return out

        return let(F.struct(*at), lambda s: F.filter(s["t0"], lambda i: whole(s, i)))

    counts = []
    for i, leaf in enumerate(leaves):
        if isinstance(leaf, Part):
            parts = [near_count([places(p, c) for p in leaf.near.phrases], leaf.near, leaf.number) for c in _columns(leaf)]
        else:
            parts = [F.size(places(leaf, c)) for c in _columns(leaf)]
        counts.append(sum(parts[1:], parts[0]).alias(f"_f{i}") if parts else F.lit(0).alias(f"_f{i}"))
    rows = per.select("thread_id", *counts)
    df = rows.agg(*[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(leaves))])
    size = lengths.agg(F.count("*").alias("_n"), F.avg("tokens").alias("_avg"))
    hit = rows.where(_matches(tree, {x: F.col(f"_f{i}") for i, x in enumerate(leaves)})).join(lengths, "thread_id")
    both = hit.select("*", df.select(F.struct("*")).scalar().alias("_a"), size.select(F.struct("*")).scalar().alias("_b"))
    both = both.withColumn("_s", F.struct("_a.*", "_b.*"))
    return both.select("thread_id", _bm25(leaves, F.col("tokens"), "_s").alias("bm25"))
