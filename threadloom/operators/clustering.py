"""Clusters of related discussions: evidence, bounded components, representatives, identities over generations."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from threadloom.functions.hashing import members_key
from threadloom.functions.text import EARLY_BODY_BYTES, MIN_TITLE_OVERLAP, ascii_lower, mentions_in, overlap_ratio, title_tokens

# The weight of a mention and the similarity from which titles need not support a pair.
REFERENCE_SCORE = 0.94
STRONG_SIMILARITY = 0.90
#: The pairs, or edges, that one task folds in order in a round of identity matching or of ordered unions.
FOLD_PAIRS = FOLD_EDGES = 100_000


def reference_edges(threads: DataFrame) -> DataFrame:
    """a < b, score: mentions in title or body of a thread of the same repository.

    Mentions late in a body need title support; numbers are matched by an equi join within the repository.
    """
    rows = threads.select("thread_id", "number", "full_name", title_tokens(F.col("title")).alias("words"), F.explode(F.array(F.struct(F.lit(True).alias("is_title"), F.col("title").alias("text")), F.struct(F.lit(False).alias("is_title"), F.col("body").alias("text")))).alias("p"))
    rows = rows.select("*", "p.is_title", "p.text").drop("p").where(F.col("text").rlike(r"(?iu)#\d|(issues|pull)/\d"))
    found = mentions_in(rows, "text").where((F.col("target") != F.col("number")) & (F.col("repository").isNull() | (ascii_lower(F.col("repository")) == ascii_lower(F.col("full_name")))))
    found = found.select("thread_id", "full_name", "words", "is_title", "target", "byte_offset")
    other = threads.select(F.col("thread_id").alias("other"), F.col("number").alias("target"), "full_name", title_tokens(F.col("title")).alias("other_words"))
    pairs = found.join(other, ["full_name", "target"]).where(F.col("is_title") | (F.col("byte_offset") <= EARLY_BODY_BYTES) | (overlap_ratio(F.col("words"), F.col("other_words")) >= MIN_TITLE_OVERLAP))
    return pairs.select(F.least("thread_id", "other").alias("a"), F.greatest("thread_id", "other").alias("b")).distinct().withColumn("score", F.lit(REFERENCE_SCORE))


def neighbours(threads: DataFrame, chunks: DataFrame, threshold: float, cross_kind: float, fanout: int, references: DataFrame | None = None, block: int = 1024) -> DataFrame:
    """a, b, score, rank: the fanout best eligible pairs of each thread within its repository, seen from a.

    A pair scores its best eligible similarity or the weight of a reference, whichever is more, so references (a < b, score) take
    and lose places like any other pair; those of threads without vectors don't count. Exact over all pairs, without a row
    for each: threads of a repository are dealt into blocks around pivots, each pair of blocks that may hold an eligible pair (tiles.py) is
    one matrix product in a task, and only the best of each thread leave it. A pair that a tile leaves out has fanout better ones, which references only add to.
    """
    from threadloom.operators.tiles import tiled

    vectors = chunks.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("chunk_index", "vector"))).alias("c"))
    rows = threads.join(vectors, "thread_id").select("thread_id", "full_name", "kind", title_tokens(F.col("title")).alias("words"), F.transform("c", lambda c: c["vector"]).alias("vectors"))
    tiles = tiled(rows, threshold, block)[0].select("thread_id", "full_name", "kind", "words", "vectors", "block", "i", "j")

    def tile(t):
        import pyarrow as pa

        ids, kinds, blocks = t["thread_id"].to_numpy(), t["kind"].to_pylist(), t["block"].to_numpy()
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        words = [set(w) for w in t["words"].to_pylist()]
        owner, matrix = [], []
        for k, vs in enumerate(t["vectors"].to_pylist()):
            for v in vs:
                v = np.asarray(v, np.float64)
                n = np.sqrt((v * v).sum())
                if n > 0 and np.isfinite(n):
                    owner.append(k)
                    matrix.append(v / n)
        out = {"a": [], "b": [], "score": []}
        by_size: dict[int, list[int]] = {}
        for r, v in enumerate(matrix):
            by_size.setdefault(len(v), []).append(r)
        best = np.full((len(ids), len(ids)), -np.inf)
        for same in by_size.values():
            m = np.stack([matrix[r] for r in same])
            o = np.array([owner[r] for r in same])
            np.maximum.at(best, (o[:, None], o[None, :]), m @ m.T)
        np.fill_diagonal(best, -np.inf)
        if i != j:
            best[blocks[:, None] == blocks[None, :]] = -np.inf
        # Titles as a matrix of words, so that the shared words of all pairs are one product.
        vocabulary = {w: c for c, w in enumerate(sorted(set().union(*words)))} if words else {}
        has = np.zeros((len(ids), max(1, len(vocabulary))), np.float32)
        for k, own in enumerate(words):
            has[k, [vocabulary[w] for w in own]] = 1
        count = has.sum(1)
        support = (has @ has.T) / np.maximum(1, np.minimum(count[:, None], count[None, :]))
        kind = np.array([hash(x) for x in kinds])
        best = np.minimum(best, 1.0)
        ok = (best >= threshold) & ((best >= STRONG_SIMILARITY) | (support >= np.float32(MIN_TITLE_OVERLAP))) & ((kind[:, None] == kind[None, :]) | (best >= cross_kind))
        for k in np.flatnonzero(ok.any(1)).tolist():
            at = np.flatnonzero(ok[k])
            if len(at) > fanout:  # all that tie with the fanout-th stay for the exact order
                at = at[best[k, at] >= np.partition(best[k, at], len(at) - fanout)[len(at) - fanout]]
            for x in at[np.lexsort((ids[at], -best[k, at]))][:fanout].tolist():
                out["a"].append(int(ids[k]))
                out["b"].append(int(ids[x]))
                out["score"].append(float(best[k, x]))
        return pa.table({"a": pa.array(out["a"], pa.int64()), "b": pa.array(out["b"], pa.int64()), "score": pa.array(out["score"], pa.float64())})

    found = tiles.groupBy("full_name", "i", "j").applyInArrow(tile, "a long, b long, score double")
    if references is not None:
        held = vectors.select("thread_id")
        known = references.join(held.withColumnRenamed("thread_id", "a"), "a", "left_semi").join(held.withColumnRenamed("thread_id", "b"), "b", "left_semi")
        known = known.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("p"), "score").select("p.*", "score")
        found = found.unionByName(known).groupBy("a", "b").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= fanout)


def candidate_edges(near: DataFrame) -> DataFrame:
    """The union of both endpoints' choices, one row a pair."""
    return near.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("score").alias("score"))


def ordered_edges(edges: DataFrame) -> DataFrame:
    """edges with their position: score descending, then a and b; the order in which unions are tried."""
    from threadloom.operators.ordering import dense_index

    return dense_index(edges, [F.col("score").desc(), F.col("a"), F.col("b")], "position")


def bounded_components(threads: DataFrame, edges: DataFrame, most: int = 40, fold: int = FOLD_EDGES) -> DataFrame:
    """thread_id, cluster (its smallest thread id), degree, and the kept links as (other, score).

    The result is that of trying unions in order (score descending, a, b) and refusing those beyond `most` nodes.
    """
    from threadloom.operators.bounded_union import bounded_union

    labels, kept = bounded_union(edges, most, fold)
    ends = kept.select("score", F.explode(F.array(F.struct(F.col("a").alias("thread_id"), F.col("b").alias("other")), F.struct(F.col("b").alias("thread_id"), F.col("a").alias("other")))).alias("e"))
    per = ends.groupBy("e.thread_id").agg(F.sort_array(F.collect_list(F.struct(F.col("e.other").alias("other"), F.col("score").alias("score")))).alias("links"))
    rows = threads.select("thread_id").join(labels.select(F.col("node").alias("thread_id"), F.col("label").alias("cluster")), "thread_id", "left").join(per, "thread_id", "left")
    none = F.array().cast("array<struct<other long, score double>>")
    return rows.select("thread_id", F.coalesce("cluster", "thread_id").alias("cluster"), F.coalesce("links", none).alias("links")).withColumn("degree", F.size("links"))


def ordered_clusters(members: DataFrame) -> DataFrame:
    """cluster, size, position: larger clusters first, then the smallest thread."""
    from threadloom.operators.ordering import dense_index

    sizes = members.groupBy("cluster").agg(F.count("*").alias("size"))
    return dense_index(sizes, [F.col("size").desc(), F.col("cluster")], "position")


def with_representatives(members: DataFrame) -> DataFrame:
    """thread_id, cluster, representative, size, score: the representative has most links, then the smallest number.

    A member's score is that of its link with the representative, 1 for itself and null without a direct link.
    """
    number = F.col("number") if "number" in members.columns else F.col("thread_id")
    heads = members.groupBy("cluster").agg(F.min_by("thread_id", F.struct((-F.col("degree")).alias("d"), number.alias("n"), F.col("thread_id"))).alias("representative"), F.count("*").alias("size"))
    rows = members.join(heads, "cluster")
    direct = F.filter("links", lambda e: e["other"] == F.col("representative"))
    score = F.when(F.col("thread_id") == F.col("representative"), F.lit(1.0)).otherwise(F.get(direct, F.lit(0))["score"])
    return rows.select("thread_id", "cluster", "representative", "size", score.alias("score"))


def stable_keys(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(members_key(F.collect_list("thread_id")).alias("stable_key"), F.count("*").alias("size"))


def overlaps(generated: DataFrame, existing: DataFrame) -> DataFrame:
    """generated_id, existing_id, overlap, union of clusters with a common member; inputs are (cluster, thread_id)."""
    g = generated.select(F.col("cluster").alias("generated_id"), "thread_id")
    e = existing.select(F.col("cluster").alias("existing_id"), "thread_id")
    common = g.join(e, "thread_id").groupBy("generated_id", "existing_id").agg(F.count("*").alias("overlap"))
    sizes = lambda df, c, n: df.groupBy(c).agg(F.count("*").alias(n))
    return common.join(sizes(g, "generated_id", "_g"), "generated_id").join(sizes(e, "existing_id", "_e"), "existing_id").select("generated_id", "existing_id", "overlap", (F.col("_g") + F.col("_e") - F.col("overlap")).alias("union_size"))


def match_identities(pairs: DataFrame) -> DataFrame:
    """generated_id, existing_id: the greedy one-to-one assignment in order of overlap, share, existing and generated id.

    Taking every pair that is best for both its sides, again and again, gives the greedy result without one task
    seeing all pairs. Chains of equal pairs yield one pair a round, so each round also folds the first FOLD_PAIRS of the
    pairs left, in order; rounds go on until no pair is left. Only pairs of one overlap compare their shares, so the
    larger share is the smaller union, and no quotient is rounded.
    """
    share = -F.col("union_size")
    key = F.struct((-F.col("overlap")).alias("o"), (-share).alias("s"), F.col("existing_id").alias("e"), F.col("generated_id").alias("g"))
    left, taken, rounds = _kept(pairs.withColumn("key", key)), None, 0
    ids = left.select("generated_id", "existing_id").schema
    arrow_ids = to_arrow_schema(ids)

    def fold(batches):
        import pyarrow as pa

        rows = sorted((tuple(k.values()), g, e) for b in batches for g, e, k in zip(*(b.column(c).to_pylist() for c in ("generated_id", "existing_id", "key"))))
        gs, es, out = set(), set(), []
        for _, g, e in rows:
            if g not in gs and e not in es:
                gs.add(g)
                es.add(e)
                out.append({"generated_id": g, "existing_id": e})
        yield from pa.Table.from_pylist(out, schema=arrow_ids).to_batches()

    while True:
        marked = left.withColumn("bg", F.min("key").over(Window.partitionBy("generated_id"))).withColumn("be", F.min("key").over(Window.partitionBy("existing_id")))
        best = _kept(marked.where("key = bg AND key = be").select("generated_id", "existing_id"))
        left = _kept(_without(left, best))
        if not left.isEmpty():
            # The first pairs of the order, without what is taken: the next steps of the greedy pass, of bounded number.
            first = left.select("generated_id", "existing_id", "key").orderBy("key").limit(FOLD_PAIRS)
            more = _kept(first.coalesce(1).mapInArrow(fold, ids))
            best, left = best.unionByName(more), _kept(_without(left, more))
        taken, rounds = best if taken is None else taken.unionByName(best), rounds + 1
        if left.isEmpty():
            return taken
        if rounds % 16 == 0:
            taken = _kept(taken)


def _without(left: DataFrame, taken: DataFrame) -> DataFrame:
    return left.join(taken.select("generated_id"), "generated_id", "left_anti").join(taken.select("existing_id"), "existing_id", "left_anti")


def shared_folder(spark) -> str:
    """The checkpoint folder that driver and executors share; only a local session may name none."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = "/tmp/checkpoints/threadloom"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def _kept(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def cluster_summaries(members: DataFrame, threads: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """cluster, active, excluded and the title to show: canonical, else representative, else lowest active number."""
    rows = members.join(threads.select("thread_id", "number", "title"), "thread_id")
    own = rows if canonical is None else rows.join(canonical.select("cluster", F.col("thread_id").alias("_canonical")), "cluster", "left")
    chosen = F.lit(None).cast("boolean") if canonical is None else F.col("thread_id") == F.col("_canonical")
    rank = F.struct((~F.coalesce(chosen, F.lit(False))).alias("c"), (~F.coalesce(F.col("thread_id") == F.col("representative"), F.lit(False))).alias("r"), (F.col("state") != "active").alias("s"), F.col("number").alias("n"))
    return own.groupBy("cluster").agg(F.count_if(F.col("state") == "active").alias("active"), F.count_if(F.col("state") == "excluded").alias("excluded"), F.min_by("title", rank).alias("title"))
