"""Unions in order under a size cap, without one task that sees a component.

Sequentially, edges are tried in order; an edge within a component is kept, one that joins two components is kept if they
are small enough together, else refused. Three facts let many edges be decided at once, with the same result:

- an edge that is the first undecided one of both its components meets them as they are now, so it can be decided;
- two components that are too large together stay so, and never meet, so all edges between them can be refused at once;
- the first `fold` undecided edges of the whole order meet nothing but each other, so one task can try them in order.

A round does all three and contracts. With scores in no particular order a round decides a fixed share of the edges; where
scores only fall along long paths the third fact still decides `fold` edges a round, of bounded memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators.clustering import _kept

MOVES = "old long, label long, size long"


def _folded(most: int):
    """Tries the edges of the one partition in order and gives the components that they touch as moves."""

    def run(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("score", "a", "b", "la", "lb", "na", "nb")))]
        rows.sort(key=lambda r: (-r[0], r[1], r[2]))
        parent, size = {}, {}

        def find(n):
            while parent[n] != n:
                parent[n] = parent[parent[n]]
                n = parent[n]
            return n

        for _, _, _, la, lb, na, nb in rows:
            for label, n in ((la, na), (lb, nb)):
                if label not in parent:
                    parent[label], size[label] = label, n
            x, y = find(la), find(lb)
            if x != y and size[x] + size[y] <= most:
                x, y = min(x, y), max(x, y)
                parent[y] = x
                size[x] += size[y]
        ends = [find(n) for n in parent]
        yield pa.RecordBatch.from_pydict({"old": pa.array(list(parent), pa.int64()), "label": pa.array(ends, pa.int64()), "size": pa.array([size[x] for x in ends], pa.int64())})

    return run


def bounded_union(edges: DataFrame, most: int, fold: int) -> tuple[DataFrame, DataFrame]:
    """Labels (node, label: the least node of its component) of all nodes, and the kept edges (a, b, score).

    edges: a, b, score, one row a pair; pairs of a node with itself are left out, and a score that is null counts as the lowest.
    """
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf"))).alias("score")
    one = F.lit(1).cast("long")
    state = _kept(edges.where("a != b").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), score).select("a", "b", "score", F.col("a").alias("la"), F.col("b").alias("lb"), one.alias("na"), one.alias("nb")))
    nodes = state.select(F.explode(F.array("a", "b")).alias("node")).distinct().select("node", F.col("node").alias("label"))
    kept = []
    while (left := state.count()) > 0:
        order = [F.col("score").desc(), F.col("a"), F.col("b")]
        first = state if left <= fold else _kept(state.orderBy(*order).limit(fold))
        moves = first.coalesce(1).mapInArrow(_folded(most), MOVES)
        done = F.lit(True)
        if left > fold:
            last = first.orderBy(F.col("score"), F.col("a").desc(), F.col("b").desc()).first()
            key = F.struct((-F.col("score")).alias("s"), F.col("a").alias("a"), F.col("b").alias("b"))
            bound = F.struct(F.lit(-last["score"]).alias("s"), F.lit(last["a"]).alias("a"), F.lit(last["b"]).alias("b"))
            done = key <= bound
            each = state.select(F.explode(F.array("la", "lb")).alias("label"), F.struct((-F.col("score")).alias("s"), "a", "b", "la", "lb", "na", "nb").alias("e"))
            mutual = each.groupBy("label").agg(F.min("e").alias("e")).groupBy("e").agg(F.count("*").alias("n")).where("n = 2").select("e.*")
            mutual = mutual.where(F.struct(F.col("s").alias("s"), F.col("a").alias("a"), F.col("b").alias("b")) > bound)
            united = mutual.select(F.explode(F.array("la", "lb")).alias("old"), F.least("la", "lb").alias("label"), (F.col("na") + F.col("nb")).alias("size"))
            moves = moves.unionByName(united)
        moves = _kept(moves)
        of = lambda side: moves.select(F.col("old").alias("l" + side), F.col("label").alias("to_" + side), F.col("size").alias("size_" + side))
        moved = state.withColumn("done", done).join(of("a"), "la", "left").join(of("b"), "lb", "left").select(
            "a", "b", "score", "done", F.coalesce("to_a", "la").alias("la"), F.coalesce("to_b", "lb").alias("lb"), F.coalesce("size_a", "na").alias("na"), F.coalesce("size_b", "nb").alias("nb"),
        )
        moved = _kept(moved)
        kept.append(moved.where("la = lb").select("a", "b", "score"))
        nodes = _kept(nodes.join(moves.select(F.col("old").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        if left <= fold:
            break
        # What was tried and joins nothing was refused; what is too large together is refused now.
        state = _kept(moved.where(~F.col("done") & (F.col("la") != F.col("lb")) & (F.col("na") + F.col("nb") <= most)).drop("done"))
        if len(kept) % 16 == 0:
            kept = [_kept(_union(kept))]
    return nodes, _union(kept) if kept else edges.where("a != b").select("a", "b", "score").limit(0)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
