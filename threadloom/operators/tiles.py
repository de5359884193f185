"""Which blocks of threads need to be compared: cells around pivots, and the triangle inequality between them.

A repository of more than `block` threads is cut into cells: each thread goes to the nearest of some pivots (threads chosen by
a hash, one for each block that the repository would fill), and cells larger than a block are cut by hash. A cell's radius
is the largest angle between its pivot and any of its vectors. Two vectors of two cells lie at least as far apart as the
pivots less both radii, so a pair of blocks beyond the threshold's angle holds no eligible pair and is left out. What is kept is
compared exactly; without such a gap all pairs of blocks are.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.clustering import _kept

MOST_PIVOTS = 1024
SALT_ROWS = 8192
#: What rounding may add to an angle.
SLACK = 1e-6


def units(vectors) -> list[np.ndarray]:
    """Vectors of length one; those without a direction are left out."""
    out = []
    for v in vectors:
        v = np.asarray(v, np.float64)
        n = np.sqrt((v * v).sum())
        if n > 0 and np.isfinite(n):
            out.append(v / n)
    return out


def angle(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.arccos(np.clip(a @ b, -1.0, 1.0))) if len(a) == len(b) else np.pi


def placed(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """rows (thread_id, full_name, vectors, ...) with their block, and the blocks: full_name, block, pivot, radius.

    The pivot of a repository of one block is null; if all are, blocks have no pivots and radii at all.
    """
    sizes = rows.groupBy("full_name").agg(F.count("*").alias("n"))
    sizes = _kept(sizes.select("full_name", F.ceil(F.col("n") / block).cast("int").alias("blocks"), F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts")))
    many = sizes.where("blocks > 1")
    none = F.lit(None)
    if many.isEmpty():
        return rows.withColumn("block", F.lit(0)), sizes.select("full_name", F.lit(0).alias("block"))
    large = rows.join(many, "full_name")
    first = F.row_number().over(Window.partitionBy("full_name").orderBy(F.xxhash64("thread_id"), "thread_id"))
    usable = large.where(F.exists("vectors", lambda v: F.exists(v, lambda x: (x != 0) & ~F.isnan(x) & (F.abs(x) < float("inf")))))
    pivots = usable.select("full_name", "blocks", "salts", "vectors", first.alias("cell")).where(F.col("cell") <= F.least("blocks", F.lit(MOST_PIVOTS)))
    pivots = _kept(pivots.select("full_name", "salts", "cell", F.transform("vectors", lambda v: F.transform(v, lambda x: x.cast("double"))).alias("vectors")))
    salted = large.select("full_name", "thread_id", F.pmod(F.xxhash64("thread_id", F.lit(7)), F.col("salts")).cast("int").alias("salt"), F.transform("vectors", lambda v: F.transform(v, lambda x: x.cast("double"))).alias("vectors"))
    copies = pivots.select(F.col("full_name").alias("of"), "cell", "vectors", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("copy"))

    def nearest(mine, theirs):
        import pyarrow as pa

        cells = sorted((c, units(v)) for c, v in zip(theirs["cell"].to_pylist(), theirs["vectors"].to_pylist()))
        cells = [(c, u[0]) for c, u in cells if u]
        by_size: dict[int, tuple[list[int], np.ndarray]] = {}
        for size in {len(u) for _, u in cells}:
            by_size[size] = [c for c, u in cells if len(u) == size], np.stack([u for _, u in cells if len(u) == size])
        pivot = dict(cells)
        out, far = [], []
        for vs in mine["vectors"].to_pylist():
            own = units(vs)
            if not own or len(own[0]) not in by_size:  # no direction, or none that a pivot shares: any cell, and no bound
                out.append(cells[0][0] if cells else 0)
                far.append(0.0 if not own else np.pi)
                continue
            numbers, matrix = by_size[len(own[0])]
            cell = numbers[int((matrix @ own[0]).argmax())]
            out.append(cell)
            far.append(max(angle(u, pivot[cell]) for u in own))
        return pa.table({"full_name": mine["full_name"], "thread_id": mine["thread_id"], "cell": pa.array(out, pa.int32()), "far": pa.array(far, pa.float64())})

    cells = _kept(salted.groupBy("full_name", "salt").cogroup(copies.groupBy("of", "copy")).applyInArrow(nearest, "full_name string, thread_id long, cell int, far double"))
    # Cells are cut into blocks, numbered through the repository's cells (at most MOST_PIVOTS of them).
    counts = cells.groupBy("full_name", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    before = Window.partitionBy("full_name").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("full_name", "cell", "parts", F.coalesce(F.sum("parts").over(before), F.lit(0)).cast("int").alias("base"))
    numbered = _kept(cells.join(counts, ["full_name", "cell"]).select("full_name", "thread_id", "cell", "far", (F.col("base") + F.pmod(F.xxhash64("thread_id", F.lit(9)), F.col("parts"))).cast("int").alias("block")))
    radius = numbered.groupBy("full_name", "block").agg(F.first("cell").alias("cell"), F.max("far").alias("radius"))
    of = radius.join(pivots.select("full_name", "cell", F.col("vectors").alias("_v")), ["full_name", "cell"], "left")
    blocks = of.select("full_name", "block", F.filter("_v", lambda v: F.exists(v, lambda x: x != 0))[0].alias("pivot"), "radius")
    single = sizes.where("blocks = 1").select("full_name", F.lit(0).alias("block"), none.cast("array<double>").alias("pivot"), none.cast("double").alias("radius"))
    rows = rows.join(numbered.select("thread_id", "block"), "thread_id", "left").withColumn("block", F.coalesce("block", F.lit(0)))
    return rows, blocks.unionByName(single)


def pairs(blocks: DataFrame, threshold: float) -> DataFrame:
    """full_name, i, j (i <= j), kept: the pairs of blocks, and whether they may hold a pair of the threshold's similarity."""
    most = float(np.arccos(np.clip(threshold, -1.0, 1.0))) + SLACK

    def between(table):
        import pyarrow as pa

        order = np.argsort(table["block"].to_numpy())
        number = table["block"].to_numpy()[order]
        known = table["pivot"].to_pylist()
        raw = [(units([known[k]]) or [None])[0] if known[k] is not None else None for k in order]
        radius = np.array([np.inf if r is None else r for r in table["radius"].to_pylist()])[order]
        i, j = np.triu_indices(len(number))
        keep = np.ones(len(i), bool)
        for size in {len(u) for u in raw if u is not None}:
            same = np.array([u is not None and len(u) == size for u in raw])
            at = np.cumsum(same) - 1
            m = np.stack([u for u in raw if u is not None and len(u) == size])
            apart = np.arccos(np.clip(m @ m.T, -1.0, 1.0))
            both = same[i] & same[j] & (i != j)
            keep[both] = apart[at[i[both]], at[j[both]]] - radius[i[both]] - radius[j[both]] <= most
        name = table["full_name"][0].as_py()
        return pa.table({"full_name": pa.array([name] * len(i), pa.string()), "i": pa.array(number[i], pa.int32()), "j": pa.array(number[j], pa.int32()), "kept": pa.array(keep)})

    return blocks.groupBy("full_name").applyInArrow(between, "full_name string, i int, j int, kept boolean")


def tiled(rows: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """rows once for each pair of blocks (i, j) that they belong to and that is kept, and all pairs with `kept`."""
    rows, blocks = placed(rows, block)
    if "pivot" not in blocks.columns:  # every repository is one block
        zero = F.lit(0)
        return rows.withColumn("i", zero).withColumn("j", zero), blocks.select("full_name", zero.alias("i"), zero.alias("j"), F.lit(True).alias("kept"))
    every = _kept(pairs(blocks, threshold))
    kept = every.where("kept").select("full_name", "i", "j")
    ends = kept.select("full_name", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return rows.join(ends, ["full_name", "block"]), every
