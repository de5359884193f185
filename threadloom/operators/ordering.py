"""Dense numbers over an order, without sorting everything into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(rows: DataFrame, order: list[str | Column], name: str = "index", first: int = 0) -> DataFrame:
    """rows numbered first, first + 1, ... in the order given, which should be total.

    Rows are range-partitioned and sorted within partitions; a partition's first number comes from the counts of those
    before it, one row each. The sorted rows are checkpointed, so that both passes see the same ranges.
    """
    from threadloom.operators.clustering import _kept

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    local = _kept(ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    sizes = local.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    number = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + first
    return local.join(F.broadcast(before), "_part").select(*rows.columns, number.alias(name))  # at most one row a partition


def reserve_sequences(requests: DataFrame, order: list[str], last: int) -> DataFrame:
    """requests with the sequences that follow `last`; a sequence is never given twice, gaps may stay where work is given up."""
    return dense_index(requests, order, "sequence", last + 1)


def keyset_page(rows: DataFrame, key: str, after: int | None, limit: int, accepted: Column | None = None) -> tuple[DataFrame, int | None]:
    """The next `limit` candidates after a key, of which the accepted ones are returned, and the key to go on from.

    The cursor comes from the candidates, so a page of rejected ones doesn't end the walk; None at the end.
    """
    head = (rows if after is None else rows.where(F.col(key) > after)).orderBy(key).limit(limit)
    size, last = head.agg(F.count("*"), F.max(key)).first()
    return (head if accepted is None else head.where(accepted)), last if size == limit else None
