"""Exact dedup (native): groups by a 128-bit content hash, bytes compared inside the groups.

Two texts are equal when they are the same after white space (space, 0x09-0x0D) is deleted; null counts as
empty. Of equal texts the row with the most code points stays, then the one with the smallest id.

Defined cases: a null id sorts after every other id; an empty table gives an empty table. exact_groups() reports rows
that repeat the id of the kept row as kept with it (they are the same document) and neither reads nor returns other
columns, whatever their names; drop_copies() returns one of such rows, with all its columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import WHITE_CLASS, materialize


def normalized(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{WHITE_CLASS}+", "")


def content_hash(norm: Column) -> Column:
    """128 bits as bytes; half the size of its hex form in the shuffle."""
    return F.unhex(F.md5(norm))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """One row per document: its id, keep_id, group_size, kept, text_sha256.

    The texts are shuffled once, after map-side aggregation: a text that a third of the rows share leaves each
    task once. Grouping by (hash, text) compares bytes, so a collision of hash_fn splits into its true groups.
    Documents then find their group by (hash, SHA-256) in a plain join, whose hot keys AQE can split. Should two
    different texts ever share both digests, the query fails instead of merging them.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("doc_id", F.length("t").cast("long").alias("points"), normalized(F.col("t")).alias("norm"))
    rows = rows.select("doc_id", "points", "norm", hash_fn(F.col("norm")).alias("h"))
    # max of (code points, has an id, -id): most code points, then the smallest id, null ids last.
    best = F.max(F.struct(F.col("points"), F.col("doc_id").isNotNull().alias("has"), (-F.col("doc_id")).alias("neg")))
    texts = rows.groupBy("h", "norm").agg(F.count("*").alias("n"), best.alias("best"))
    classes = (
        texts.select("h", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"), "n", "best")
        .groupBy("h", "sha")
        .agg(F.count("*").alias("texts"), F.max(F.struct("n", "best")).alias("c"))
        .select(
            "h",
            "sha",
            F.when(F.col("texts") == 1, F.col("c.n")).otherwise(F.raise_error(F.lit("two texts share both digests")).cast("long")).alias("group_size"),
            (-F.col("c.best.neg")).alias("keep_id"),
        )
    )
    members = rows.select("doc_id", "h", F.unhex(F.sha2(F.col("norm"), 256)).alias("sha"))
    return members.join(classes, ["h", "sha"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_fn=content_hash) -> DataFrame:
    """One row of docs for each text, all its columns as they were.

    Hashes are counted first, and only hashes that occur twice have their texts compared, so no text of a single
    document is shuffled while Spark can send out the repeated hashes; beyond its broadcast threshold documents meet
    them by one shuffle, which AQE splits where a hash is hot. Grouping by (hash, text) compares bytes; the rows
    of a group are reduced to the best one on the map side, so a text of a third of all rows leaves each task once.
    """
    columns = [docs[c] for c in docs.columns]
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(F.struct(*columns).alias("row"), docs[id_col].alias("id"), text.alias("t"), normalized(text).alias("norm"))
    rows = rows.select("row", "id", "t", "norm", hash_fn(F.col("norm")).alias("h"))
    repeated = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    repeated = materialize(repeated, "exact-repeated")
    single = rows.select("row", "h").join(repeated, "h", "left_anti").select("row.*")
    order = F.struct(F.length("t").alias("points"), F.col("id").isNotNull().alias("has"), (-F.col("id")).alias("neg"), F.xxhash64("t").alias("tie"))
    best = rows.join(repeated, "h", "left_semi").groupBy("h", "norm").agg(F.max_by("row", order).alias("row"))
    return single.unionByName(best.select("row.*"))


def op3_exact_dedup(spark, sf_dir):
    from threadloom.llm.common import read_table

    return exact_groups(read_table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha256(norm) AS text_sha256
FROM d
WINDOW w AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""
