"""Which stored vectors still describe the archive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHILD_FAMILIES = ("comments", "reviews", "review_threads")


def newest_evidence(coverage: DataFrame) -> DataFrame:
    """thread_id, observed_at_us: when child evidence of a thread was last observed."""
    return coverage.where(F.col("family").isin(*CHILD_FAMILIES)).groupBy("thread_id").agg(F.max("observed_at_us").alias("observed_at_us"))


def current_documents(documents: DataFrame, threads: DataFrame, recipe: str, version: int, context: DataFrame | None = None, coverage: DataFrame | None = None) -> DataFrame:
    """documents of a recipe and version that were rendered from the thread as it is now.

    Enriched documents need more: built no earlier than their newest child evidence (coverage), and no family stale
    (context: thread_id, family, stale).
    """
    rows = documents.where((F.col("recipe") == recipe) & (F.col("recipe_version") == version))
    now = threads.select("thread_id", F.col("updated_at_us").alias("source_updated_at_us"))
    rows = rows.join(now, ["thread_id", "source_updated_at_us"], "left_semi")
    if coverage is not None:
        seen = newest_evidence(coverage)
        rows = rows.join(seen, "thread_id", "left").where(F.col("built_at_us") >= F.coalesce("observed_at_us", F.lit(0))).drop("observed_at_us")
    if context is not None:
        rows = rows.join(context.where("stale").select("thread_id"), "thread_id", "left_anti")
    return rows


def current_vectors(vectors: DataFrame, documents: DataFrame, endpoint: str, model: str) -> DataFrame:
    """vectors of one service and model whose document (of those given) has not changed since, with its thread_id."""
    mine = vectors.where((F.col("endpoint") == endpoint) & (F.col("model") == model))
    of = documents.select("document_id", "thread_id", F.col("content_hash").alias("document_hash"))
    return mine.join(of, ["document_id", "document_hash"])


def upsert_documents(stored: DataFrame, rendered: DataFrame, built_at_us: int) -> DataFrame:
    """stored after rendered ones (thread_id, recipe, recipe_version, content_hash, title, source_updated_at_us) are written.

    An unchanged row keeps its id and build time; a new source time alone is recorded without content_changed. New
    documents have no document_id yet; written tells rows that were touched.
    """
    keys, values = ["thread_id", "recipe"], ["recipe_version", "content_hash", "title", "source_updated_at_us"]
    new = rendered.select(*keys, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_new"))
    both = stored.join(new, keys, "full_outer")
    is_new = F.coalesce("_new", F.lit(False))
    differs = lambda *names: _any([~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names])
    rebuilt = is_new & differs("content_hash", "recipe_version")
    return both.select(
        *keys, "document_id", *[F.when(is_new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values],
        F.when(rebuilt, F.lit(built_at_us)).otherwise(F.col("built_at_us")).alias("built_at_us"),
        (is_new & differs("content_hash")).alias("content_changed"), (is_new & differs(*values)).alias("written"),
    )


def _any(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def upsert_vectors(stored: DataFrame, new: DataFrame, documents: DataFrame) -> DataFrame:
    """stored with new ones put over those of equal key; new ones of a document that has changed meanwhile are dropped."""
    from threadloom.operators.observations import upsert

    key = ["document_id", "endpoint", "model", "document_hash", "chunk_index"]
    fits = new.join(documents.select("document_id", F.col("content_hash").alias("document_hash")), ["document_id", "document_hash"], "left_semi")
    return upsert(stored, fits.select(stored.columns), key)


def report(batches: DataFrame) -> DataFrame:
    """The sum of embedding reports (documents, selected, embedded, skipped, failed, cancelled), one row."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("documents", "selected", "embedded", "skipped", "failed")]
    return batches.agg(*sums, F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("cancelled"))
