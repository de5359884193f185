"""Observations: order-independent application of late and repeated evidence.

An observation carries a source clock and an acquisition sequence; which of two wins depends on these alone, not on
arrival. Tables are folded into next tables: nothing is updated in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority(clock: Column, sequence: Column) -> Column:
    """The order of observations: usable clocks over missing ones, then the clock, then the sequence."""
    return F.struct(clock.isNotNull().alias("valid"), clock.alias("clock"), sequence.alias("sequence"))


def canonical(log: DataFrame, keys: list[str], payload: list[str], clock: str = "source_clock", sequence: str = "sequence") -> DataFrame:
    """The winning row of each key; aggregated on the map side, so a hot key costs one row a task."""
    row = F.struct(*[F.col(c) for c in (*payload, clock, sequence)])
    return log.groupBy(*keys).agg(F.max_by(row, priority(F.col(clock), F.col(sequence))).alias("w")).select(*keys, "w.*")


def conflicts(log: DataFrame, keys: list[str], payload: str, clock: str = "source_clock", sequence: str = "sequence") -> DataFrame:
    """Keys with different payloads of one clock and sequence: an error, never a choice."""
    return log.groupBy(*keys, clock, sequence).agg(F.count_distinct(payload).alias("payloads")).where("payloads > 1")


def canonical_strict(log: DataFrame, keys: list[str], payload: list[str], raw: str = "raw_clock", clock: str = "source_clock", sequence: str = "sequence") -> DataFrame:
    """canonical(), but a key without any usable clock whose unusable ones differ is an error: nothing says which came first.

    raw is a clock as the provider wrote it; spellings that differ in outer white space alone are one, and a missing one is a spelling too.
    """
    spelling = F.when(F.col(clock).isNull(), F.trim(F.coalesce(raw, F.lit(""))))
    row = F.struct(*[F.col(c) for c in (*payload, clock, sequence)])
    best = log.groupBy(*keys).agg(F.max_by(row, priority(F.col(clock), F.col(sequence))).alias("w"), F.max(clock).isNotNull().alias("_usable"), F.count_distinct(spelling).alias("_spellings"))
    bad = ~F.col("_usable") & (F.col("_spellings") > 1)
    return best.select(*keys, F.when(bad, F.raise_error(F.lit("two unusable source clocks of one observation")).cast("string").isNull()).otherwise(F.lit(True)).alias("_ok"), "w").where("_ok").select(*keys, "w.*")


def ambiguous_keys(log: DataFrame, keys: list[str], raw: str = "raw_clock", clock: str = "source_clock") -> DataFrame:
    """Keys that canonical_strict() refuses."""
    spelling = F.when(F.col(clock).isNull(), F.trim(F.coalesce(raw, F.lit(""))))
    return log.groupBy(*keys).agg(F.max(clock).alias("_c"), F.count_distinct(spelling).alias("spellings")).where("_c IS NULL AND spellings > 1").select(*keys, "spellings")


def dispositions(log: DataFrame, current: DataFrame, keys: list[str], payload: str, clock: str = "source_clock", sequence: str = "sequence") -> DataFrame:
    """log with what became of each row against current: applied, replayed, skipped or conflict."""
    now = current.select(*keys, F.col(clock).alias("_c"), F.col(sequence).alias("_s"), F.col(payload).alias("_p"))
    rows = log.join(now, keys, "left")
    mine, theirs = priority(F.col(clock), F.col(sequence)), F.struct(F.col("_c").isNotNull().alias("valid"), F.col("_c").alias("clock"), F.col("_s").alias("sequence"))
    what = (
        F.when(F.col("_s").isNull() | (mine > theirs), "applied")
        .when(mine == theirs, F.when(F.col(payload).eqNullSafe(F.col("_p")), "replayed").otherwise("conflict"))
        .otherwise("skipped")
    )
    return rows.select(*log.columns, what.alias("disposition"))


def upsert(current: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """current with the rows of changes put over those of equal keys (the last writer wins)."""
    values = [c for c in current.columns if c not in keys]
    new = changes.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in values], F.lit(True).alias("_new"))
    both = current.join(new, keys, "full_outer")
    return both.select(*keys, *[F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in values])


def merged_pages(pages: DataFrame, scope: list[str], item: str = "provider_id", payload: str = "payload") -> DataFrame:
    """Items of staged pages, once each; n_payloads over 1 marks a conflict."""
    return pages.groupBy(*scope, item).agg(F.count_distinct(payload).alias("n_payloads"), F.min(payload).alias(payload), F.count("*").alias("received"))


def page_sets(pages: DataFrame, scope: list[str], index: str = "page_index") -> DataFrame:
    """Per scope: pages, received items, and whether the page indexes are 0 to n - 1."""
    return pages.groupBy(*scope).agg(F.count_distinct(index).alias("pages"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.sum("items").alias("received")).select(*scope, "pages", "received", ((F.col("lo") == 0) & (F.col("hi") == F.col("pages") - 1)).alias("contiguous"))


def current_membership(generations: DataFrame, items: DataFrame, keys: list[str]) -> DataFrame:
    """Items of the latest complete generation of each key; incomplete generations change nothing, and a complete one
    without items empties the membership."""
    latest = generations.where("status = 'complete'").groupBy(*keys).agg(F.max("sequence").alias("sequence"))
    return items.join(latest, [*keys, "sequence"], "left_semi")


def reusable_families(coverage: DataFrame, members: DataFrame, expected: DataFrame) -> DataFrame:
    """thread_id, family, reusable: complete, of the expected clock and count, and as many members as it says."""
    held = members.groupBy("thread_id", "family").agg(F.count("*").alias("held"))
    rows = expected.join(coverage, ["thread_id", "family"], "left").join(held, ["thread_id", "family"], "left")
    ok = (F.col("status") == "complete") & F.col("clock").eqNullSafe(F.col("expected_clock")) & (F.col("item_count") == F.col("expected_count")) & (F.coalesce("held", F.lit(0)) == F.col("item_count"))
    return rows.select("thread_id", "family", F.coalesce(ok, F.lit(False)).alias("reusable"))


HEAD_FAMILIES = ("reviews", "review_threads")


def current_for_head(coverage: DataFrame, members: DataFrame, expected: DataFrame) -> DataFrame:
    """thread_id, family, reusable: reviews and review threads that are complete, of the expected clock and pull-request head, and
    have as many members as they say.

    coverage: thread_id, family, status, clock, item_count, head_sha. expected: thread_id, family, expected_clock, current_head; a head that isn't
    known fits nothing, and other families are refused.
    """
    held = members.groupBy("thread_id", "family").agg(F.count("*").alias("held"))
    rows = expected.join(coverage, ["thread_id", "family"], "left").join(held, ["thread_id", "family"], "left")
    fits = (F.col("status") == "complete") & F.col("clock").eqNullSafe(F.col("expected_clock")) & (F.col("head_sha") == F.col("current_head")) & (F.coalesce("held", F.lit(0)) == F.col("item_count"))
    family = F.when(F.col("family").isin(*HEAD_FAMILIES), F.col("family")).otherwise(F.raise_error(F.concat(F.lit("no head belongs to "), F.col("family"))).cast("string"))
    return rows.select("thread_id", family.alias("family"), F.coalesce(fits, F.lit(False)).alias("reusable"))


def scan_window(rows: DataFrame, at: str, watermark_us: Column) -> DataFrame:
    """Rows of the next scan: from a day before the watermark on."""
    from threadloom.functions.identity import overlap_start

    return rows.where(F.col(at) >= overlap_start(watermark_us))


def advance_watermark(current: DataFrame, scans: DataFrame) -> DataFrame:
    """(key, watermark_us, sequence) after scans: only complete ones with a newer sequence move it."""
    done = scans.where("status = 'complete' AND cursor IS NULL").groupBy("key").agg(F.max_by(F.struct("watermark_us", "sequence"), "sequence").alias("n")).select("key", F.col("n.watermark_us").alias("w"), F.col("n.sequence").alias("s"))
    both = current.join(done, "key", "full_outer")
    newer = F.col("s").isNotNull() & (F.col("sequence").isNull() | (F.col("s") > F.col("sequence")))
    return both.select("key", F.when(newer, F.col("w")).otherwise(F.col("watermark_us")).alias("watermark_us"), F.when(newer, F.col("s")).otherwise(F.col("sequence")).alias("sequence"))
