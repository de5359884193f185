"""Acquisition of child families and thread scans: logs of what was asked, staged and finished, folded into states.

Arrival order is a column of each log. Every rule is an aggregate over a key or a window over one key's own log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.observations import priority

KEYS = ["thread_id", "family"]


def reservations(requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """requests (keys, source_clock, sequence) with `reserved`: strictly newer than every request before it.

    Sequences are given in order of arrival, so a request is newer unless an earlier one has a later clock.
    """
    before = Window.partitionBy(*keys).orderBy("sequence").rowsBetween(Window.unboundedPreceding, -1)
    mine = priority(F.col("source_clock"), F.col("sequence"))
    top = F.max(mine).over(before)
    return requests.withColumn("reserved", top.isNull() | (mine > top))


def current_reservations(requests: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """keys, sequence, source_clock of the request that holds each key."""
    held = F.max(priority(F.col("source_clock"), F.col("sequence")))
    return requests.groupBy(*keys).agg(held.alias("r")).select(*keys, F.col("r.sequence").alias("sequence"), F.col("r.clock").alias("source_clock"))


def staged_pages(pages: DataFrame, scope: list[str], index: str = "page_index", payload: str = "payload") -> DataFrame:
    """A row for each staged page: its payload, how often it was replayed, and conflict where a replay differs."""
    return pages.groupBy(*scope, index).agg(F.min(payload).alias(payload), (F.count("*") - 1).alias("replays"), (F.count_distinct(payload) > 1).alias("conflict"))


def finishes(results: DataFrame, held: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """results (keys, sequence, arrival, status, head_sha) with what becomes of each.

    skipped: a newer reservation holds the key; replayed: this reservation has finished before; invalid: complete
    reviews without a head; applied: it takes effect.
    """
    now = held.select(*keys, F.col("sequence").alias("_held"))
    first = F.row_number().over(Window.partitionBy(*keys, "sequence").orderBy("arrival")) == 1
    headless = F.col("family").isin("reviews", "review_threads") & (F.col("status") == "complete") & F.col("head_sha").isNull()
    what = F.when(~F.col("sequence").eqNullSafe(F.col("_held")), "skipped").when(~first, "replayed").when(headless, "invalid").otherwise("applied")
    return results.join(now, keys, "left").withColumn("disposition", what).drop("_held")


def scan_states(log: DataFrame, key: str = "repo_id") -> DataFrame:
    """The thread scan of each key after its log (key, sequence, arrival, action, threads, cursor, status).

    Actions are begin (cursor: the first page), page (threads seen; cursor: the next page or null) and finish (status).
    The newest sequence that began holds the key; a begin of an older one is rejected, as are pages after the end. A
    finish as complete with a cursor left is invalid and leaves the scan in progress.
    """
    newest = log.where("action = 'begin'").groupBy(key).agg(F.max("sequence").alias("sequence"))
    mine = log.join(newest, [key, "sequence"], "left_semi")
    own = Window.partitionBy(key, "sequence").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    began = F.max(F.when(F.col("action") == "begin", F.lit(1)).otherwise(0)).over(own) == 1
    left = F.last(F.when(F.col("action") != "finish", F.struct("cursor")), ignorenulls=True).over(own)
    rows = mine.withColumn("_began", F.coalesce(began, F.lit(False))).withColumn("_left", left["cursor"])
    ends = (F.col("action") == "finish") & F.col("_began") & ~((F.col("status") == "complete") & F.col("_left").isNotNull())
    rows = rows.withColumn("_ended", F.coalesce(F.max(F.when(ends, 1).otherwise(0)).over(own), F.lit(0)) == 1)
    page = (F.col("action") == "page") & F.col("_began") & ~F.col("_ended")
    moves = page | (F.col("action") == "begin")
    return rows.groupBy(key, "sequence").agg(
        F.count_if(page).alias("pages"), F.coalesce(F.sum(F.when(page, F.col("threads"))), F.lit(0).cast("long")).alias("threads"),
        F.max_by(F.struct("cursor"), F.when(moves, F.col("arrival")))["cursor"].alias("cursor"),
        F.coalesce(F.min_by("status", F.when(ends & ~F.col("_ended"), F.col("arrival"))), F.lit("in_progress")).alias("status"),
    )


def revisited(pages: DataFrame, scan: str = "scan", index: str = "page_index") -> DataFrame:
    """scan, page_index of pages whose next address was read before in the same scan: a walk that would not end."""
    seen = pages.select(scan, F.col("url").alias("next_url"), F.col(index).alias("_i"))
    return pages.join(seen, [scan, "next_url"]).where(F.col("_i") <= F.col(index)).select(scan, index).distinct()


def committed(steps: DataFrame, key: str = "scan") -> DataFrame:
    """key, ok: whether progress was committed in order: observations, then the cursor, then the terminal coverage."""
    at = lambda step: F.max(F.when(F.col("step") == step, F.col("arrival")))
    first = lambda step: F.min(F.when(F.col("step") == step, F.col("arrival")))
    per = steps.groupBy(key).agg(at("observation").alias("o"), first("cursor").alias("c"), at("cursor").alias("d"), first("coverage").alias("t"))
    return per.select(key, (F.coalesce(F.col("o") < F.col("c"), F.col("c").isNull()) & F.coalesce(F.col("d") < F.col("t"), F.col("t").isNull())).alias("ok"))


def units_of(scopes: DataFrame) -> DataFrame:
    """(repository, state) units of scopes: a scope that names no state is one unit for open and one for closed threads."""
    states = F.when(F.col("scope_key").isin("open", "closed"), F.array("scope_key")).otherwise(F.array(F.lit("open"), F.lit("closed")))
    return scopes.select("target", F.explode(states).alias("state")).distinct()


def outcomes(items: DataFrame, key: str = "run_id") -> DataFrame:
    """key, done, failed, outcome of items that fail one by one: a failure marks its item and the outcome, nothing else."""
    per = items.groupBy(key).agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"))
    return per.withColumn("outcome", F.when(F.col("failed") == 0, "complete").when(F.col("done") == 0, "failed").otherwise("partial"))
