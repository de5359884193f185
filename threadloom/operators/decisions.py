"""Clusters as people see and change them: lists, members and a log of decisions that is folded into the next state.

A decision is (seq, cluster, action, host, repo_id, number, reason, at_us); actions are dismiss, restore, exclude,
include and canonical. Decisions are judged in order of seq; every one that takes effect becomes an audit event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import trimmed

MAX_REASON_BYTES = 2048
# The audit event that each action leaves.
EVENTS = {"dismiss": "dismissed", "restore": "restored", "exclude": "member_excluded", "include": "member_included", "canonical": "canonical_set"}


def active_counts(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """clusters with `active`; the state is part of the join, so clusters without active members count 0."""
    live = members.where("state = 'active'").select("cluster", F.lit(1).alias("one"))
    return clusters.join(live, "cluster", "left").groupBy(*clusters.columns).agg(F.count("one").alias("active"))


def list_clusters(clusters: DataFrame, members: DataFrame, limit: int, offset: int = 0, retired: bool = False) -> DataFrame:
    """A page of clusters (cluster, status): most active members first, then the id; with position and next_offset."""
    from threadloom.operators.listing import page

    rows = clusters if retired else clusters.where("status = 'active'")
    return page(active_counts(rows, members), [F.col("active").desc(), F.col("cluster")], limit, offset)


def cluster_members(members: DataFrame, threads: DataFrame, cluster: int | None = None) -> DataFrame:
    """Active and excluded members with their thread, numbered in order of thread number within each cluster."""
    mine = members.where("state IN ('active', 'excluded')")
    mine = mine if cluster is None else mine.where(F.col("cluster") == cluster)
    rows = mine.join(threads.select("thread_id", "number", "title", "full_name", "kind"), "thread_id")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy("cluster").orderBy("number", "thread_id")))


def judged(decisions: DataFrame, clusters: DataFrame, members: DataFrame, threads: DataFrame) -> DataFrame:
    """decisions with thread_id, the trimmed reason and result: ok, or what is missing or wrong.

    clusters are (cluster, host, repo_id). A member decision names a thread of the cluster's own repository that is a
    member and not removed; canonical needs it to be active when the decision is made.
    """
    of = clusters.select("cluster", F.col("host").alias("_h"), F.col("repo_id").alias("_r"))
    at = threads.select(F.col("host").alias("_h"), F.col("repo_id").alias("_r"), F.col("number"), F.col("thread_id"))
    held = members.select("cluster", "thread_id", F.col("state").alias("_state"))
    rows = decisions.join(of, "cluster", "left").join(at, ["_h", "_r", "number"], "left").join(held, ["cluster", "thread_id"], "left")
    # The state that a member has when the decision is made: after the excludes and includes before it.
    live = F.col("_state").isNotNull() & (F.col("_state") != "removed")
    before = Window.partitionBy("cluster", "thread_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    home = (F.col("host") == F.col("_h")) & (F.col("repo_id") == F.col("_r"))
    ours = F.col("action").isin("exclude", "include")
    long_ = F.octet_length(F.coalesce("reason", F.lit(""))) > MAX_REASON_BYTES
    turned = F.when(ours & live & home & ~long_, F.when(F.col("action") == "exclude", "excluded").otherwise("active"))
    rows = rows.withColumn("_now", F.coalesce(F.last(turned, ignorenulls=True).over(before), "_state"))
    about_member = ~F.col("action").isin("dismiss", "restore")
    result = (
        F.when(long_, "invalid_reason").when(F.col("_h").isNull(), "cluster_missing").when(~about_member, "ok").when(~home, "member_missing")
        .when(F.col("thread_id").isNull(), "thread_missing").when(~live, "member_missing").when((F.col("action") == "canonical") & (F.col("_now") != "active"), "member_missing").otherwise("ok")
    )
    return rows.select(*[c for c in decisions.columns if c != "reason"], "thread_id", trimmed(F.coalesce("reason", F.lit(""))).alias("reason"), result.alias("result"))


def events_of(judged_: DataFrame) -> DataFrame:
    """The audit events of decisions that took effect."""
    kind = F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv])
    member = F.when(~F.col("action").isin("dismiss", "restore"), F.col("thread_id"))
    return judged_.where("result = 'ok'").select("seq", "cluster", F.try_element_at(kind, F.col("action")).alias("event_type"), member.alias("thread_id"), "reason", "at_us")


def members_after(members: DataFrame, events: DataFrame) -> DataFrame:
    """(cluster, thread_id, state): the last exclude or include of a member stands."""
    last = events.where("event_type IN ('member_excluded', 'member_included')").groupBy("cluster", "thread_id").agg(F.max_by("event_type", "seq").alias("_e"))
    state = F.when(F.col("_e") == "member_excluded", "excluded").when(F.col("_e") == "member_included", "active").otherwise(F.col("state"))
    return members.join(last, ["cluster", "thread_id"], "left").withColumn("state", state).drop("_e")


def clusters_after(clusters: DataFrame, events: DataFrame) -> DataFrame:
    """clusters (cluster, canonical, ...) with dismissed_at_us, dismissal_reason and canonical after the events.

    Excluding the canonical member clears it; a restore clears the dismissal but does not bring back a retired cluster.
    """
    dismissal = events.where("event_type IN ('dismissed', 'restored')").groupBy("cluster").agg(F.max_by(F.struct("event_type", "at_us", "reason"), "seq").alias("_d"))
    chosen = events.where("event_type = 'canonical_set'").groupBy("cluster").agg(F.max_by(F.struct("seq", "thread_id"), "seq").alias("_c"))
    out = events.where("event_type = 'member_excluded'").groupBy("cluster", F.col("thread_id").alias("_t")).agg(F.max("seq").alias("_gone"))
    rows = clusters.join(dismissal, "cluster", "left").join(chosen, "cluster", "left")
    rows = rows.withColumn("_t", F.coalesce("_c.thread_id", "canonical")).join(out, ["cluster", "_t"], "left")
    kept = F.col("_gone").isNull() | (F.col("_gone") < F.coalesce("_c.seq", F.lit(-1)))
    gone = F.col("_d.event_type") == "dismissed"
    return rows.select(
        *[c for c in clusters.columns if c != "canonical"], F.when(kept, F.col("_t")).alias("canonical"),
        F.when(gone, F.col("_d.at_us")).alias("dismissed_at_us"), F.when(gone, F.col("_d.reason")).otherwise("").alias("dismissal_reason"),
    )


def retired(clusters: DataFrame, seen: DataFrame) -> DataFrame:
    """clusters with the status after a complete generation: those that it did not see are retired."""
    known = seen.select("cluster").distinct().withColumn("_seen", F.lit(True))
    return clusters.join(known, "cluster", "left").withColumn("status", F.when(F.col("_seen"), "active").otherwise("retired")).drop("_seen")
