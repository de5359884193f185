"""Saved generations of clusters: durable identities, memberships under local decisions, retirement.

A generation proposes clusters of one repository's threads. Each proposal takes the id of the existing cluster that it shares
most members with, one to one; others get an id by the hash of their members. Only threads that the generation saw leave other
clusters; only a complete generation removes members that its own clusters lost and retires clusters that it did not see.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.hashing import members_key
from threadloom.operators.clustering import match_identities, overlaps
from threadloom.operators.ordering import dense_index

# Fixed value: the longest title of a cluster, in bytes.
MAX_TITLE_BYTES = 16_384
HELD = ("active", "excluded")


class InvalidGeneration(ValueError):
    """A proposal that no generation may contain."""


def faults(proposed: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """fault, n of proposed(cluster, thread_id, representative, score): what makes a generation invalid.

    A thread in two clusters or twice, a representative that is no member, a score that isn't finite within [-1, 1], a title
    that is too long or a cluster of titles(cluster, title) without members.
    """
    twice = proposed.groupBy("thread_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("repeated_thread").alias("fault"))
    bad = proposed.where("score IS NOT NULL AND (isnan(score) OR score < -1 OR score > 1)").select(F.lit("score_out_of_range").alias("fault"))
    heads = proposed.groupBy("cluster").agg(F.count_if(F.col("thread_id") == F.col("representative")).alias("n"), F.count_distinct("representative").alias("heads"))
    lost = heads.where("n = 0 OR heads <> 1").select(F.lit("representative_no_member").alias("fault"))
    out = twice.unionByName(bad).unionByName(lost)
    if titles is not None:
        long_ = titles.where(F.octet_length("title") > MAX_TITLE_BYTES).select(F.lit("title_too_long").alias("fault"))
        out = out.unionByName(long_).unionByName(titles.join(proposed, "cluster", "left_anti").select(F.lit("no_members").alias("fault")))
    return out.groupBy("fault").agg(F.count("*").alias("n"))


def check(proposed: DataFrame, complete: bool, eligible: int, with_vectors: int, titles: DataFrame | None = None) -> None:
    """Raises InvalidGeneration for faults, or for a claim of complete coverage that the counts deny."""
    if with_vectors > eligible or (complete and with_vectors != eligible):
        raise InvalidGeneration("coverage")
    found = sorted(r["fault"] for r in faults(proposed, titles).collect())
    if found:
        raise InvalidGeneration(", ".join(found))


def resolved(proposed: DataFrame, clusters: DataFrame, members: DataFrame) -> DataFrame:
    """proposed with `id` and `stable_key`: that of the matched cluster, else of one with the same stable key, else a new one.

    clusters: cluster, stable_key (retired ones too). members: cluster, thread_id, state. New ids follow the largest, in order of stable keys.
    """
    held = members.where(F.col("state").isin(*HELD)).join(clusters.select("cluster"), "cluster", "left_semi")
    matched = match_identities(overlaps(proposed.select("cluster", "thread_id"), held.select("cluster", "thread_id")))
    keys = proposed.groupBy("cluster").agg(members_key(F.collect_list("thread_id")).alias("_key"))
    of = keys.join(matched.select(F.col("generated_id").alias("cluster"), F.col("existing_id").alias("_matched")), "cluster", "left")
    known = clusters.select(F.col("stable_key").alias("_key"), F.col("cluster").alias("_known"))
    of = of.join(known, "_key", "left").select("cluster", F.col("_key"), F.coalesce("_matched", "_known").alias("id"), F.col("_matched").isNotNull().alias("_old"))
    last = clusters.agg(F.coalesce(F.max("cluster"), F.lit(0)).alias("n")).first()["n"]
    new = dense_index(of.where("id IS NULL").drop("id"), ["_key"], "id", int(last) + 1)
    every = of.where("id IS NOT NULL").unionByName(new.select("cluster", "_key", F.col("id").cast("long").alias("id"), "_old"))
    own = clusters.select(F.col("cluster").alias("id"), F.col("stable_key").alias("_own"))
    every = every.join(own, "id", "left").select("cluster", "id", F.when(F.col("_old"), F.col("_own")).otherwise(F.col("_key")).alias("stable_key"))
    return proposed.join(every, "cluster")


def members_after(members: DataFrame, decisions: DataFrame, generated: DataFrame, complete: bool) -> DataFrame:
    """(cluster, thread_id, state) after a generation.

    members: cluster, thread_id, state. decisions: cluster, thread_id, excluded; a standing exclusion counts whatever the member's
    state was. generated: cluster (the durable id), thread_id.
    """
    new = generated.select("thread_id", F.col("cluster").alias("_to"))
    seen = generated.select("cluster").distinct().withColumn("_seen", F.lit(True))
    both = members.select("cluster", "thread_id", "state").join(new, "thread_id", "left").join(seen, "cluster", "left")
    lost = F.col("_to").isNotNull() | (F.lit(complete) & F.coalesce("_seen", F.lit(False)))
    state = F.when(lost & F.col("state").isin(*HELD), "removed").otherwise(F.col("state"))
    kept = both.where(~F.coalesce(F.col("_to") == F.col("cluster"), F.lit(False))).select("cluster", "thread_id", state.alias("state"))
    barred = decisions.where("excluded").select("cluster", "thread_id").distinct().withColumn("_barred", F.lit(True))
    own = generated.select("cluster", "thread_id").join(barred, ["cluster", "thread_id"], "left")
    return kept.unionByName(own.select("cluster", "thread_id", F.when(F.col("_barred"), "excluded").otherwise("active").alias("state")))


def clusters_after(clusters: DataFrame, generated: DataFrame, complete: bool, run_id: int, at_us: int) -> DataFrame:
    """(cluster, stable_key, status, representative, last_run, retired_at_us) after a generation.

    generated: cluster, stable_key, representative of every thread that it saw. Only a complete generation retires, and only active clusters.
    """
    new = generated.groupBy("cluster").agg(F.max("stable_key").alias("_key"), F.max("representative").alias("_head"))
    rows = clusters.join(new, "cluster", "full")
    seen = F.col("_key").isNotNull()
    gone = ~seen & F.lit(complete) & (F.col("status") == "active")
    return rows.select(
        "cluster", F.coalesce("stable_key", "_key").alias("stable_key"), F.when(seen, "active").when(gone, "retired").otherwise(F.col("status")).alias("status"),
        F.coalesce("_head", "representative").alias("representative"), F.when(seen, F.lit(run_id).cast("long")).otherwise(F.col("last_run")).alias("last_run"),
        F.when(gone, F.lit(at_us).cast("long")).when(~seen, F.col("retired_at_us")).alias("retired_at_us"),
    )


def save(proposed: DataFrame, clusters: DataFrame, members: DataFrame, decisions: DataFrame, complete: bool, eligible: int, with_vectors: int, run_id: int, at_us: int) -> dict[str, DataFrame]:
    """The relations after a generation: clusters, members, events (one `generated` for each cluster) and result (one row of counts)."""
    check(proposed, complete, eligible, with_vectors)
    named = resolved(proposed, clusters, members).select(F.col("id").alias("cluster"), "stable_key", "thread_id", "representative")
    after = clusters_after(clusters, named, complete, run_id, at_us)
    events = named.select("cluster").distinct().select("cluster", F.lit(run_id).cast("long").alias("run_id"), F.lit("generated").alias("event_type"), F.lit(at_us).cast("long").alias("at_us"))
    retired = after.agg(F.count_if((F.col("status") == "retired") & (F.col("retired_at_us") == at_us)).alias("retired_count"))
    result = named.agg(F.count_distinct("cluster").alias("cluster_count"), F.count("*").alias("member_count")).select(
        F.lit(run_id).cast("long").alias("run_id"), F.lit("complete" if complete else "partial").alias("status"), "cluster_count", "member_count", retired.scalar().alias("retired_count"),
    )
    return {"clusters": after, "members": members_after(members, decisions, named, complete), "events": events, "result": result}
