"""Runs, jobs and failures: outcomes, diagnostics and retry plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.sources.archive import FAMILIES


def run_outcomes(jobs: DataFrame) -> DataFrame:
    """run_id, jobs, failed, deferred, interrupted, outcome: interrupted > partial > deferred > failed > complete."""
    per = jobs.groupBy("run_id").agg(F.count("*").alias("jobs"), *[F.count_if(F.col("status") == s).alias(s) for s in ("failed", "deferred", "interrupted")])
    troubled = F.col("failed") + F.col("deferred")
    outcome = (
        F.when(F.col("interrupted") > 0, "interrupted").when(troubled == 0, "complete").when(F.col("jobs") > troubled, "partial").when(F.col("failed") == 0, "deferred").otherwise("failed")
    )
    return per.withColumn("outcome", outcome)


def refresh_outcomes(stages: DataFrame, key: str = "refresh_id") -> DataFrame:
    """key, outcome, pending_items, failed_items, deferred_items, remaining of refreshes made of stages (key, stage, position, status).

    All complete is complete; an interrupted stage makes the whole interrupted, with every unfinished stage pending; any other
    unfinished one makes it partial, whatever the rest did. remaining names the unfinished stages in order of position.
    """
    open_ = F.col("status") != "complete"
    per = stages.groupBy(key).agg(
        F.count_if(open_).alias("_open"), F.count_if(F.col("status") == "interrupted").alias("_stopped"), F.count_if(F.col("status") == "deferred").alias("_deferred"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(open_, F.struct("position", "stage")))), lambda x: x["stage"]), ",").alias("remaining"),
    )
    outcome = F.when(F.col("_open") == 0, "complete").when(F.col("_stopped") > 0, "interrupted").otherwise("partial")
    rows = per.withColumn("outcome", outcome)
    partial = F.col("outcome") == "partial"
    return rows.select(key, "outcome", F.when(F.col("outcome") == "interrupted", F.col("_open")).alias("pending_items"), F.when(partial, F.col("_open")).alias("failed_items"), F.when(partial, F.col("_deferred")).alias("deferred_items"), "remaining")


def retry_summaries(outcomes: DataFrame, key: str) -> DataFrame:
    """key, runs, status of retried runs (key, outcome): one that all share, interrupted where any was, else partial."""
    all_ = lambda s: F.bool_and(F.col("outcome") == s)
    status = F.when(all_("complete"), "complete").when(F.bool_or(F.col("outcome") == "interrupted"), "interrupted").when(all_("failed"), "failed").when(all_("deferred"), "deferred").otherwise("partial")
    return outcomes.groupBy(key).agg(F.count("*").alias("runs"), status.alias("status"))


def diagnostics(runs: DataFrame, jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Five counts of work; the unresolved failures of each family are unresolved_by_family()."""
    j = jobs.agg(F.count_if(F.col("status") == "failed").alias("failed_jobs"), F.count_if(F.col("status") == "deferred").alias("deferred_jobs"))
    r = runs.agg(F.count_if(F.col("status") == "in_progress").alias("in_progress_runs"))
    f = failures.where("NOT resolved").agg(F.count_if(F.col("family").isNull()).alias("unassigned_failures"), F.count("*").alias("unresolved_failures"))
    one = lambda df: df.select(F.struct("*")).scalar()
    return j.select("*", one(r).alias("r"), one(f).alias("f")).select("failed_jobs", "deferred_jobs", "r.*", "f.*")


def unresolved_by_family(jobs: DataFrame) -> DataFrame:
    """family, unresolved; families without failures count 0 and unknown labels are left out."""
    names = jobs.sparkSession.createDataFrame([(f,) for f, _ in FAMILIES], "family string")
    counted = jobs.where("status = 'failed' AND NOT resolved").groupBy("family").agg(F.count("*").alias("n"))
    return names.join(counted, "family", "left").select("family", F.coalesce("n", F.lit(0).cast("long")).alias("unresolved"))


def latest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(limit)


def recent_failures(runs: DataFrame, scan: int = 50, detail: int = 20) -> DataFrame:
    """Unfinished ones among the latest runs: the scan is cut first, then filtered, then cut again."""
    return latest_runs(runs, scan).where("status <> 'complete'").orderBy(F.col("started_at").desc(), F.col("run_id").desc()).limit(detail)


def selected_failures(failures: DataFrame, families: list[str] | None = None) -> DataFrame:
    """The unresolved failures of the families named, or of all."""
    out = failures.where("NOT resolved")
    return out.where(F.col("family").isin(families)) if families else out


# The scope keys that name a thread state; any other leaves the run's own scope.
THREAD_SCOPES = ("open", "closed", "all")


def retry_scopes(failures: DataFrame, jobs: DataFrame, runs: DataFrame, families: list[str] | None = None) -> DataFrame:
    """run_id, repository, scope, include_comments, include_reviews, include_review_threads, failure_ids of what to run again.

    failures: failure_id, run_id, repository, target, family, scope_key, resolved. runs: run_id, thread_scope and the three flags that the
    run was asked for. A failure of a child family asks for that family alone, one without a family for what its run asked for; flags of
    one repository and scope are joined. A failure whose repository can't be told is an error.
    """
    asked = runs.select("run_id", F.col("thread_scope").alias("_scope"), *[F.col(f"include_{f}").alias(f"_{f}") for f in ("comments", "reviews", "review_threads")])
    rows = repository_of_failures(selected_failures(failures, families), jobs).join(asked, "run_id")
    lost = F.raise_error(F.concat(F.lit("no repository for the failed target "), F.col("target"))).cast("string")
    repository = F.when(F.col("found").isNull(), lost).otherwise(F.col("found"))
    scope = F.when(F.col("scope_key").isin(*THREAD_SCOPES), F.col("scope_key")).otherwise(F.col("_scope"))
    flag = lambda f: F.bool_or(F.when(F.col("family").isNull(), F.col(f"_{f}")).otherwise(F.col("family") == f)).alias(f"include_{f}")
    per = rows.groupBy("run_id", repository.alias("repository"), scope.alias("scope"))
    return per.agg(flag("comments"), flag("reviews"), flag("review_threads"), F.sort_array(F.collect_list("failure_id")).alias("failure_ids"))


def _touched(failures: DataFrame, scopes: DataFrame, run_id: int) -> DataFrame:
    """failures with _hit: the unresolved ones of other runs whose scope is among scopes.

    A scope without a repository is a selector's: target, family and scope key count. One with a repository is a thread's: repository,
    thread, family and scope key count, and the target does not. Failures without a family are touched by neither.
    """
    of_thread = F.col("repository").isNotNull()
    key = F.when(of_thread, F.struct(F.lit("thread").alias("kind"), F.concat_ws("#", "repository", F.col("thread").cast("string")).alias("on"), "family", "scope_key")).otherwise(F.struct(F.lit("selector").alias("kind"), F.col("target").alias("on"), "family", "scope_key"))
    whole = F.col("family").isNotNull() & (~of_thread | F.col("thread").isNotNull())
    hit = scopes.where(whole).select(key.alias("_key")).distinct().withColumn("_found", F.lit(True))
    rows = failures.withColumn("_key", F.when(whole, key)).join(hit, "_key", "left")
    return rows.withColumn("_hit", F.coalesce("_found", F.lit(False)) & ~F.col("resolved") & (F.col("run_id") != run_id)).drop("_key", "_found")


def mark_retried(failures: DataFrame, scopes: DataFrame, run_id: int) -> DataFrame:
    """failures with retry_count + 1 and this run where an unresolved one of another run has a scope that is retried.

    Both have repository, thread, target, family and scope_key; see _touched for what makes scopes equal.
    """
    rows = _touched(failures, scopes, run_id)
    return rows.withColumn("retry_count", F.col("retry_count") + F.col("_hit").cast("int")).withColumn("retry_run", F.when(F.col("_hit"), F.lit(run_id)).otherwise(F.col("retry_run"))).drop("_hit")


def resolve(failures: DataFrame, done: DataFrame, run_id: int) -> DataFrame:
    """failures with earlier unresolved ones of the scopes done marked resolved; the run that retried one first stays."""
    rows = _touched(failures, done, run_id)
    return rows.withColumn("resolved", F.col("resolved") | F.col("_hit")).withColumn("retry_run", F.when(F.col("_hit"), F.coalesce("retry_run", F.lit(run_id))).otherwise(F.col("retry_run"))).drop("_hit")


def repository_of_failures(failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """failures with `found`: their own repository, else that of the first fitting job of the run, else their target
    where it reads as owner/name; null where none does. Failures that are equal in all columns each stay a row."""
    mine = jobs.select("run_id", F.col("target").alias("_target"), F.col("family").alias("_family"), F.col("scope_key").alias("_scope"), F.col("job_no").alias("_job"), F.col("repo_id").alias("_repo"))
    asked = ["run_id", "target", "family", "scope_key"]
    fitting = failures.where("repository IS NULL").select(*asked).distinct().alias("f").join(
        mine.alias("j"),
        (F.col("f.run_id") == F.col("j.run_id")) & (F.col("f.target") == F.col("_target")) & (F.col("f.family").isNull() | (F.col("f.family") == F.col("_family"))) & ((F.col("f.scope_key") == "") | (F.col("f.scope_key") == F.col("_scope"))),
    )
    first = fitting.groupBy(*[F.col(f"f.{c}").alias(f"_{c}_of") for c in asked]).agg(F.min_by("_repo", "_job").alias("_repo"))
    rows = failures.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}_of")) for c in asked], "left")
    parsed = F.when(F.col("target").rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+$"), F.col("target"))
    return rows.select(*failures.columns, F.coalesce("repository", "_repo", parsed).alias("found"))


def jobs_of_repositories(jobs: DataFrame, repositories: DataFrame) -> DataFrame:
    """jobs with the host and id of their repository; jobs of an unknown one are left out."""
    return jobs.join(repositories.select(F.col("full_name").alias("target"), "host", "repo_id"), "target")


def run_states(log: DataFrame) -> DataFrame:
    """The state of each run after its log (run_id, arrival, action, status, parent): it is finished once, by the first finish."""
    created = F.min(F.when(F.col("action") == "create", F.col("arrival")))
    first = log.groupBy("run_id").agg(created.alias("_c"))
    rows = log.join(first, "run_id").where("_c IS NOT NULL AND arrival >= _c")
    end = F.when(F.col("action") == "finish", F.col("arrival"))
    return rows.groupBy("run_id").agg(
        F.min("_c").alias("started_at"), F.min(end).alias("finished_at"), F.coalesce(F.min_by("status", end), F.lit("in_progress")).alias("status"),
        F.min_by("parent", F.when(F.col("action") == "create", F.col("arrival"))).alias("parent"),
    )


def refused(log: DataFrame) -> DataFrame:
    """run_id, arrival of finishes that find no run in progress."""
    from pyspark.sql import Window

    before = Window.partitionBy("run_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda a: F.coalesce(F.max(F.when(F.col("action") == a, 1).otherwise(0)).over(before), F.lit(0))
    rows = log.withColumn("_c", seen("create")).withColumn("_f", F.coalesce(F.max(F.when((F.col("action") == "finish") & (F.col("_c") == 1), 1).otherwise(0)).over(before), F.lit(0)))
    return rows.where("action = 'finish' AND (_c = 0 OR _f = 1)").select("run_id", "arrival")


def first_failures(failures: DataFrame, key: str = "run_id") -> DataFrame:
    """key and the first failure of each category: hard, and deferred (rate limits)."""
    at = lambda hard: F.when((F.col("kind") != "rate_limited") == hard, F.col("arrival"))
    return failures.groupBy(key).agg(F.min_by("kind", at(True)).alias("hard"), F.min_by("kind", at(False)).alias("deferred"))


# What a process ends with for an outcome.
EXIT_CODES = {"complete": 0, "partial": 3, "deferred": 3, "failed": 1, "interrupted": 130}


def exit_code(outcome):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in EXIT_CODES.items() for x in kv]), outcome)


def job_rows(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs with their runs, and the outcome of the run."""
    return jobs.join(runs.withColumnRenamed("status", "run_status"), "run_id")
