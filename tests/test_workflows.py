import pytest
from pyspark.sql import functions as F

from threadloom.sources.archive import coverage, relation
from threadloom.workflows import Archive, Filters, NotFound, NoVectors


@pytest.fixture(scope="module")
def archive(spark, sf):
    names = ("threads", "comments", "chunks", "runs", "jobs")
    return Archive(**{n: relation(spark, sf, n) for n in names}, coverage=coverage(spark, sf))


def test_pages_follow_each_other(archive):
    first = archive.list_threads(Filters(repositories=("ORG/src1", "org/src1"), limit=4)).orderBy("position").collect()
    assert len(first) == 4 and first[0]["next_offset"] == 4
    seen, offset = [], 0
    while offset is not None:
        rows = archive.list_threads(Filters(repositories=("org/src1",), limit=4, offset=offset)).orderBy("position").collect()
        seen += [r["thread_id"] for r in rows]
        offset = rows[0]["next_offset"] if rows else None
    assert len(seen) == len(set(seen)) == archive.threads.where("full_name = 'org/src1'").count()


def test_unknown_names_are_errors(archive):
    with pytest.raises(NotFound):
        archive.list_threads(Filters(repositories=("org/none",)))
    with pytest.raises(NotFound):
        archive.show_thread(10**9, "org/src6")
    with pytest.raises(NotFound):
        archive.show_run(-5)


def test_search_modes_and_fallback(archive, spark):
    f = Filters(sort="relevance", limit=5)
    keyword = archive.search_threads("with", f).collect()
    assert len(keyword) == 5 and archive.search_threads("***", f).count() == 0
    vector = [float(x) for x in archive.chunks.first()["vector"]]
    assert archive.search_threads("with", f, mode="semantic", vector=vector).count() == 5
    hybrid = archive.search_threads("with", f, mode="hybrid", vector=vector).orderBy("position").collect()
    assert hybrid[0]["score"] >= hybrid[-1]["score"]
    with pytest.raises(NoVectors):
        archive.search_threads("with", f, mode="hybrid", vector=[1.0])
    again = archive.search_threads("with", f, mode="hybrid", vector=[1.0], fallback=True).collect()
    assert [r["thread_id"] for r in again] == [r["thread_id"] for r in keyword]


def test_embedding_skips_what_is_stored(archive):
    archive.embed = lambda texts: [[float(len(t)), 1.0] for t in texts]
    docs = archive.thread_documents("original_body").limit(10)
    done = archive.embed_documents(docs, 2000)
    rows = done.collect()
    assert rows and all(len(r["vector"]) == 2 for r in rows)
    assert archive.embed_documents(docs, 2000, stored=done).count() == 0


def test_clusters_status_and_ledger(archive):
    members = archive.build_clusters(0.5, 0.5, 4, 5).collect()
    assert members and max(r["size"] for r in members) <= 5
    with pytest.raises(ValueError):
        archive.build_clusters(fanout=0)
    counts, totals = archive.archive_status()
    assert counts.first()["threads"] == archive.threads.count() and totals.count() == 5
    assert archive.list_repositories().count() == 20 and archive.list_runs(3).count() == 3
    health = {r["check_name"]: r["healthy"] for r in archive.doctor().collect()}
    assert len(health) == 5 and health["archive"] == all(v for k, v in health.items() if k != "archive") and archive.recent_failures().count() <= 20
    assert archive.show_thread(7, "org/src6").count() == 1 and archive.thread_timeline(7, "org/src6").count() >= 1
    with pytest.raises(NotFound):
        archive.show_thread(7, "org/src7")
    assert archive.thread_documents("original_body").count() == archive.threads.count()


def test_retries_of_a_run(archive, spark, sf):
    from threadloom.plans.lifecycle_queries import failures

    made = failures(spark, sf).where("target <> 'not a target'")
    a = Archive(threads=archive.threads, runs=archive.runs.selectExpr("run_id", "'default' AS thread_scope", "true AS include_comments", "false AS include_reviews", "true AS include_review_threads"), jobs=archive.jobs.withColumn("repo_id", F.col("target")), extra={"failures": made})
    run = made.where("NOT resolved AND family IS NULL").first()["run_id"]
    plan = a.plan_run_retry(run).collect()
    assert plan and any(r["include_comments"] and not r["include_reviews"] and r["include_review_threads"] for r in plan)
    after, summary = a.run_retry(run, 10**9, lambda scopes: ["complete"] + ["deferred"] * (len(scopes) - 1))
    assert summary.first()["status"] == ("complete" if len(plan) == 1 else "partial")
    done = {r["failure_id"] for r in after.where("resolved AND retry_run = 1000000000").collect()}
    assert done <= {r["failure_id"] for r in after.where("retry_count = 1").collect()}
    with pytest.raises(NotFound):
        a.plan_run_retry(-1)


def test_enriched_documents_leave_stale_families_out(spark):
    threads = spark.createDataFrame([(i, "h", "r", i, "t", "b", None, "pull_request", 100, 1) for i in (1, 2, 3)], "thread_id long, host string, repo_id string, number long, title string, body string, label string, kind string, updated_at_us long, expected_comments long")
    comments = spark.createDataFrame([(i, "c", "ann", False, "hello", 5) for i in (1, 2, 3)], "thread_id long, provider_id string, author string, is_bot boolean, body string, created_at_us long")
    reviews = spark.createDataFrame([(1, "v", "bob", "APPROVED", False, "fine", 6)], "thread_id long, provider_id string, reviewer string, state string, is_bot boolean, body string, submitted_at_us long")
    states = spark.createDataFrame([(1, "comments", "complete", 100, 1, None), (2, "comments", "complete", 99, 1, None), (3, "comments", "incomplete", 100, 1, None), (1, "reviews", "complete", 100, 1, "a")], "thread_id long, family string, status string, clock_us long, item_count long, head_sha string")
    heads = spark.createDataFrame([(1, "a")], "thread_id long, head_sha string")
    a = Archive(threads=threads, comments=comments, extra={"states": states, "heads": heads, "reviews": reviews})
    got = {r["thread_id"]: r["text"] for r in a.thread_documents().collect()}
    assert got == {1: "# t\n\nb\n\nComment by ann:\n\nhello\n\nReview by bob: approved\n\nfine", 2: "# t\n\nb", 3: "# t\n\nb"}
    moved = Archive(threads=threads, comments=comments, extra={"states": states, "heads": heads.withColumn("head_sha", F.lit("z")), "reviews": reviews})
    assert "Review" not in {r["thread_id"]: r["text"] for r in moved.thread_documents().collect()}[1]
    with pytest.raises(ValueError):
        a.thread_documents("summary")


def test_cluster_requests_and_documents(spark, sf):
    from threadloom.plans import lifecycle_queries as q
    from threadloom.sources.archive import relation
    from threadloom.workflows import Archive, NotFound

    threads, clusters, members = q.board(spark, sf)
    a = Archive(threads=threads, extra={"clusters": clusters, "members": members})
    first = a.list_clusters(3).collect()
    assert [r["position"] for r in first] == [0, 1, 2] and first[0]["next_offset"] == 3
    assert [r["number"] for r in a.show_cluster(7).collect()] == [22, 23]
    with pytest.raises(NotFound):
        a.show_cluster(99_999)
    made = spark.createDataFrame([(1, 7, "exclude", "git.example", "src", 23, " off topic ", 5), (2, 7, "canonical", "git.example", "src", 23, "", 6), (3, 7, "dismiss", "git.example", "src", 1, "x" * 3000, 7), (4, 7, "dismiss", "git.example", "src", 1, "done", 8)], "seq long, cluster long, action string, host string, repo_id string, number long, reason string, at_us long")
    found, after, now, events = a.decide(made)
    assert [r["result"] for r in found.orderBy("seq").collect()] == ["ok", "member_missing", "invalid_reason", "ok"]
    one = after.where("cluster = 7").first()
    assert (one["canonical"], one["dismissal_reason"]) == (None, "done") and now.where("thread_id = 23").first()["state"] == "excluded"
    assert sorted(r["event_type"] for r in events.collect()) == ["dismissed", "member_excluded"]

    stored = spark.createDataFrame([], "document_id long, thread_id long, recipe string, recipe_version int, content_hash string, title string, source_updated_at_us long, built_at_us long")
    a = Archive(threads=relation(spark, sf, "threads"))
    new = a.materialize_documents(stored, 9, "original_body")
    assert new.where("content_changed AND written AND built_at_us = 9").count() == a.threads.count()
