import json

import pytest

from threadloom.sources import landing
from threadloom.streaming import observations as streaming


def write(path, *rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_issue_pages(spark, tmp_path):
    issue = {"id": 9, "number": 3, "state": "open", "title": "t", "user": {"login": "a", "type": "User"}, "comments": 2, "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-02T00:00:00Z", "labels": [{"name": "x"}, {"name": "y"}], "assignees": []}
    path = write(tmp_path / "issues", issue, issue | {"id": 10, "pull_request": {"url": "u"}, "state": "strange"})
    got = landing.threads(landing.read(spark, path, "issues"), "h", "1", "o/r").orderBy("thread_id").collect()
    assert [(r["kind"], r["state"], r["label"]) for r in got] == [("issue", "open", "x, y"), ("pull_request", "strange", "x, y")]


def test_strict_pages_reject_malformed_records(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "0.json").write_text('{"id": 1, "body": "a"}\n{"id": \n')
    assert landing.read(spark, str(tmp_path / "c"), "comments").count() == 2
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        landing.read(spark, str(tmp_path / "c"), "comments", strict=True).collect()


def test_reviews_and_threads(spark, tmp_path):
    path = write(tmp_path / "r", {"id": 1, "state": "APPROVED", "commit_id": "AB" * 20, "user": {"login": "z", "type": "Bot", "id": 7}}, {"id": 2, "state": "odd", "commit_id": ""})
    got = landing.reviews(landing.read(spark, path, "reviews")).orderBy("provider_id").collect()
    assert [(r["state"], r["known_state"], r["head_sha"], r["is_bot"], r["reviewer_id"]) for r in got] == [("APPROVED", True, "ab" * 20, True, "7"), ("odd", False, None, False, None)]
    short = write(tmp_path / "s", {"id": 1, "state": "APPROVED", "commit_id": "AB"})
    with pytest.raises(Exception, match="commit"):
        landing.reviews(landing.read(spark, short, "reviews")).collect()
    node = {"id": "c1", "body": "b", "createdAt": "2026-01-01T00:00:00Z", "author": {"login": "q", "__typename": "User"}}
    good = write(tmp_path / "t", {"id": "x", "isResolved": True, "isOutdated": False, "comments": {"nodes": [node], "pageInfo": {"hasNextPage": False}}})
    said = landing.review_threads(landing.read(spark, good, "review_threads")).first()["comments"][0]
    assert (said["author"], said["is_bot"]) == ("q", False)
    for i, info in enumerate(({"hasNextPage": True, "endCursor": ""}, {"hasNextPage": True, "endCursor": "e"})):
        bad = write(tmp_path / f"u{i}", {"id": "x", "comments": {"nodes": [], "pageInfo": info}})
        with pytest.raises(Exception, match="cursor"):
            landing.review_threads(landing.read(spark, bad, "review_threads")).collect()
    more = landing.read(spark, write(tmp_path / "m", node | {"id": "c2"}), "review_thread_comments").selectExpr("'x' AS parent", "*")
    assert [c["provider_id"] for c in landing.review_threads(landing.read(spark, bad, "review_threads"), more).first()["comments"]] == ["c2"]


def test_repositories_and_pull_requests(spark, tmp_path):
    path = write(tmp_path / "p", {"id": 4, "name": "n", "owner": {"login": "o"}, "updated_at": "2026-01-01T00:00:00Z"}, {"id": 5, "name": "m", "owner": {"login": "o"}, "full_name": "o/other"})
    got = landing.repositories(landing.read(spark, path, "repositories"), "h").orderBy("repo_id").collect()
    assert [(r["repo_id"], r["full_name"], r["updated_at_us"]) for r in got] == [("4", "o/n", 1767225600000000), ("5", "o/other", None)]
    with pytest.raises(Exception, match="owner"):
        landing.repositories(landing.read(spark, write(tmp_path / "q", {"id": 4, "name": "n", "owner": {"login": ""}}), "repositories"), "h").collect()
    branch = {"ref": "main", "sha": "0A" * 32, "repo": {"id": 9}}
    path = write(tmp_path / "b", {"id": 1, "number": 3, "draft": True, "base": branch, "head": branch | {"repo": None}})
    row = landing.pull_requests(landing.read(spark, path, "pulls")).first()
    assert (row["base"]["repo_id"], row["head"]["repo_id"], row["head_sha"], row["merged"]) == ("9", None, "0a" * 32, None)


def test_times_and_numbers_of_threads_are_checked(spark, tmp_path):
    good = {"id": 9, "number": 3, "state": "open", "title": "t", "created_at": "2026-01-01T00:00:00Z", "updated_at": "2026-01-02T00:00:00Z"}
    for i, (change, what) in enumerate((({"number": 0}, "number"), ({"updated_at": "soon"}, "time"), ({"created_at": None}, "time"))):
        with pytest.raises(Exception, match=what):
            landing.threads(landing.read(spark, write(tmp_path / str(i), good | change), "issues"), "h", "1", "o/r").collect()


def test_archive_folder(spark, tmp_path):
    landing.create_archive({"runs": spark.range(3).withColumnRenamed("id", "run_id")}, str(tmp_path / "a"))
    assert landing.open_archive(spark, str(tmp_path / "a"), "runs", "run_id bigint").count() == 3
    with pytest.raises(Exception, match="exist"):
        landing.create_archive({"runs": spark.range(1)}, str(tmp_path / "a"))


def test_stream_of_late_and_repeated_observations(spark, tmp_path):
    schema = "k int, payload string, source_clock timestamp, sequence bigint"
    src, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")

    def feed(*rows):
        spark.createDataFrame(rows, "k int, payload string, c string, sequence bigint").selectExpr("k", "payload", "cast(c as timestamp) as source_clock", "sequence").write.mode("append").parquet(src)

    def run():
        streaming.start(spark.readStream.schema(schema).parquet(src), out, check, ["k"], ["payload"]).awaitTermination()
        return {r["k"]: r["payload"] for r in streaming.latest(spark, out, "k int, payload string, source_clock timestamp, sequence bigint", ["k"]).collect()}

    feed((1, "new", "2026-01-02", 2), (2, "x", None, 1))
    assert run() == {1: "new", 2: "x"}
    feed((1, "late", "2026-01-01", 9), (1, "new", "2026-01-02", 2), (2, "y", "2020-01-01", 1))
    assert run() == {1: "new", 2: "y"}
    feed((1, "newer", "2026-01-02", 3))
    assert run() == {1: "newer", 2: "y"}


def test_stateful_form(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "b", "2026-01-02", 2), (1, "a", "2026-01-01", 9), (2, "c", None, 1)]
    df = spark.createDataFrame(rows, "k int, payload string, c string, sequence bigint").selectExpr("k", "payload", "cast(c as timestamp) as source_clock", "sequence")
    df.write.parquet(src)
    stream = streaming.canonical_stateful(spark.readStream.schema(df.schema).parquet(src), ["k"], "payload")
    q = stream.writeStream.outputMode("update").format("memory").queryName("won").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["k"]: r["payload"] for r in spark.sql("SELECT * FROM won").collect()} == {1: "b", 2: "c"}
