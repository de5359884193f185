"""Landed pages as a data source, and scans as a running query."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from threadloom.sources import landing, pages
from threadloom.streaming import scans


FIRST = ("u", "u1", "v1", "a")


def page(root, repo, url, following, items, kind="issues", thread=None, body=None, first=None):
    """One landed page and its manifest."""
    name = f"{uuid.uuid4().hex}.json"
    root.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(json.dumps({"url": url, "next": following, "body": items if body is None else body}))
    times = [t for x in items if (t := pages.micros(x.get("updated_at"))) is not None]
    pages.write_manifest(str(root), [{"repo_id": repo, "kind": kind, "thread_id": thread, "url": url, "next": following, "first": url in FIRST if first is None else first, "file": name, "items": len(items), "states": sorted({x.get("state") for x in items if x.get("state")}), "newest_us": max(times, default=None)}])
    return root / name


def issue(n, state="open", day=1):
    return {"id": 100 + n, "number": n, "state": state, "title": f"t{n}", "body": "b", "created_at": "2026-01-01T00:00:00Z", "updated_at": f"2026-01-{day:02d}T00:00:00Z"}


def numbers(df):
    return sorted(json.loads(r["record"])["number"] for r in df.collect())


def test_chains_follow_next_addresses(spark, tmp_path):
    root = tmp_path / "l"
    page(root, "r", "u2", "u3", [issue(2)])
    page(root, "r", "u1", "u2", [issue(1), issue(11)])
    page(root, "q", "u1", None, [issue(5)])
    page(root, "r", "u1", "u2", [issue(99)])  # landed again: it counts as it landed first
    rows = pages.read_pages(spark, str(root), "issues").collect()
    assert sorted((r["repo_id"], r["page_index"], r["item_index"], json.loads(r["record"])["number"]) for r in rows) == [("q", 0, 0, 5), ("r", 0, 0, 1), ("r", 0, 1, 11), ("r", 1, 0, 2)]
    assert numbers(pages.read_pages(spark, str(root), "issues", repo_id="q")) == [5]
    assert pages.read_pages(spark, str(root), "comments").collect() == []
    assert pages.read_pages(spark, str(tmp_path / "nothing"), "issues").collect() == []


@pytest.mark.parametrize("links", [[("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "b")]])
def test_chains_that_come_back_are_refused(spark, tmp_path, links):
    for url, following in links:
        page(tmp_path / "l", "r", url, following, [issue(1)])
    with pytest.raises(Exception, match="come back"):
        pages.read_pages(spark, str(tmp_path / "l"), "issues").collect()


def test_filters_close_pages(spark, tmp_path):
    """Pages that hold nothing wanted are never opened: theirs are broken here."""
    root = tmp_path / "l"
    page(root, "r", "u1", "u2", [issue(1, day=9), issue(2, "closed", 8)])
    page(root, "r", "u2", "u3", [issue(3, "closed", 7)]).write_text("{")
    page(root, "r", "u3", None, [issue(4, day=3), issue(5, day=2)])
    since = pages.micros("2026-01-03T00:00:00Z")
    assert numbers(pages.read_pages(spark, str(root), "issues", "open")) == [1, 4, 5]
    assert numbers(pages.read_pages(spark, str(root), "issues", "open", since)) == [1, 4]
    every = spark.read.format("landed_pages").option("path", str(root)).load()
    with pytest.raises(Exception, match="not JSON"):
        every.collect()
    with pytest.raises(Exception, match="state"):
        pages.read_pages(spark, str(root), "issues", "ajar").collect()


def test_pages_with_errors_are_refused(spark, tmp_path):
    nodes = {"data": {"repository": {"pullRequest": {"reviewThreads": {"nodes": [{"id": "x"}, {"id": "y"}]}}}}}
    page(tmp_path / "a", "r", "u", None, [], "review_threads", 4, nodes)
    got = pages.read_pages(spark, str(tmp_path / "a"), "review_threads").collect()
    assert [(r["thread_id"], json.loads(r["record"])["id"]) for r in got] == [(4, "x"), (4, "y")]
    for name, body in (("b", nodes | {"errors": [{"message": "no"}]}), ("c", {"data": None}), ("d", "text")):
        page(tmp_path / name, "r", "u", None, [], "review_threads", 4, body)
        with pytest.raises(Exception, match="GraphQL|neither"):
            pages.read_pages(spark, str(tmp_path / name), "review_threads").collect()


def test_strict_records(spark, tmp_path):
    page(tmp_path / "l", "r", "u", None, [issue(1) | {"number": "seven"}])
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        landing.records(pages.read_pages(spark, str(tmp_path / "l"), "issues"), "issues").collect()


def test_a_stream_reads_each_page_once_across_restarts(spark, tmp_path):
    root, out, check = tmp_path / "l", str(tmp_path / "out"), str(tmp_path / "check")

    def run():
        q = pages.stream_pages(spark, str(root), "issues").writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start()
        q.awaitTermination()
        return numbers(spark.read.schema(pages.SCHEMA).parquet(out))

    page(root, "r", "u1", "u2", [issue(1)])
    page(root, "s", "u1", None, [issue(2)])
    page(root, "r", "u3", None, [issue(4)])  # its predecessor hasn't landed
    first = run()
    page(root, "r", "u2", "u3", [issue(3)])
    page(root, "r", "u1", "u2", [issue(1)])
    page(root, "t", "v1", None, [issue(5), issue(6)])
    assert first == [1, 2] and run() == [1, 2, 3, 4, 5, 6] and run() == [1, 2, 3, 4, 5, 6]


def test_land_writes_linked_pages(spark, tmp_path):
    rows = spark.createDataFrame([("r", "issues", None, "open", i, json.dumps({"number": i, "state": "open"})) for i in range(23)] + [("s", "comments", 7, None, None, json.dumps({"number": 100}))], "repo_id string, kind string, thread_id bigint, state string, updated_at_us bigint, record string")
    pages.land(rows, str(tmp_path / "l"), [F.col("updated_at_us").desc()], per_page=5)
    found = pages.manifest(str(tmp_path / "l"))
    assert sorted((p["repo_id"], p["items"], p["next"] is None) for p in found) == [("r", 3, True)] + [("r", 5, False)] * 4 + [("s", 1, True)]
    got = pages.read_pages(spark, str(tmp_path / "l"), "issues").collect()
    assert [json.loads(r["record"])["number"] for r in sorted(got, key=lambda r: (r["page_index"], r["item_index"]))] == list(range(22, -1, -1))
    pages.land(rows.limit(0), str(tmp_path / "l"), [F.col("record")])
    assert len(pages.manifest(str(tmp_path / "l"))) == 6


def test_an_aborted_write_leaves_nothing(tmp_path):
    writer = pages.PageWriter({"path": str(tmp_path)})
    row = {"repo_id": "r", "kind": "issues", "thread_id": None, "url": "u", "next": None, "first": True, "state": "open", "updated_at_us": 1, "record": "{}"}
    message = writer.write(iter([row]))
    assert pages.manifest(str(tmp_path)) == []
    writer.abort([message, None])
    assert not list(tmp_path.rglob("*.json"))


def test_short_chains_share_partitions(spark, tmp_path):
    rows = spark.range(300).selectExpr("'r' AS repo_id", "'pulls' AS kind", "id AS thread_id", "cast(NULL AS string) AS state", "cast(NULL AS bigint) AS updated_at_us", "to_json(named_struct('number', id)) AS record")
    pages.land(rows, str(tmp_path / "l"), [F.col("record")])
    read = pages.read_pages(spark, str(tmp_path / "l"), "pulls")
    assert read.rdd.getNumPartitions() == 1
    got = [(r["thread_id"], r["page_index"], json.loads(r["record"])["number"], r["url"].split("/")[-2]) for r in read.collect()]
    assert sorted(got) == [(i, 0, i, str(i)) for i in range(300)]


def test_long_chains_are_split_and_pages_of_unknown_size_count_whole():
    at = lambda n, kind, thread, **more: [(i, {"repo_id": "r", "kind": kind, "thread_id": thread, "url": f"u{i}", "file": "f", **more}) for i in range(n)]
    parts = pages.partitions_of([at(5, "a", 1), at(1, "b", 2), [], at(3, "c", 3, at=0, bytes=10), at(1, "d", 4, at=0, bytes=3 * pages.PAGE_BYTES), at(1, "e", 5, at=0, bytes=1)], 2)
    assert [[(r.thread_id, [p[0] for p in r.pages]) for r in x.runs] for x in parts] == [[(1, [0, 1])], [(1, [2, 3])], [(1, [4]), (2, [0])], [(3, [0, 1, 2])], [(4, [0])], [(5, [0])]]


def test_pages_of_a_task_lie_in_one_file(spark, tmp_path):
    """Texts with line ends and letters of several bytes, in pages of three kinds and two repositories."""
    writer, rows = pages.PageWriter({"path": str(tmp_path)}), []
    for repo, kind in (("q", "comments"), ("r", "comments"), ("r", "review_threads")):
        for thread in range(4):
            rows += [{"repo_id": repo, "kind": kind, "thread_id": thread, "url": f"u{i // 2}", "next": "u1" if i < 2 else None, "first": i < 2, "state": None, "updated_at_us": None, "record": json.dumps({"body": f"é\n{thread}.{i}"})} for i in range(3)]
    writer.commit([writer.write(iter(rows))])
    assert len(pages.manifest(str(tmp_path))) == 24 and len(list(tmp_path.rglob("*.json"))) == 3
    for kind, repos in (("comments", ("q", "r")), ("review_threads", ("r",))):
        got = pages.read_pages(spark, str(tmp_path), kind).collect()
        want = [(repo, t, i // 2, i % 2, f"é\n{t}.{i}") for repo in repos for t in range(4) for i in range(3)]
        assert sorted((r["repo_id"], r["thread_id"], r["page_index"], r["item_index"], json.loads(r["record"])["body"]) for r in got) == want
    assert {p["kind"] for p in pages.manifest(str(tmp_path), pages.scope_of({"kind": "comments", "repo_id": "q"}))} == {"comments"}
    writer.abort([writer.write(iter(rows))])
    assert len(list(tmp_path.rglob("*.json"))) == 3


# Scans

EVENTS = "repo_id bigint, sequence bigint, arrival bigint, action string, threads bigint, cursor string, status string, at_us bigint"


def log_of(seed, n):
    rng = random.Random(seed)
    return [(rng.randrange(4), rng.randrange(5), i, rng.choice(("begin", "page", "page", "page", "finish")), rng.randrange(9), rng.choice((None, f"p{rng.randrange(6)}")), rng.choice(("complete", "incomplete")), i * 10) for i in range(n)]


def run_stream(spark, tmp_path, rows, deal):
    base = str(tmp_path)
    for part in deal:
        spark.createDataFrame([rows[i] for i in part], EVENTS).coalesce(1).write.mode("append").parquet(f"{base}/log")
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    scans.start(stream, f"{base}/states", f"{base}/check").awaitTermination()
    return f"{base}/states"


@pytest.mark.parametrize("seed", [1, 2])
def test_reordered_and_repeated_batches_end_as_the_batch_fold(spark, tmp_path, seed):
    rows = log_of(seed, 160)
    rng = random.Random(seed)
    order = list(range(len(rows))) + rng.sample(range(len(rows)), 40)
    rng.shuffle(order)
    states = run_stream(spark, tmp_path, rows, [order[i::3] for i in range(3)])
    got = {r["repo_id"]: r.asDict() for r in scans.latest(spark, states).collect()}
    want = {r["repo_id"]: r.asDict() for r in scans.batch_states(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == want


def test_scans_go_on_after_a_restart(spark, tmp_path):
    first = [(1, 1, 0, "begin", None, "u1", None, 5), (1, 1, 1, "page", 3, "u2", None, 6)]
    states = run_stream(spark, tmp_path, first, [[0, 1]])
    assert scans.latest(spark, states).first()["status"] == "in_progress"
    more = [(1, 1, 1, "page", 3, "u2", None, 6), (1, 1, 3, "finish", None, None, "complete", 8), (1, 1, 2, "page", 4, None, None, 7)]
    run_stream(spark, tmp_path, more, [[1], [0, 2]])
    row = scans.latest(spark, states).first()
    assert (row["pages"], row["threads"], row["cursor"], row["status"], row["watermark_us"]) == (2, 7, None, "complete", 5)


def test_a_walk_that_comes_back(spark):
    event = lambda at, action, cursor, status=None: {"arrival": at, "action": action, "threads": 1, "cursor": cursor, "status": status, "at_us": at}
    scan = scans.folded([event(0, "begin", "a"), event(1, "page", "b"), event(2, "page", "a"), event(3, "page", "b"), event(4, "finish", None, "complete"), event(5, "finish", None, "incomplete"), event(6, "page", None)])
    assert (scan["pages"], scan["revisited"], scan["cursor"], scan["status"]) == (3, 2, "b", "incomplete")
    assert scans.folded([event(0, "page", "a")]) is None
