"""A refresh touches what changed, goes on where it stopped, and says what came of it."""

import pytest
from pyspark.sql import functions as F

from threadloom import refresh as rf
from threadloom.sources.store import Store


def services():
    """Made inside a function, so that tasks get them by value."""

    def embed(texts):
        return [[float(len(t)), float(t.count("e")), 1.0] for t in texts]

    def broken(texts):
        raise ConnectionError("no service")

    return embed, broken


embed, broken = services()


def threads(spark, *changes):
    rows = {i: (i, "h", f"r{i % 3}", i, f"o/r{i % 3}", "issue", "open", f"title {i} same words", f"body number {i % 4}", None, 100 + i) for i in range(1, 31)}
    for i, c in changes:
        rows[i] = tuple(c.get(n.split()[0], v) for n, v in zip(rf.THREAD.split(", "), rows[i]))
    return spark.createDataFrame(list(rows.values()), rf.THREAD)


@pytest.fixture
def first(spark, tmp_path):
    r = rf.Refresh.create(spark, str(tmp_path / "a"), embed, 3, threshold=0.95)
    report = r.run(threads(spark))
    assert (report.outcome, report.stages["sync"].touched, report.stages["clusters"].touched) == ("complete", 30, 3)
    return r


def table(r, name):
    return {x[0]: tuple(x) for x in r.store.read(name).collect()}


def test_a_second_run_touches_nothing(spark, first):
    before = first.store.manifest
    report = first.run(threads(spark))
    assert report.outcome == "complete" and [s.touched for s in report.stages.values()] == [0, 0, 0] and first.store.manifest == before
    assert Store(spark, first.store.path, rf.schema(3)).manifest == before


def test_one_change_goes_through_one_repository(spark, first):
    docs, vectors, members = table(first, "documents"), table(first, "vectors"), table(first, "members")
    built = table(first, "built")
    seen = spark.sparkContext.accumulator(0)
    plain = embed

    def counted(texts):
        seen.add(len(texts))
        return plain(texts)

    first.embed = counted
    report = first.run(threads(spark, (7, {"body": "another body altogether", "updated_at_us": 500})))
    assert report.outcome == "complete" and (report.stages["sync"].touched, report.stages["clusters"].touched) == (1, 1) and seen.value == 1
    assert {k for k, v in table(first, "documents").items() if v != docs[k]} == {7} and {k for k, v in table(first, "vectors").items() if v != vectors[k]} == {7}
    assert {k for k, v in table(first, "built").items() if v != built[k]} == {"o/r1"}
    assert {k for k, v in table(first, "members").items() if v != members[k]} <= {i for i in range(1, 31) if i % 3 == 1}
    # A new time alone renders anew, but embeds and clusters nothing.
    report = first.run(threads(spark, (7, {"body": "another body altogether", "updated_at_us": 501})))
    assert [s.touched for s in report.stages.values()] == [1, 1, 0] and seen.value == 1
    # Older news is no news.
    assert first.run(threads(spark, (7, {"updated_at_us": 3}))).stages["sync"].touched == 0


def test_closed_threads_leave_their_clusters(spark, first):
    assert 9 in table(first, "members")
    first.run(threads(spark, (9, {"state": "closed", "updated_at_us": 500})))
    assert 9 not in table(first, "members") and len(table(first, "members")) == 29
    every = [(i, {"state": "closed", "updated_at_us": 600}) for i in range(1, 31) if i % 3 == 0]
    first.run(threads(spark, *every))
    assert len(table(first, "members")) == 20 and table(first, "built")["o/r0"][1] == "none"
    assert first.run(threads(spark, *every)).stages["clusters"].touched == 0


def test_a_run_goes_on_after_a_failed_stage(spark, first):
    before = table(first, "vectors")
    first.embed = broken
    change = threads(spark, (5, {"body": "something new", "updated_at_us": 500}))
    report = first.run(change)
    assert (report.outcome, report.remaining) == ("partial", ("embeddings",)) and report.stages["embeddings"].status == "deferred"
    assert table(first, "vectors") == before and table(first, "documents")[5][1] != table(first, "documents")[5][2]
    first.embed = embed
    again = rf.Refresh(Store(spark, first.store.path, rf.schema(3)), embed, threshold=0.95).run(change)
    assert again.outcome == "complete" and [s.touched for s in again.stages.values()] == [0, 1, 1]
    assert rf.Refresh(Store(spark, first.store.path, rf.schema(3)), None).run(stages=("embeddings",)).outcome == "complete"


def test_stages_are_checked(spark, first):
    for stages in ((), ("sync",), ("paint",)):
        with pytest.raises(ValueError):
            first.run(stages=stages)
    first.embed = lambda texts: [[1.0]] * (len(texts) + 1)
    report = first.run(threads(spark, (5, {"body": "new", "updated_at_us": 500})), ("sync", "embeddings"))
    assert report.stages["embeddings"].status == "failed" and report.outcome == "partial" and "clusters" not in report.stages


def test_clusters_equal_a_build_from_scratch(spark, first, tmp_path):
    change = threads(spark, (4, {"body": "body number 1", "updated_at_us": 500}), (8, {"title": "see #14", "updated_at_us": 500}), (11, {"state": "closed", "updated_at_us": 500}))
    first.run(change)
    fresh = rf.Refresh.create(spark, str(tmp_path / "b"), embed, 3, threshold=0.95)
    fresh.run(change)
    assert table(first, "members") == table(fresh, "members") and table(first, "vectors") == table(fresh, "vectors")


def test_sync_from_landed_pages(spark, tmp_path):
    import json

    from threadloom.sources import landing, pages

    records = [("1", "issues", None, "open", i, json.dumps({"id": 100 + i % 3, "number": 1 + i % 3, "state": "open", "title": f"t{i}", "body": "b", "created_at": "2026-01-01T00:00:00Z", "updated_at": f"2026-01-0{1 + i}T00:00:00Z"})) for i in range(5)]
    pages.land(spark.createDataFrame(records, "repo_id string, kind string, thread_id bigint, state string, updated_at_us bigint, record string"), str(tmp_path / "l"), [F.col("updated_at_us")], per_page=2)
    r = rf.Refresh.create(spark, str(tmp_path / "a"), embed, 3)
    names = spark.createDataFrame([("1", "o/r")], "repo_id string, full_name string")
    found = landing.records(pages.read_pages(spark, str(tmp_path / "l"), "issues"), "issues")
    assert rf.sync_repositories(r, found, "h", names).stages["sync"].touched == 3
    assert {k: v[7] for k, v in table(r, "threads").items()} == {100: "t3", 101: "t4", 102: "t2"}
    assert rf.sync_repositories(r, found, "h", names).stages["sync"].touched == 0


def test_a_text_is_written_once_and_nothing_stays_staged(spark, first, tmp_path):
    """A refresh publishes the threads, then documents with their vectors in one version; a failed one keeps what it rendered."""
    held = first.store.manifest["version"]
    first.run(threads(spark, (7, {"body": "another body", "updated_at_us": 500})), ("sync", "embeddings"))
    assert first.store.manifest["version"] == held + 2
    first.embed = None
    report = first.run(threads(spark, (7, {"body": "a third", "updated_at_us": 600}), (8, {"updated_at_us": 600})), ("sync", "embeddings"))
    assert report.stages["embeddings"].status == "failed" and [table(first, "documents")[i][4] for i in (7, 8)] == [600, 600]
    first.embed = embed
    assert first.run(stages=("embeddings",)).stages["embeddings"].touched == 1 and all(d[1] == d[2] for d in table(first, "documents").values())
    assert not (tmp_path / "a" / rf.STAGED).exists()


def test_the_query_gives_no_rows_of_a_failed_refresh(spark, sf, monkeypatch):
    from threadloom.plans import store_queries  # noqa: F401
    from threadloom.plans.archive_queries import QUERIES

    def full(*_):
        raise OSError("No space left on device")

    monkeypatch.setattr(rf.Refresh, "embeddings", full)
    with pytest.raises(RuntimeError, match="No space left"):
        QUERIES["J8_J9_refresh_propagation"](spark, sf)
