import pytest

from threadloom.plans import lifecycle_queries  # noqa: F401
from threadloom.plans.archive_queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(QUERIES[name], SQL[name])


def test_chunks_cover_their_text(spark, sf):
    from threadloom.functions.text import chunk_text
    from threadloom.operators.documents import render
    from threadloom.sources.archive import relation

    want = set()
    for r in render(relation(spark, sf, "threads")).collect():
        parts = chunk_text(r["text"], 2000)
        assert "".join("".join(parts).split()) == "".join(r["text"].split())
        want |= {(r["thread_id"], i, len(parts), len(p.encode())) for i, p in enumerate(parts)}
    got = QUERIES["H14_H15_chunks"](spark, sf).collect()
    assert {(r["thread_id"], r["chunk_index"], r["chunk_count"], r["bytes"]) for r in got} == want
    assert all(n <= 2000 for *_, n in want)


def test_pending_chunks_are_those_not_stored(spark, sf):
    assert {r["thread_id"] % 2 for r in QUERIES["C18_pending_chunks"](spark, sf).collect()} == {1}


def test_requests_keep_their_budgets(spark, sf):
    from collections import Counter

    rows = QUERIES["F19_request_batches"](spark, sf).collect()
    counts = Counter((r["full_name"], r["request"]) for r in rows)
    assert max(counts.values()) <= 16
    by = {}
    for r in sorted(rows, key=lambda r: (r["full_name"], r["thread_id"], r["chunk_index"])):
        assert r["request"] - by.get(r["full_name"], 0) in (0, 1)
        by[r["full_name"]] = r["request"]


def test_components_match_a_plain_fold(spark, sf):
    from threadloom.plans.archive_queries import MOST, _near

    t, near = _near(spark, sf)
    edges = {}
    for r in near.collect():
        k = (min(r["a"], r["b"]), max(r["a"], r["b"]))
        edges[k] = max(edges.get(k, -1), r["score"])
    group = {r["thread_id"]: {r["thread_id"]} for r in t.collect()}
    for (a, b), _ in sorted(edges.items(), key=lambda e: (-e[1], e[0])):
        if group[a] is not group[b] and len(group[a]) + len(group[b]) <= MOST:
            joined = group[a] | group[b]
            for n in joined:
                group[n] = joined
    got = {r["thread_id"]: r["cluster"] for r in QUERIES["D18_D9_components"](spark, sf).collect()}
    assert got == {n: min(g) for n, g in group.items()}


def test_identity_matching_is_greedy(spark, sf):
    from fractions import Fraction

    pairs = QUERIES["C17_identity_overlap"](spark, sf).collect()
    want, used = {}, set()
    for p in sorted(pairs, key=lambda p: (-p["overlap"], -Fraction(p["overlap"], p["union_size"]), p["existing_id"], p["generated_id"])):
        if p["generated_id"] not in want and p["existing_id"] not in used:
            want[p["generated_id"]] = p["existing_id"]
            used.add(p["existing_id"])
    assert {r["generated_id"]: r["existing_id"] for r in QUERIES["E7_identity_matching"](spark, sf).collect()} == want


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
