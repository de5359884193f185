"""Unions in order under a cap, request cuts, neighbours with references, and saved generations, each against a plain fold."""

import random

import numpy as np
import pytest

from threadloom.operators import clustering, generations, requests
from threadloom.operators.bounded_union import bounded_union

EDGES = "a bigint, b bigint, score double"


def plain_union(edges, most):
    label, members, kept = {}, {}, set()
    for a, b, s in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        for n in (a, b):
            if n not in label:
                label[n], members[n] = n, [n]
        x, y = label[a], label[b]
        if x != y:
            if len(members[x]) + len(members[y]) > most:
                continue
            x, y = min(x, y), max(x, y)
            for n in members[y]:
                label[n] = x
            members[x] += members.pop(y)
        kept.add((a, b, s))
    return label, kept


def check(spark, edges, most, fold):
    labels, kept = bounded_union(spark.createDataFrame(edges, EDGES), most, fold)
    want, held = plain_union(edges, most)
    assert {r["node"]: r["label"] for r in labels.collect()} == want
    assert {tuple(r) for r in kept.collect()} == held


def some_edges(seed, nodes, n, scores):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(nodes), 2))) for _ in range(n)}
    return [(a, b, scores(rng, a, b)) for a, b in pairs]


@pytest.mark.parametrize(("most", "fold"), [(5, 20), (40, 15), (2, 200), (1, 50)])
def test_unions_of_random_edges(spark, most, fold):
    check(spark, some_edges(most, 90, 260, lambda r, a, b: r.random()), most, fold)


def test_unions_of_tied_scores_and_a_hub(spark):
    edges = some_edges(3, 60, 120, lambda r, a, b: float(r.randint(1, 3)))
    edges += [(500, 600 + i, 2.0) for i in range(150)]
    check(spark, edges, 7, 40)


def test_unions_along_a_falling_path(spark):
    """Each union waits for the one before it: the case that only the fold of the first edges shortens."""
    check(spark, [(i, i + 1, 1 - i / 10_000) for i in range(900)], 6, 150)


def test_one_large_component(spark):
    rng = np.random.default_rng(2)
    n = 30_000
    edges = [(i, i + 1, float(s)) for i, s in enumerate(rng.random(n))] + [(i, i + 7, float(s)) for i, s in enumerate(rng.random(n))]
    check(spark, edges, 40, 10_000)


def test_unions_of_nothing(spark):
    labels, kept = bounded_union(spark.createDataFrame([(1, 1, 0.5)], EDGES), 5, 10)
    assert labels.collect() == [] and kept.collect() == []
    labels, kept = bounded_union(spark.createDataFrame([(1, 2, None), (2, 3, 0.1)], EDGES), 2, 10)
    assert {tuple(r)[:2] for r in kept.collect()} == {(2, 3)}


def test_components_have_links_and_loners(spark):
    threads = spark.createDataFrame([(i,) for i in range(1, 25)], "thread_id bigint")
    edges = [(i, i + 1, 0.9 - i / 1000) for i in range(1, 12)] + [(20, 21, 0.5), (21, 22, 0.6)]
    got = {r["thread_id"]: (r["cluster"], r["degree"]) for r in clustering.bounded_components(threads, spark.createDataFrame(edges, EDGES), 5, 4).collect()}
    label, kept = plain_union(edges, 5)
    assert got == {n: (label.get(n, n), sum(n in e[:2] for e in kept)) for n in range(1, 25)}


# Request cuts


def plain_requests(sizes, most, most_bytes):
    out, request, count, held = [], 0, 0, 0
    for n in sizes:
        if count and (count >= most or held + n > most_bytes):
            request, count, held = request + 1, 0, 0
        count, held = count + 1, held + n
        out.append(request)
    return out


@pytest.mark.parametrize(("most", "most_bytes", "block"), [(4, 30, 5), (3, 9, 16), (1, 5, 2), (7, 10_000, 8), (16, 60, 64)])
def test_requests_equal_the_fold(spark, most, most_bytes, block):
    rng = random.Random(block)
    rows = []
    for group, n in (("hot", 700), ("b", 3), ("c", block), ("d", block + 1), ("e", 2 * block), (None, 11)):
        rows += [(group, t // 3, t % 3, "x" * rng.choice((0, 1, 5, 11, 29, 80))) for t in range(n)]
    rows[5] = (*rows[5][:3], None)
    chunks = spark.createDataFrame([(*r, "z", 1) for r in rng.sample(rows, len(rows))], "g string, thread_id bigint, chunk_index int, chunk string, request_note string, _i int")
    got = {(r["g"], r["thread_id"], r["chunk_index"]): r["request"] for r in requests.request_batches(chunks, "g", most, most_bytes, block).collect()}
    assert len(got) == len(rows)
    for group in {r[0] for r in rows}:
        own = sorted(r for r in rows if r[0] == group) if group != "hot" else sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1:3])
        assert [got[r[:3]] for r in own] == plain_requests([len(r[3] or "") for r in own], most, most_bytes)


def test_requests_of_nothing_and_bad_bounds(spark):
    none = spark.createDataFrame([], "g string, thread_id bigint, chunk_index int, chunk string")
    assert requests.request_batches(none, "g", 4, 10).collect() == []
    with pytest.raises(ValueError):
        requests.request_batches(none, "g", 0, 10)
    with pytest.raises(ValueError):
        requests.request_batches(none, "g", 10, 10, 10)


# Evidence


def vector(x):
    return [float(np.cos(x)), float(np.sin(x))]


def test_references_take_and_lose_places(spark):
    """A mention scores 0.94 among the similarities: with one place a thread it pushes a weaker neighbour out and loses to a stronger one."""
    at = {1: 0.0, 11: float(np.arccos(0.92)), 12: 2.0, 14: float(np.arccos(0.92)) + float(np.arccos(0.999)), 30: 1.0}
    threads = spark.createDataFrame([(i, "o/r", "issue", "same words here") for i in [*at, 31]], "thread_id bigint, full_name string, kind string, title string")
    chunks = spark.createDataFrame([(i, 0, vector(x)) for i, x in at.items()], "thread_id bigint, chunk_index int, vector array<double>")
    mentions = spark.createDataFrame([(1, 12, 0.94), (30, 31, 0.94)], EDGES)
    near = clustering.neighbours(threads, chunks, 0.3, 0.3, 1, mentions)
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in clustering.candidate_edges(near).collect()}
    # 11 and 14 choose each other, 1 and 12 by the mention; 30 has its nearest. 31 has no vectors, so its mention is no evidence.
    assert got[1, 12] == 0.94 and got[11, 14] == 0.999 and (1, 11) not in got and not any(31 in k for k in got)


def test_references_and_similarities_keep_the_larger(spark):
    threads = spark.createDataFrame([(1, "o/r", "issue", "a"), (2, "o/r", "issue", "b"), (3, "o/r", "pull_request", "c")], "thread_id bigint, full_name string, kind string, title string")
    chunks = spark.createDataFrame([(i, 0, vector(x)) for i, x in ((1, 0.0), (2, 0.01), (3, 1.4))], "thread_id bigint, chunk_index int, vector array<double>")
    near = clustering.neighbours(threads, chunks, 0.5, 0.9, 4, spark.createDataFrame([(1, 2, 0.94), (2, 3, 0.94)], EDGES))
    got = {(r["a"], r["b"]): r["score"] for r in near.collect()}
    assert got[1, 2] > 0.999 and got[2, 3] == got[3, 2] == 0.94 and (1, 3) not in got


# Generations

MEMBERS = "cluster bigint, thread_id bigint, state string"


def test_generation_rules(spark):
    members = spark.createDataFrame([(1, 10, "active"), (1, 11, "excluded"), (1, 12, "removed"), (2, 20, "active"), (2, 21, "excluded"), (3, 30, "active"), (3, 10, "excluded")], MEMBERS)
    decisions = spark.createDataFrame([(1, 10, False), (1, 13, True), (4, 20, True), (2, 10, True)], "cluster bigint, thread_id bigint, excluded boolean")
    new = spark.createDataFrame([(1, 10), (1, 13), (4, 20)], "cluster bigint, thread_id bigint")
    after = lambda complete: {(r["cluster"], r["thread_id"]): r["state"] for r in generations.members_after(members, decisions, new, complete).collect()}
    both = {(1, 10): "active", (1, 13): "excluded", (4, 20): "excluded", (1, 12): "removed", (2, 20): "removed", (2, 21): "excluded", (3, 30): "active", (3, 10): "removed"}
    assert after(False) == both | {(1, 11): "excluded"}
    assert after(True) == both | {(1, 11): "removed"}  # an excluded member that its cluster lost goes too; unseen clusters keep theirs


def test_saved_generation_keeps_identities(spark):
    clusters = spark.createDataFrame([(1, "k1", "active", 10, 1, None), (2, "k2", "active", 20, 1, None), (5, "k5", "retired", 50, 1, 7)], "cluster bigint, stable_key string, status string, representative bigint, last_run bigint, retired_at_us bigint")
    members = spark.createDataFrame([(1, 10, "active"), (1, 11, "active"), (2, 20, "active"), (5, 50, "removed")], MEMBERS)
    none = spark.createDataFrame([], "cluster bigint, thread_id bigint, excluded boolean")
    proposed = spark.createDataFrame([(100, 10, 10, 1.0), (100, 11, 10, 0.5), (101, 50, 50, 1.0)], "cluster bigint, thread_id bigint, representative bigint, score double")
    saved = generations.save(proposed, clusters, members, none, True, 3, 3, 9, 77)
    got = {r["cluster"]: r for r in saved["clusters"].collect()}
    assert (got[1]["stable_key"], got[1]["status"], got[1]["last_run"]) == ("k1", "active", 9)
    assert (got[2]["status"], got[2]["retired_at_us"], got[2]["last_run"]) == ("retired", 77, 1)
    assert got[5]["retired_at_us"] == 7 and got[6]["stable_key"].startswith("members-") and got[6]["representative"] == 50
    result = saved["result"].first()
    assert (result["status"], result["cluster_count"], result["member_count"], result["retired_count"]) == ("complete", 2, 3, 1)
    assert sorted((r["cluster"], r["event_type"]) for r in saved["events"].collect()) == [(1, "generated"), (6, "generated")]
    # The same proposal again finds the cluster of its stable key, even once it is retired and its members are gone.
    again = generations.save(proposed, saved["clusters"].withColumn("status", saved["clusters"]["status"]), members.limit(0), none, False, 5, 3, 10, 88)
    assert {r["cluster"] for r in again["events"].collect()} >= {6}


@pytest.mark.parametrize(("rows", "fault"), [
    ([(1, 10, 10, 1.0), (2, 10, 10, 1.0)], "repeated_thread"), ([(1, 10, 11, 1.0)], "representative_no_member"), ([(1, 10, 10, 1.5)], "score_out_of_range"), ([(1, 10, 10, float("nan"))], "score_out_of_range"),
])
def test_invalid_generations(spark, rows, fault):
    proposed = spark.createDataFrame(rows, "cluster bigint, thread_id bigint, representative bigint, score double")
    with pytest.raises(generations.InvalidGeneration, match=fault):
        generations.check(proposed, False, 5, 3)


def test_false_claims_of_coverage(spark):
    proposed = spark.createDataFrame([(1, 10, 10, None)], "cluster bigint, thread_id bigint, representative bigint, score double")
    generations.check(proposed, True, 3, 3)
    for complete, eligible, held in ((True, 4, 3), (False, 3, 4)):
        with pytest.raises(generations.InvalidGeneration):
            generations.check(proposed, complete, eligible, held)
