"""Quality classifier, spelling variants and the conversation prefix trie."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadloom.llm import prefix_trie, quality_classifier, queries, spelling_variants

DOCS = "doc_id bigint, text string"


# Quality classifier


@pytest.fixture(scope="module")
def scored(spark, sf):
    return {r["doc_id"]: r for r in queries.QUERIES["op11_quality_classifier"](spark, sf.replace("0.001", "0.01")).collect()}


def test_classifier_tells_held_out_labels(spark, sf, scored):
    labels = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/labels.parquet").where("quality IS NOT NULL").collect()
    pairs = [(scored[x["doc_id"]], x["quality"]) for x in labels if scored[x["doc_id"]]["held_out"]]
    assert len(pairs) > 50 and sum(r["predicted"] == y for r, y in pairs) / len(pairs) > 0.9
    good = [r["predicted"] for r, y in pairs if y == 1]
    assert sum(good) / len(good) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in scored.values())


def test_classifier_scores_every_row(spark, sf, scored):
    docs = spark.read.parquet(f"{sf.replace('0.001', '0.01')}/documents.parquet")
    assert docs.count() == len(scored)
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in scored.items())


def test_word_vectors_equal_brute_force(spark):
    texts = ["a b c a!! b", "", None, "b b\nÉ9 ?? b", " x "]
    got = quality_classifier.word_vectors(spark.createDataFrame(list(enumerate(texts)), DOCS).repartition(3))
    place, sign = quality_classifier.index_vectors()
    sums, counts = np.zeros((quality_classifier.BUCKETS, quality_classifier.DIMS)), np.zeros(quality_classifier.BUCKETS)
    for text in texts:
        words = re.findall(r"[^\W_]+|[^\s\w]+|_+", text or "")
        at = [int(quality_classifier.words_of([(0, w)])[0][0]) for w in words]
        for i, b in enumerate(at):
            counts[b] += 1
            for j in range(max(0, i - 2), min(len(at), i + 3)):
                if j != i:
                    sums[b, place[at[j]]] += sign[at[j]]
    assert np.allclose(got, quality_classifier.unit(sums, counts))


def test_pooling_of_cut_texts(monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(quality_classifier.BUCKETS, quality_classifier.DIMS)).astype(np.float32)
    texts = ["one two two three", "", "x" * 50, "a b " * 40]
    whole = quality_classifier.pooled(texts, vectors)
    assert not whole[1].any() and np.allclose(whole[0], quality_classifier.pooled(texts[:1], vectors)[0])
    monkeypatch.setattr(quality_classifier, "CHUNK_CHARS", 16)
    cut = quality_classifier.pooled(texts, vectors)
    assert np.allclose(cut[3][: quality_classifier.DIMS], whole[3][: quality_classifier.DIMS])  # cuts at white space lose no word
    assert "".join(p for held in quality_classifier.pieces(["ab cd " * 9]) for _, p in held) == "ab cd " * 9


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 5)), (rng.random(40) < 0.5).astype(float)
    net = quality_classifier.Network(x, y, epochs=1)
    z = net.scaled(x)

    def loss():
        p = quality_classifier.sigmoid(net.logits(z))
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for w, g in zip(net.w, net.gradients(z, y)):
        at = tuple(0 for _ in w.shape)
        before = w[at]
        w[at] = before + 1e-5
        up = loss()
        w[at] = before - 1e-5
        down = loss()
        w[at] = before
        assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_temperature_calibrates():
    rng = np.random.default_rng(5)
    logits = rng.normal(size=4000) * 2
    y = (rng.random(4000) < quality_classifier.sigmoid(logits)).astype(float)
    assert 2.7 < quality_classifier.temperature(logits * 3, y) < 3.3


def test_classifier_odd_rows(spark):
    docs = spark.createDataFrame([(1, "good text", 1), (1, "good text", 1), (2, None, 1), (None, "x", 1), (3, "bad " * 200_000, 1), (4, "", 1)], "doc_id bigint, text string, x int")
    labels = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (3, 0, "b"), (3, 1, "b"), (4, None, "c"), (None, 0, "c"), (2, 7, "d")], "doc_id bigint, quality int, text string")
    got = quality_classifier.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r["score"] <= 1 for r in got)
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    none = quality_classifier.classify(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5} and {r["predicted"] for r in none} == {1}
    assert quality_classifier.classify(docs.limit(0), labels).collect() == []


# Spelling variants


def brute_counts(rows):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    n = brute_counts(rows)
    lengths = defaultdict(list)
    for w in n:
        lengths[len(w)].append(w)
    near = {w: [x for k in (-1, 0, 1) for x in lengths.get(len(w) + k, ()) if x != w and is_near(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_of_made_up_words(spark):
    rng = random.Random(4)
    letters, words = "abcé", []
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(7, 9))) for _ in range(12)]
    for s in stems:
        words += [s] * rng.choice((2, 30, 400))
        for _ in range(6):
            i = rng.randrange(len(s))
            words += [rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i:], s[:i] + rng.choice(letters) + s[i + 1 :], "".join(rng.sample(s, len(s)))])] * rng.choice((2, 3, 40))
    words += ["zyxwvuts"] * 900 + ["zyxwvut"] * 60 + ["yxwvut" + "z"] * 9 + ["zyxwvua"] * 4 + ["zyxwbua"] * 2
    rng.shuffle(words)
    rows = [(i, " ".join(words[i::50])) for i in range(50)]
    got = rows_of(spelling_variants.variants(spark.createDataFrame(rows, DOCS)))
    assert got == brute_variants(rows)
    assert any(r[1] and r[1] != r[2] for r in got) and any(r[4] > 3 for r in got)  # chains of forms, and crowded places


def test_variants_of_the_table(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.QUERIES["op12_spelling_variants"](spark, sf)) == brute_variants(rows)


def test_anagrams_share_a_key_but_no_link(spark):
    words = ["abcdefg", "gfedcba", "abcdegf", "badcfeg"]
    rows = [(i, " ".join(words)) for i in range(3)]
    got = rows_of(spelling_variants.variants(spark.createDataFrame(rows, DOCS)))
    assert got == brute_variants(rows) and all(r[4] == 0 for r in got)
    keys = spelling_variants.with_key(spark.createDataFrame([(w, 1) for w in words], "word string, n bigint")).select("key").distinct()
    assert keys.count() == 1


def test_variants_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "Straßen ÀÉÎÕÜßø straßen Straßen"), (3, "Ab" * 30_000 + " " + "Ab" * 30_000), (4, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa ×÷×÷×÷× ×÷×÷×÷×"), (4, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa")]
    docs = spark.createDataFrame([(i, t, "w", 9) for i, t in rows], "doc_id bigint, text string, word string, n int")
    assert rows_of(spelling_variants.variants(docs)) == brute_variants(rows)
    assert spelling_variants.variants(docs.limit(0)).collect() == []


# Prefix trie


def brute_trie(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [x[1:] for x in sorted(t, key=lambda x: x[0])] for c, t in convs.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = turns.get(c - c % 100, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, t in built.items():
        for d in range(len(t) + 1):
            members[tuple(t[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in m if len(built[c]) == len(p)))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURNS = "conv_id bigint, turn bigint, role string, text string"


def nodes_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def test_trie_of_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf.replace('0.001', '0.01')}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert nodes_of(queries.QUERIES["op13_prefix_trie"](spark, sf.replace("0.001", "0.01"))) == brute_trie(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_random_branches(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(400), 90):
        for t in range(rng.choice((1, 2, 3, 8, 20))):
            rows.append((c, t, rng.choice(("user", "assistant")) if rng.random() < 0.1 else "user", "same" if rng.random() < 0.85 else rng.choice(("x", "yy", "😀"))))
    rng.shuffle(rows)
    got = nodes_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS)))
    assert got == brute_trie(rows)


def test_trie_of_one_long_conversation_and_many_copies(spark):
    rows = [(7, t, "user", f"turn {t}") for t in range(1500)] + [(c, t, "user", f"turn {t}") for c in range(1000, 1060) for t in range(12)]
    assert nodes_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_nested_chains_double(spark):
    """Each chain hangs on the one before: a tree as high as it has chains."""
    rows = [(c, t, "u", "a" if t < c - 6000 else f"own {c}") for c in range(6000, 6030) for t in range(35)]
    assert nodes_of(prefix_trie.trie(spark.createDataFrame(rows, TURNS))) == brute_trie(rows)


def test_trie_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "user", "a"), (2, 0, "user", ""), (2, None, None, "x"), (None, 0, "user", "lost"), (3, 0, "user", "y" * 100_000), (4, 0, "", ""), (104, 0, "", ""), (205, 5, "user", None)]
    docs = spark.createDataFrame([(*r, "p", 3) for r in rows], TURNS + ", p string, depth int")
    assert nodes_of(prefix_trie.trie(docs)) == brute_trie(rows)
    assert prefix_trie.trie(docs.limit(0)).collect() == []
    repeated = spark.createDataFrame([(500, 1, "u", "b"), (500, 1, "u", "a"), (500, 1, "u", "b")], TURNS)
    got = nodes_of(prefix_trie.trie(repeated))
    assert [r[1] for r in got] == [0, 1, 2, 3] and got == nodes_of(prefix_trie.trie(repeated.orderBy(F.rand(3))))
