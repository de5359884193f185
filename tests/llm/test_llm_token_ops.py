"""Encoding, the token store, BPE, packing, the Jaccard join and the pipeline."""

import ctypes
import hashlib
import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from threadloom.llm import bpe, common, components, encoding, jaccard_join, packing, queries, token_store

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    return lambda x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4")


@pytest.fixture(scope="module")
def tik():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(5, "a  b"), (3, None), (4, ""), (9, "same"), (9, "same"), (None, "no id"), (1, "long text. " * 30_000), (2, "é 東京\n\n 😀's <|endoftext|>\r\n"), (12, "x" * 5000)]
    return spark.createDataFrame([(i, t, "x", 1, "y") for i, t in rows], "doc_id bigint, text string, keys string, part int, ids string")


@pytest.fixture(scope="module")
def nothing(odd):
    return odd.where("false")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_encoding_equals_the_library(plain_ids):
    rng = random.Random(1)
    bits = ["a", "B", "é", "×", "中", "1", "²", ".", ",", "!", "'", "'s", " ", "  ", "\n", "\n\n", "\t", " ", "　", "\x1c", "\x85", "-", "<|endoftext|>", "_", "́", "😀", "don't", " \n", "\r\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    with open(JSON, "rb") as f:
        e = encoding.Encoder(f.read())
    for a in range(0, len(texts), 700):
        for t, got in zip(texts[a : a + 700], e.encode([t.encode() for t in texts[a : a + 700]])):
            assert got.tolist() == plain_ids(t)[:-1].tolist(), repr(t)


def test_control_strings_are_the_library_s_or_text(plain_ids):
    from tokenizers import Tokenizer

    with open(JSON, "rb") as f:
        data = f.read()
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    texts = ["<|endoftext|>", "a <|endoftext|> b<|endoftext|><|endoftext|>\n", "", "<|endoftext|", "none"]
    for got, x in zip(encoding.Encoder(data).encode([x.encode() for x in texts]), texts):
        assert got.tolist() == plain_ids(x)[:-1].tolist()
    for got, x in zip(encoding.Encoder(data, special_as_text=True).encode([x.encode() for x in texts]), texts):
        assert got.tolist() == t.encode(x, add_special_tokens=False).ids


def test_long_texts_are_encoded_in_parts(plain_ids, monkeypatch):
    """Parts of a few bytes, many distinct units, units that share a hash: the ids stay those of the whole text."""
    rng = random.Random(3)
    bits = ["word", " a", " bc", "\n", "  ", ".", "é", "中", "7", " don't", "x" * 70, "<|endoftext|>"]
    texts = ["".join(rng.choice(bits) for _ in range(900)) for _ in range(20)]
    with open(JSON, "rb") as f:
        e = encoding.Encoder(f.read())
    assert b"".join(encoding.pieces(texts[0].encode(), 50, 16)) == texts[0].encode() and len(encoding.pieces(texts[0].encode(), 50, 16)) > 9
    monkeypatch.setattr(encoding, "BATCH_BYTES", 64)
    for few in (False, True):
        if few:  # nearly all units share a hash with another one
            monkeypatch.setattr(encoding, "hashes", lambda data, begin, end: np.uint64(3) + (end - begin).astype(np.uint64) % np.uint64(2) * np.uint64(4))
            e.table = encoding.Table()
        for t, got in zip(texts, e.encode([t.encode() for t in texts])):
            assert got.tolist() == plain_ids(t)[:-1].tolist()
    assert len(e.table.others) > 20


def test_encoding_takes_little_memory_at_once(plain_ids):
    """6 MB of texts go through the encoder in parts: a worker shares an executor's memory with others."""
    import tracemalloc

    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(3000)]
    with open(JSON, "rb") as f:
        e = encoding.Encoder(f.read())
    raw = pa.array([*(t.encode() for t in texts), None], pa.binary())
    tracemalloc.start()
    try:
        got = [ids for _, _, held in encoding.text_slices(raw) for ids in e.encode(held)]
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert raw.nbytes > 6_000_000 and most < 80_000_000  # its own ids and table are 20 MB of these
    assert all(got[i].tolist() == plain_ids(texts[i])[:-1].tolist() for i in range(0, len(texts), 100)) and len(got[-1]) == 0
    tracemalloc.start()
    try:
        e.encode([t.encode() for t in texts])
        assert tracemalloc.get_traced_memory()[1] < 80_000_000
    finally:
        tracemalloc.stop()


@pytest.mark.skipif(not hasattr(ctypes.CDLL(None), "malloc_trim"), reason="glibc's call")
def test_freed_memory_goes_back():
    def resident():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    held = [np.ones(100_000, np.uint8) for _ in range(2000)]
    pins = held[::100]  # so that the heap can't just end earlier
    most = resident()
    del held
    common.give_back()
    assert resident() < most - 100_000_000 and all(p.all() for p in pins)


def test_more_distinct_words_than_a_small_table_holds(tik):
    """Over 2^20 distinct words of one block, over 2^22 distinct units of one text."""
    texts = [" ".join(np.base_repr(i, 36) for i in range(a, a + 400_000)).encode() for a in range(0, 1_200_000, 400_000)]
    block = bpe.Block()
    counts, refs = block.add(texts)
    assert block.count > 1 << 20 and counts.sum() == len(refs) == 1_200_000
    data, size = block.words
    end = np.cumsum(size)
    for k in (0, 5, 700_000, 1_199_999):
        i = refs[k]
        assert data[end[i] - size[i] : end[i]].tobytes().split() == [np.base_repr(k, 36).encode()]
    table = encoding.Table()
    number = np.concatenate([table.numbers(encoding.Units.of(np.arange(a, a + 500_000, dtype="<u4").tobytes(), np.full(500_000, 4)), bpe._numbered) for a in range(0, 4_500_000, 500_000)])
    assert (number == np.arange(4_500_000)).all()


def test_store_round_trip(spark, odd, plain_ids, tmp_path):
    docs = odd.unionByName(odd.where("doc_id = 1").withColumn("doc_id", F.lit(77).cast("long")))
    path = token_store.write_store(docs, str(tmp_path / "store"), JSON)
    want = sorted((i is not None, i or 0, plain_ids(t).tobytes()) for i, t in rows_of(docs))
    got = token_store.read_documents(spark, path).orderBy("start").collect()
    assert [(r["doc_id"] is not None, r["doc_id"] or 0) for r in got] == [w[:2] for w in want]
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, bytes(r["ids"])) for r in got) == want
    before = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (before, len(r["ids"]) // 4)
        before += r["n_tokens"]
    by = {(r["doc_id"], r["start"]): r for r in token_store.digest(spark, path).collect()}
    for r in got:
        d = by[r["doc_id"], r["start"]]
        assert (d["n_tokens"], d["ids_crc32"]) == (r["n_tokens"], zlib.crc32(bytes(r["ids"])))
    chunks = spark.read.parquet(f"{path}/chunks")
    assert chunks.count() == chunks.select("key").distinct().count()
    # The two copies of the long text share all their chunks.
    keys = {r["doc_id"]: r["keys"] for r in spark.read.parquet(f"{path}/recipes").collect()}
    assert keys[1] == keys[77] and len(keys[1]) > 3


def test_damage_is_noticed(spark, odd, tmp_path):
    path = token_store.write_store(odd, str(tmp_path / "store"), JSON)
    import shutil

    shutil.copytree(f"{path}/recipes", f"{path}/kept")
    cut = spark.read.parquet(f"{path}/kept").where("doc_id IS NULL OR doc_id <> 12")
    cut.write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.digest(spark, path)


@pytest.mark.parametrize("column", ["doc_id", "start", "n_tokens", "ends"])
def test_a_changed_recipe_is_noticed(spark, odd, tmp_path, column, monkeypatch):
    monkeypatch.setattr(token_store, "FAN", 2)  # several levels in parts, and over parts
    path = token_store.write_store(odd, str(tmp_path / "store"), JSON)
    assert len(token_store.root_of(spark, path)) == 32
    assert token_store.digest(spark, path).count() == odd.count()
    levels = spark.read.parquet(f"{path}/manifest").groupBy("level").count().orderBy("level").collect()
    assert len(levels) > 2 and levels[-1]["count"] == 1
    recipes = spark.read.parquet(f"{path}/recipes")
    rows = spark.createDataFrame(recipes.collect(), recipes.schema)
    more = F.transform("ends", lambda x: x + 1) if column == "ends" else F.col(column) + 1
    rows.withColumn(column, F.when(F.col("doc_id") == 12, more).otherwise(F.col(column))).write.mode("overwrite").parquet(f"{path}/recipes")
    with pytest.raises(ValueError, match="manifest"):
        token_store.read_recipes(spark, path)


def test_empty_store(spark, nothing, tmp_path):
    path = token_store.write_store(nothing, str(tmp_path / "store"), JSON)
    assert token_store.digest(spark, path).count() == 0 and token_store.root_of(spark, path) is None


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    body = rng.integers(0, 50_000, 20_000).astype(np.uint32)
    cuts = lambda x: {x[a:b].tobytes() for a, b in zip([0, *token_store.chunk_ends(x)], token_store.chunk_ends(x))}
    a, b = cuts(body), cuts(np.concatenate([rng.integers(0, 9, 333).astype(np.uint32), body]))
    assert len(a & b) > 0.8 * len(a)
    sizes = np.diff([0, *token_store.chunk_ends(body)])
    assert sizes.max() <= token_store.MAX_CHUNK and sizes[:-1].min() >= token_store.MIN_CHUNK


def test_op4_against_brute_force(spark, sf, plain_ids):
    docs = sorted(rows_of(spark.read.parquet(f"{sf}/documents.parquet")))
    want, before = [], 0
    for i, t in docs:
        ids = plain_ids(t)
        want.append((i, before, len(ids), zlib.crc32(ids.tobytes())))
        before += len(ids)
    assert sorted(map(tuple, queries.QUERIES["op4_token_store"](spark, sf).collect())) == want


def check_packing(pieces, docs, plain_ids, window=1024):
    seqs, parts = defaultdict(list), defaultdict(list)
    for p in pieces:
        seqs[p["sequence_id"]].append(p)
        parts[p["doc_id"]].append(p)
    ids = {i: plain_ids(t) for i, t in docs}
    for i, x in ids.items():
        at = 0
        for p in sorted(parts[i], key=lambda p: p["start"]):
            assert p["start"] == at and p["doc_tokens"] == len(x)
            assert p["ids_crc32"] == zlib.crc32(x[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(x)
    padding = 0
    for s in seqs.values():
        at = 0
        for p in sorted(s, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding


def test_op10_against_brute_force(spark, sf, plain_ids):
    pieces = queries.QUERIES["op10_packing"](spark, sf).collect()
    assert check_packing(pieces, rows_of(spark.read.parquet(f"{sf}/documents.parquet")), plain_ids) < 1024


@pytest.mark.parametrize("texts", [["one"], ["w " * 700] * 9, ["w " * 511, "w " * 511], ["w " * 1023], [None, ""], ["w " * (1 + 13 * k) for k in range(60)]])
def test_packing_of_hard_histograms(spark, plain_ids, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pieces = packing.pack(docs, JSON).collect()
    assert check_packing(pieces, list(enumerate(texts)), plain_ids) < 1024
    for p in pieces:
        assert bytes(p["ids"]) == plain_ids(texts[p["doc_id"]])[p["start"] : p["start"] + p["length"]].tobytes()


def test_packing_of_odd_rows(odd, nothing):
    assert packing.pack_digest(nothing, JSON).count() == 0
    got = packing.pack_digest(odd, JSON).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r["doc_id"]: r["n"] // r["d"] for r in got} == {5: 1, 3: 1, 4: 1, 9: 2, None: 1, 1: 1, 2: 1, 12: 1}


def test_nnls_meets_a_solvable_histogram():
    hist = np.zeros(1024)
    hist[[700, 324, 500, 524, 300, 400]] = [30, 35, 12, 12, 5, 5]
    combos = packing.combinations(hist, 1024)
    x = packing.nnls(combos, hist, 1e-7)
    fit = np.zeros(1024)
    for c, k in zip(combos, x):
        for n in c:
            fit[n] += k
    assert (x >= 0).all() and np.abs(fit - hist).max() < 0.5


def test_combinations_are_all_there():
    rng = np.random.default_rng(1)
    hist = rng.integers(0, 2, 65) * rng.integers(1, 9, 65)
    hist[0] = hist[64] = 0
    here = [n for n in range(65) if hist[n]]
    want = {(n,) for n in (1, 2, 4, 8, 16, 32) if n in here} | {(a, b) for a in here for b in here if a >= b and a + b == 64}
    want |= {(a, b, c) for a in here for b in here for c in here if a >= b >= c and a + b + c == 64}
    got = packing.combinations(hist, 64)
    assert set(got) == want and len(got) == len(want)


def test_nnls_is_optimal():
    """At the end no combination's gradient asks for more of it, and none in use for less."""
    rng = np.random.default_rng(2)
    hist = np.zeros(129)
    hist[1:128] = rng.integers(0, 50, 127)
    combos = packing.combinations(hist, 128)
    x = packing.nnls(combos, hist, 1e-9)
    fit = np.zeros(129)
    for c, k in zip(combos, x):
        for n in c:
            fit[n] += k
    slope = np.array([sum(fit[n] - hist[n] for n in c) for c in combos])
    assert (slope > -0.5).all() and (np.abs(slope[x > 0.5]) < 0.5).all()


def test_op6_against_the_library(spark, sf, tik):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows_of(spark.read.parquet(f"{sf}/documents.parquet")):
        ids = tik.encode_ordinary(t)
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(t.encode())))
    assert sorted(map(tuple, queries.QUERIES["op6_bpe"](spark, sf).collect())) == sorted(want)


def test_bpe_of_odd_rows_in_many_blocks(odd, nothing, tik):
    got = bpe.decode(bpe.encode(odd.repartition(3), RANKS, P.PATTERN, block_bytes=100), RANKS).collect()
    want = sorted((i is not None, i or 0, tik.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows_of(odd))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in got) == want
    assert bpe.encode(nothing, RANKS, P.PATTERN).count() == 0


# The Jaccard join


def brute_components(rows, size, percent):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    sets = {}
    for i, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(low))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def planted(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, i = [], 0
    shared = [rng.choice(vocabulary) for _ in range(60)]
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)] + (shared if g % 2 else [])
        for _ in range(copies):
            base = list(base) if rng.random() < 0.5 else base  # chains as well as stars
            t = list(base)
            for _ in range(rng.randint(0, edits)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((i, " ".join(t)))
            i += 1
            if rng.random() < 0.5:
                base = t
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 95)])
@pytest.mark.parametrize(("words", "edits"), [(6, 1), (14, 1), (25, 2), (70, 4), (400, 20)])
def test_candidate_keys_lose_no_link(size, percent, words, edits):
    """Every two sets that link share a key, or are equal."""
    hashes = jaccard_join.WordHashes()
    rows = planted(words + size, 12, 14, words, edits)
    sets = [jaccard_join.shingles(t.encode(), size, hashes) for _, t in rows]
    keys = [set(jaccard_join.keys_of(s, percent)[0].tolist()) for s in sets]
    links = 0
    for a in range(len(sets)):
        for b in range(a):
            if jaccard_join.linked(sets[a], sets[b], percent):
                links += 1
                assert keys[a] & keys[b] or (len(sets[a]) == len(sets[b]) and (sets[a] == sets[b]).all())
    assert links


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80)])
def test_prefixes_stand_in_for_parts_that_stay_empty(monkeypatch, size, percent):
    """With too few parts every large set says so, and prefixes alone keep all links."""
    monkeypatch.setattr(jaccard_join, "parts_of", lambda most, top, percent: 2)
    hashes = jaccard_join.WordHashes()
    sets = [jaccard_join.shingles(t.encode(), size, hashes) for _, t in planted(3, 12, 14, 120, 8)]
    found = [jaccard_join.keys_of(s, percent, True) for s in sets]
    assert all(short for _, short in found)
    links = [(a, b) for a in range(len(sets)) for b in range(a) if jaccard_join.linked(sets[a], sets[b], percent)]
    assert links and all(set(found[a][0].tolist()) & set(found[b][0].tolist()) for a, b in links)


def test_join_with_prefixes_against_brute_force(spark, monkeypatch):
    plain = jaccard_join.signatures
    monkeypatch.setattr(jaccard_join, "signatures", lambda docs, size, percent, prefixes=False: plain(docs, size, percent, prefixes).withColumn("short", F.lit(not prefixes)))
    rows = planted(5, 9, 20, 90, 5)
    got = sorted(map(tuple, jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).collect()))
    assert got == brute_components(rows, 3, 90)


def test_keep_one_beside_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 1, 2), (2, "a b c d e f", 3, 4)], "doc_id bigint, text string, gone int, GONE_ int")
    assert [tuple(r) for r in jaccard_join.keep_one(df).collect()] == [(1, "a b c d e f", 1, 2)]


@pytest.mark.parametrize(("size", "percent", "words", "edits"), [(3, 90, 120, 6), (5, 80, 30, 3)])
def test_join_against_brute_force(spark, size, percent, words, edits, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 8)
    monkeypatch.setattr(jaccard_join, "STAR_SETS", 5)
    rows = planted(7, 9, 20, words, edits) + [(9001, None), (9002, " \n"), (9003, "one two"), (9004, "ONE\ttwo"), (9005, "w1 " * 4000)]
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "doc_id bigint, text string, node string, n int")
    got = sorted(map(tuple, jaccard_join.jaccard_components(df, size, percent).collect()))
    assert got == brute_components(rows, size, percent)
    kept = jaccard_join.keep_one(df, size, percent)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted({c for _, _, c in got})


def test_tiles_find_all_components():
    rng = np.random.default_rng(5)
    base = np.sort(rng.integers(0, 1 << 60, 300).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[rng.random(300) < 0.96], rng.integers(0, 1 << 60, 6).astype(np.uint64)])) for _ in range(60)]
    sets += [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 2, 5, 300, 900)]
    nodes = np.arange(len(sets))
    root = {int(n): int(n) for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def groups(links):
        root.update({int(n): int(n) for n in nodes})
        for a, b in links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        return [find(int(n)) for n in nodes]

    want = groups([(a, b) for a in range(len(sets)) for b in range(a) if jaccard_join.linked(sets[a], sets[b], 90)])
    assert groups(jaccard_join.tile_links(nodes, nodes.copy(), np.full(len(nodes), -1), sets, 90)) == want
    assert groups(jaccard_join.tile_links(nodes, nodes.copy(), nodes % 2, sets, 90)) != list(nodes)


def test_join_of_rows_without_ids(spark):
    df = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (2, "a b c d"), (2, "a b c d")], "doc_id bigint, text string")
    got = sorted(((r[0] or 0), r[1], r[2]) for r in jaccard_join.jaccard_components(df, 3, 90).collect())
    assert got == [(0, 2, None), (2, 2, 2), (2, 2, 2), (4, 2, 2)]
    assert jaccard_join.jaccard_components(df.where("false"), 3, 90).count() == 0


def test_op2_against_brute_force(spark, sf):
    rows = rows_of(spark.read.parquet(f"{sf}/documents.parquet"))
    assert sorted(map(tuple, queries.QUERIES["op2_jaccard_join"](spark, sf).collect())) == brute_components(rows, 3, 90)


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)]
    root = {n: n for e in edges for n in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for n in root if find(n) != n}


def test_pipeline_against_brute_force(spark, sf, plain_ids):
    """Each stage keeps what a plain reading of its operator keeps."""
    import corpus_pipeline

    from threadloom.llm import language_id, quality_rules
    from threadloom.llm.common import materialize

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, {}
    frames = [docs]
    for name, stage in corpus_pipeline.STAGES:
        frames.append(materialize(stage(spark, frames[-1], sf), "test-stage"))
        kept[name] = frames[-1]
    assert all(f.columns == columns for f in frames[:-1])
    texts = lambda f: {r["doc_id"]: r["text"] for r in f.collect()}
    known = {r["doc_id"] for r in language_id.label(docs, language_id.train_on_open_rows(docs)).where("lang_pred <> 'und' AND score >= 0.2").collect()}
    assert set(texts(frames[1])) == known
    assert set(texts(frames[2])) == {r["doc_id"] for r in quality_rules.judge(frames[1]).where("kept").collect()}
    best = {}
    for i, t in sorted(texts(frames[2]).items()):
        k = re.sub("[\x20\x09-\x0d]", "", t)
        if k not in best or len(t) > best[k][0]:
            best[k] = (len(t), i)
    assert set(texts(frames[3])) == {i for _, i in best.values()}
    assert set(texts(frames[4])) == {c for *_, c in brute_components(list(texts(frames[3]).items()), 5, 80)}
    assert check_packing(frames[5].collect(), list(texts(frames[4]).items()), plain_ids) < 1024


def test_folded_bitmaps_are_those_of_fewer_bits():
    rng = np.random.default_rng(4)
    s = np.unique(rng.integers(0, 1 << 62, 500).astype(np.uint64))
    wide = int.from_bytes(jaccard_join.own_bitmap(s), "little")
    for width in (512, 256, 64):
        assert jaccard_join.folded(wide, 512, width) == int.from_bytes(jaccard_join.bitmaps([s], width)[0].tobytes(), "little")


@pytest.mark.parametrize("percent", [80, 90])
def test_bitmaps_exclude_no_link(percent):
    rng = np.random.default_rng(6)
    excluded = 0
    for _ in range(300):
        n = int(rng.integers(1, 900))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < rng.choice([0.6, 0.9, 0.97])], rng.integers(0, 1 << 62, int(rng.integers(0, 1 + n // 8))).astype(np.uint64)]))
        if len(b):
            maybe = jaccard_join.plausible(len(a), int.from_bytes(jaccard_join.own_bitmap(a), "little"), len(b), int.from_bytes(jaccard_join.own_bitmap(b), "little"), percent)
            assert maybe or not jaccard_join.linked(a, b, percent)
            excluded += not maybe
    assert excluded


def test_shared_keys_are_found_once_dealt(spark, monkeypatch):
    """Keys that many documents share, in one task and over tasks, keep all their nodes."""
    monkeypatch.setattr(jaccard_join, "DEAL_KEYS", 50)
    rows = [(i, [7] + [1000 + i, 2000 + i // 3] + ([8] if i % 50 == 0 else [])) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, keys array<bigint>").repartition(5)
    got = jaccard_join.shared_keys(df).collect()
    assert {(r["key"], r["node"]) for r in got} == {(k, i) for i, ks in rows for k in ks if k < 1000 or k >= 2000}
    # Each key's nodes hang together by their centres.
    import collections

    near = collections.defaultdict(set)
    for r in got:
        near[r["key"], r["node"]].add(r["centre"])
        near[r["key"], r["centre"]].add(r["node"])
    reached, todo = set(), [(7, 0)]
    while todo:
        x = todo.pop()
        if x not in reached:
            reached.add(x)
            todo += [(7, n) for n in near[x]]
    assert len(reached) == 300


def test_large_keys_are_cut_into_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_SETS", 4)
    rows = [(1, n, n if n % 3 else 0) for n in range(30)] + [(2, 100, 100), (2, 101, 101), (3, 5, 9), (3, 6, 9)]
    tiles = jaccard_join.open_tiles(spark.createDataFrame(rows, "key bigint, node bigint, root bigint")).collect()
    root = {n: r for k, n, r in rows if k == 1}
    met = set()
    by = defaultdict(list)
    for t in tiles:
        by[t["grp"], t["tile"]].append((t["node"], t["side"]))
    for (g, _), members in by.items():
        met |= {(g, *sorted((a, b))) for a, s in members for b, u in members if a != b and (s < 0 or s != u)}
    assert {(1, a, b) for a in range(30) for b in range(a + 1, 30) if root[a] != root[b]} <= met
    assert (2, 100, 101) in met and not [m for m in met if m[0] == 3]


def test_false_candidates_hide_no_link(spark):
    """Two components: a pair that the bitmaps can't exclude but that is no link comes first, the one true link after it."""
    rng = np.random.default_rng(8)
    drawn = lambda n: np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
    own = lambda s: (len(s), int.from_bytes(jaccard_join.own_bitmap(s), "little"))
    for _ in range(1000):
        base = drawn(250)
        sets = {1: base, 2: np.unique(np.concatenate([base[14:], drawn(14)]))}
        if not jaccard_join.linked(sets[1], sets[2], 90) and jaccard_join.plausible(*own(sets[1]), *own(sets[2]), 90):
            break
    base = drawn(300)
    sets |= {3: base, 4: np.append(base[:-2], base[-1]), 5: base[: 280]}
    roots = {1: 1, 2: 2, 3: 1, 4: 2, 5: 2}
    assert not jaccard_join.linked(sets[1], sets[2], 90) and jaccard_join.linked(sets[3], sets[4], 90)
    shared = spark.createDataFrame([(7, n, 1) for n in sets], "key bigint, node bigint, centre bigint")
    of_roots = spark.createDataFrame([(n, r) for n, r in roots.items() if n != r], "node bigint, root bigint")
    maps = spark.createDataFrame([(n, len(s), bytearray(jaccard_join.own_bitmap(s))) for n, s in sets.items()], "node bigint, n bigint, s binary")
    places = jaccard_join.candidate_places(shared, of_roots, maps, maps.select("node", "n"), 90).collect()
    by = defaultdict(list)
    for r in places:
        by[r["grp"], r["tile"]].append(r)
    links = set()
    for rows in by.values():
        columns = (np.array([r[c] for r in rows]) for c in ("node", "root", "side"))
        links |= {tuple(sorted(x)) for x in jaccard_join.tile_links(*columns, [sets[r["node"]] for r in rows], 90)}
    assert links and links <= {(3, 4), (3, 5)}
