import pytest
from pyspark.sql import functions as F

from threadloom.functions import hashing, identity, text, vectors
from threadloom.operators import clustering, documents, ledger, listing, observations, search


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("raw", "us"), [
    ("2001-02-03T04:05:06.7890129Z", 981173106789012), ("1960-01-01T00:00:00.5000007Z", -315619199500000 + 1), ("1969-12-31T23:59:59.9999991Z", 0), ("1970-01-01T00:00:00Z", 0),
    ("2012-02-29T23:30:00-01:30", 1330563600000000), ("yesterday", None), (None, None), ("2023-02-30T00:00:00Z", None), ("", None),
])
def test_timestamps_truncate_toward_the_epoch(spark, raw, us):
    assert one(spark, identity.micros(F.lit(raw).cast("string"))) == us


def test_keyword_quoting():
    assert text.keyword_expression('slow AND "start" -warm^2') == '"slow" "AND" "start" "warm" "2"'
    assert text.keyword_expression(" (-) ") is None
    assert text.keyword_terms("naïve.file_name:Ж9 ½x") == ["naïve", "file_name", "Ж9", "½x"]


@pytest.mark.parametrize("bad", ["", '"open', "AND x", "(a", "a OR", ")", "a NOT"])
def test_bad_expressions_are_refused(bad):
    with pytest.raises(search.QuerySyntaxError):
        search.parse_expression(bad)


def test_expressions_bind_not_before_and_before_or(spark):
    tree = search.parse_expression('a b OR title:"c d"* NOT e')
    assert tree.op == "or" and tree.left.op == "and" and tree.right.op == "not" and tree.right.left.columns == ("title",)
    rows = spark.createDataFrame([(1, "c dx", "y"), (2, "q", "a b"), (3, "c d", "e"), (4, None, None)], "thread_id int, title string, body string")
    assert [r[0] for r in search.keyword_search(rows, tree).orderBy("thread_id").select("thread_id").collect()] == [1, 2]


@pytest.mark.parametrize(("value", "budget", "parts"), [
    ("alpha beta gamma", 10, ["alpha", "beta gamma"]), ("alpha beta gamma", 11, ["alpha beta", "gamma"]), (" \n one\ttwo  three ", 8, ["one\ttwo", "three"]),
    ("éé ü", 5, ["éé", "ü"]), ("ééé", 4, ["éé", "é"]), ("longword x", 4, ["long", "word", "x"]), ("longword x", 8, ["longword", "x"]), ("x longword", 5, ["x", "longw", "ord"]), ("", 3, []), (" \u3000 ", 3, []),
])
def test_chunks(value, budget, parts):
    assert text.chunk_text(value, budget) == parts


def test_chunks_of_random_texts():
    """Against the rule, character by character: fits, ends at a white space where one fits, loses nothing but white space."""
    import random

    rng = random.Random(5)
    for _ in range(400):
        value = "".join(rng.choice("ab é中 \n😀") for _ in range(rng.randint(0, 40)))
        budget = rng.randint(4, 14)
        rest, want = value.strip(), []
        while len(rest.encode()) > budget:
            fits = max(n for n in range(len(rest)) if len(rest[:n].encode()) <= budget)
            blanks = [n for n in range(1, fits) if rest[n].isspace()]
            cut = blanks[-1] if blanks else fits
            want.append(rest[:cut].rstrip())
            rest = rest[cut:].lstrip()
        assert text.chunk_text(value, budget) == want + [rest] * bool(rest)


def test_chunk_budget_below_a_character():
    with pytest.raises(ValueError):
        text.chunk_text("中文", 2)


def test_accents_of_all_latin_letters_fold(spark):
    got = one(spark, text.search_tokens(F.lit("Čeština ŞEHİR őrült ūdens žába e\u0301te\u0301 Ἀθῆναι naïve")))
    assert got == ["cestina", "sehir", "orult", "udens", "zaba", "ete", "αθηναι", "naive"]


def test_many_mentions_take_linear_time():
    assert [n for _, n, _ in text.mentions_of("#12 " * 20_000 + "a/b#7")][-2:] == [12, 7]


@pytest.mark.parametrize(("value", "found"), [
    ("a/b/c#5", [("b/c", 5, 2)]), ("xpull/7", [(None, 7, 1)]), ("#1 #22", [(None, 22, 3)]), ("o/r/PULL/3x", [("o/r", 3, 0)]), ("-o/r#4", [("o/r", 4, 1)]), ("o//r#40", [(None, 40, 4)]),
    ("issues/5#12", [("issues/5", 12, 0)]), ("xissues/5y#12", [("xissues/5y", 12, 0)]), ("o/r#1/s#2", [("o/r", 1, 0)]), ("o/r#99999999999999999999 #10", [(None, 10, 25)]),
    ("#\u0661\u0662 é#77", [(None, 77, 8)]), ("", []), ("issues/", []), ("o/r/issues/8/pull/9", [("o/r", 8, 0), (None, 9, 13)]), (None, []),
])
def test_mention_forms(value, found):
    assert list(text.mentions_of(value)) == found


def test_dashed_lines_take_linear_time():
    import time

    begin = time.perf_counter()
    for value in ("a-" * 100_000 + "#12", "a/" * 100_000 + "b#1", "issues/1#2 " * 30_000, "#1" * 100_000):
        list(text.mentions_of(value))
    assert time.perf_counter() - begin < 10


def test_mentions():
    found = list(text.mentions_of("See #7, #12 and a/b#3; org/src/issues/44 pull/5 é #99"))
    assert [(r, n) for r, n, _ in found] == [(None, 12), ("a/b", 3), ("org/src", 44), (None, 5), (None, 99)]
    assert found[-1][2] == len("See #7, #12 and a/b#3; org/src/issues/44 pull/5 é ".encode())


@pytest.mark.parametrize(("raw", "host"), [("GIT.Example.", "git.example"), ("git.example:443", "git.example"), ("git.example:8443", "git.example:8443"), ("[0:0:0:0:0:0:0:1]", "[::1]")])
def test_hosts(raw, host):
    assert identity.parse_host(raw) == host


@pytest.mark.parametrize("raw", ["", "https://git.example", "a b", "git.example/x", "user@git.example", "x:99999", "-a.example"])
def test_bad_hosts(raw):
    with pytest.raises(ValueError):
        identity.parse_host(raw)


def test_selectors(spark):
    ask = lambda f, *texts: [tuple(r[0]) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, c string").coalesce(1).orderBy("i").select(f(F.col("c"), "own.example")).collect()]
    none = (None,) * 5
    assert ask(identity.parse_thread, "org/name#12", "https://Git.Example:443/org/na_me.x/pull/7/", "HTTPS://git.example/o/n/issues/007?x#y", "o/n#+3") == [
        ("own.example", "org", "name", None, 12), ("git.example", "org", "na_me.x", "pull", 7), ("git.example", "o", "n", "issues", 7), ("own.example", "o", "n", None, 3),
    ]
    assert ask(identity.parse_thread, "org/name#0", "x", None, "http://h/o/n/pull/1", "https://h/o/n/pulls/1", "https://h/o/n/pull/1/files", "o/n/m#1", "o/n#99999999999999999999", "https://b_d/o/n/pull/1") == [none] * 9
    assert ask(identity.parse_repository, "https://Git.Example./org/name.git/?q", "a/b c", "ä/ö", "https://h/o", "https://h/o/n/m", "ftp://h/o/n", "o\\x/n", "https://h:0/o/n") == [
        ("git.example", "org", "name.git"), (None,) * 3, ("own.example", "ä", "ö"), *[(None,) * 3] * 5,
    ]


def test_next_link(spark):
    header = '<https://x/a?page=1>; rel="prev", <https://x/a?page=3>; rel="next", <https://x/a?page=9>; rel="last"'
    assert one(spark, identity.next_link(F.lit(header))) == "https://x/a?page=3"
    assert one(spark, identity.next_link(F.lit('<https://x>; rel="last"'))) is None


def test_hashes_frame_their_fields(spark):
    import hashlib

    def framed(*parts):
        return b"".join(len(p).to_bytes(8, "big") + p for p in parts)

    got = one(spark, hashing.chunk_hash(F.lit(1), F.lit("é")))
    assert got == hashlib.sha256(framed(b"embedding-chunk-v1", (1).to_bytes(4, "big"), "é".encode())).hexdigest()
    key = one(spark, hashing.members_key(F.array(F.lit(9), F.lit(2)).cast("array<bigint>")))
    assert key == "members-" + hashlib.sha256(b"cluster-members-v1\0" + (2).to_bytes(8, "big") + (9).to_bytes(8, "big")).hexdigest()


def test_vectors(spark):
    assert vectors.to_bytes([0.5, -1.25, 3.0]) == bytes([0, 0, 0, 63, 0, 0, 160, 191, 0, 0, 64, 64])
    assert vectors.from_bytes(vectors.to_bytes([1.5, 2])) == [1.5, 2.0]
    for bad in ([], [0.0], [float("nan")]):
        with pytest.raises(ValueError):
            vectors.to_bytes(bad)
    a = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    assert one(spark, vectors.cosine(a(1, 0), a(2, 0))) == 1.0
    assert one(spark, vectors.cosine(a(1, 0), a(1, 0, 0))) is None
    assert one(spark, vectors.cosine(a(0, 0), a(1, 0))) is None


def test_best_chunk_takes_the_best_and_drops_other_sizes(spark):
    rows = spark.createDataFrame([(3, [0.2, 0.8]), (3, [1.0, 0.0]), (1, [0.8, 0.6]), (5, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [1.0])], "thread_id int, vector array<float>")
    got = {r[0]: round(r[1], 6) for r in search.best_chunk(rows, [1.0, 0.0]).collect()}
    assert got == {3: 1.0, 1: 0.8}


def test_search_window():
    assert search.window_size(20, 9980) == 10_001
    with pytest.raises(ValueError):
        search.window_size(20, 9981)
    with pytest.raises(ValueError):
        listing.check_page(0, 0)


def test_representative_of_a_chain(spark):
    threads = spark.createDataFrame([(i, "o/r") for i in (1, 2, 3, 4)], "thread_id bigint, full_name string")
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.85)], "a bigint, b bigint, score double")
    got = {r["thread_id"]: (r["representative"], r["score"]) for r in clustering.with_representatives(clustering.bounded_components(threads, edges)).collect()}
    assert got == {1: (2, 0.9), 2: (2, 1.0), 3: (2, 0.85), 4: (4, 1.0)}


def test_observations_do_not_depend_on_arrival(spark):
    import random

    rows = [(1, i % 4 or None, i, f"p{i}") for i in range(1, 20)]
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "k int, source_clock int, sequence int, payload string")
        got = observations.canonical(df, ["k"], ["payload"]).first()["payload"]
        want = want or got
        assert got == want == "p19"
    log = spark.createDataFrame([(1, "a", None, 1), (1, " a ", None, 2), (2, "a", None, 1), (2, None, None, 2), (3, "a", None, 1), (3, "b", None, 2), (3, "c", 7, 3)], "k int, raw_clock string, source_clock int, sequence int")
    assert [r["k"] for r in observations.ambiguous_keys(log, ["k"]).collect()] == [2]
    assert {r["k"]: r["sequence"] for r in observations.canonical_strict(log.where("k <> 2"), ["k"], ["raw_clock"]).collect()} == {1: 2, 3: 3}
    with pytest.raises(Exception, match="unusable"):
        observations.canonical_strict(log, ["k"], ["raw_clock"]).collect()


def test_watermark_moves_only_with_complete_newer_scans(spark):
    now = spark.createDataFrame([("a", 10, 5), ("b", 10, 5)], "key string, watermark_us bigint, sequence bigint")
    scans = spark.createDataFrame([("a", 20, 6, "complete", None), ("a", 30, 7, "incomplete", None), ("b", 20, 4, "complete", None), ("c", 1, 1, "complete", None)], "key string, watermark_us bigint, sequence bigint, status string, cursor string")
    assert {r[0]: (r[1], r[2]) for r in observations.advance_watermark(now, scans).collect()} == {"a": (20, 6), "b": (10, 5), "c": (1, 1)}


def test_document_sections(spark):
    assert one(spark, documents.review_section(F.lit(None).cast("string"), F.lit("CHANGES_REQUESTED"), F.lit(" why "))) == "Review by unknown reviewer: requested changes\n\nwhy"
    assert one(spark, documents.review_thread_section(F.lit(None).cast("string"), F.lit(True), F.lit(False))) == "Review thread on unknown path (resolved, current)"
    assert one(spark, documents.comment_section(F.lit(""), F.lit("x"))) == "Comment:\n\nx"


def test_empty_tables(spark):
    threads = spark.createDataFrame([], "thread_id bigint, number bigint, host string, repo_id string, full_name string, kind string, state string, title string, body string, label string, created_at_us bigint, updated_at_us bigint")
    cov = spark.createDataFrame([], "thread_id bigint, family string, status string")
    assert [r["applicable"] for r in listing.coverage_totals(threads, cov).collect()] == [0] * 5
    assert listing.page(threads, listing.sort_order("updated"), 10).count() == 0
    assert search.keyword_search(threads, search.plain_expression("a")).count() == 0
    jobs = spark.createDataFrame([], "run_id int, status string, family string, resolved boolean")
    assert [r["unresolved"] for r in ledger.unresolved_by_family(jobs).collect()] == [0] * 5


@pytest.mark.parametrize("fold", [150, 100_000])
def test_long_chains_of_clusters_keep_their_ids(spark, monkeypatch, fold):
    """Of equal overlaps in a chain only the first pair is best for both its sides."""
    monkeypatch.setattr(clustering, "FOLD_PAIRS", fold)
    n = 400
    generated = spark.createDataFrame([(k, 2 * k + i) for k in range(n) for i in (0, 1)], "cluster bigint, thread_id bigint")
    existing = spark.createDataFrame([(k, 2 * k + 1 + i) for k in range(n) for i in (0, 1)], "cluster bigint, thread_id bigint")
    got = clustering.match_identities(clustering.overlaps(generated, existing)).collect()
    assert sorted((r["generated_id"], r["existing_id"]) for r in got) == [(k, k) for k in range(n)]


def found(spark, expression, *rows):
    df = spark.createDataFrame([(i, t, b) for i, (t, b) in enumerate(rows)], "thread_id int, title string, body string").coalesce(1)
    return sorted(r[0] for r in search.keyword_search(df, search.parse_expression(expression)).select("thread_id").collect())


@pytest.mark.parametrize(("expression", "hits"), [
    ("NEAR(alpha beta, 2)", [0, 1]), ("NEAR(alpha beta, 3)", [0, 1, 2]), ("NEAR(beta alpha)", [0, 1, 2]), ('NEAR("alpha x" beta, 1)', [0]), ("NEAR(alp* beta, 0)", [1]), ("near alpha", []),
    ("^alpha", [0, 2, 4]), ("^beta", [1, 3]), ("alpha + x", [0, 2]), ("{title body}: alpha", [0, 1, 2, 4]), ("title: alpha", [4]), ("-title: alpha", [0, 1, 2]), ("- {body}: alpha", [4]),
    ("title: (alpha OR nothing)", [4]), ("body: NEAR(alpha beta, 2)", [0, 1]), ("title: NEAR(alpha beta, 9)", []), ("NEAR(beta)", [0, 1, 2, 3]),
])
def test_advanced_expressions(spark, expression, hits):
    assert found(spark, expression, (None, "alpha x y beta"), ("t", "beta alpha"), ("", "alpha x y z beta"), ("beta", "gamma"), ("alpha", "q")) == hits


@pytest.mark.parametrize("bad", ["NEAR(a b, x)", "NEAR(a b", "NEAR()", "other: a", "{title: a", "- a", "a +", "^", "title:"])
def test_bad_advanced_expressions_are_refused(bad):
    with pytest.raises(search.QuerySyntaxError):
        search.parse_expression(bad)


def test_index_equals_a_fresh_scan(spark, tmp_path):
    """Inserts, changes, removals, returns of what was removed, and merges, each against scanning the threads as they are then."""
    import random

    from threadloom.operators.search_index import SearchIndex
    from threadloom.sources.store import StoreError

    rng, schema = random.Random(3), "thread_id bigint, title string, body string"
    words = ["alpha", "beta", "bet", "gamma", "délta"]
    new = lambda i: (i, rng.choice((None, "", " ".join(rng.choices(words, k=2)))), rng.choice((None, " ".join(rng.choices(words, k=rng.randint(1, 9))))))
    now = {i: new(i) for i in range(30)}
    index = SearchIndex.create(spark.createDataFrame(list(now.values()), schema), str(tmp_path / "i"), 4)

    def check():
        rows = spark.createDataFrame(list(now.values()), schema)
        for expression in ("alpha beta", 'title: "beta gamma" OR bet*', "NEAR(alpha delta, 2) NOT gamma"):
            tree = search.parse_expression(expression)
            want = {(r["thread_id"], round(r["bm25"], 9)) for r in search.keyword_search(rows, tree).collect()}
            assert {(r["thread_id"], round(r["bm25"], 9)) for r in index.find(tree).collect()} == want, expression

    check()
    for step in range(4):
        changed = {i: new(i) for i in rng.sample(range(40), 6)}
        removed = [i for i in rng.sample(sorted(now), 4) if i not in changed]
        now = {i: r for i, r in (now | changed).items() if i not in removed}
        index.apply(spark.createDataFrame(list(changed.values()), schema), spark.createDataFrame([(i,) for i in removed], "thread_id bigint"))
        if step == 2:
            index.merge()
            assert len(index.segments) == 2
    check()
    index = SearchIndex(spark, index.path)
    index.merge(whole=True)
    check()
    assert len(index.segments) == 1 and index.live()[1].count() == len(now)
    assert len(index.vacuum()) == 6
    check()
    with pytest.raises(StoreError):
        SearchIndex(spark, str(tmp_path / "none"))


def test_requests_search_the_index(spark, sf, tmp_path):
    from threadloom.operators.search_index import SearchIndex
    from threadloom.sources.archive import relation
    from threadloom.workflows import Archive, Filters

    t = relation(spark, sf, "threads")
    index = SearchIndex.create(t, str(tmp_path / "i"), 8)
    f = Filters(sort="relevance", state="open", repositories=("org/src1", "org/src2"))
    ask = lambda a: [(r["thread_id"], round(r["bm25"], 9), r["position"]) for r in a.search_threads("with", f).collect()]
    assert ask(Archive(threads=t, index=index)) == ask(Archive(threads=t)) != []
    comments = relation(spark, sf, "comments")
    health = lambda a: {r["check_name"]: r["violations"] for r in a.doctor().collect()}["index_apart_from_threads"]
    assert health(Archive(threads=t, comments=comments, index=index)) == 0
    assert health(Archive(threads=t.where("thread_id <> 5").unionByName(t.where("thread_id = 5").withColumn("thread_id", F.lit(-5).cast("long"))), comments=comments, index=index)) == 2


def test_cosines_of_all_kinds_of_vectors(spark):
    from threadloom.functions import vectors

    rows = [(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [3.0, 3.0]), (4, None), (5, []), (6, [1.0]), (7, [0.0, 0.0]), (8, [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    raw = spark.createDataFrame([(i, bytearray(vectors.to_bytes(v)) if v and any(v) else None if v is None else bytearray(4 * len(v))) for i, v in rows], "id int, v binary")
    for source in (df, raw):
        got = {r["id"]: (None if r["score"] is None else round(r["score"], 6), r["fits"]) for r in vectors.with_cosine(source, "v", [1.0, 0.0]).collect()}
        assert got == {1: (1.0, True), 2: (0.0, True), 3: (0.707107, True), 4: (None, False), 5: (None, False), 6: (None, False), 7: (None, True), 8: (-1.0, True)}
        assert [r["id"] for r in vectors.nearest(source, "id", "v", [1.0, 0.0], 2).collect()] == [1, 3]
    assert vectors.with_cosine(df.where("false"), "v", [1.0]).count() == 0


def test_configuration():
    from threadloom import config

    got = config.parse('[archive]\npath = "x"\n[embeddings]\ndimensions = 8\nbatch_size = 2\n')
    assert (got.archive.path, got.embeddings.dimensions, got.embeddings.batch_size, got.documents.recipe) == ("x", 8, 2, "discussion_enriched")
    for bad in ("[archiv]\n", "[archive]\nfolder = 'x'\n", "[embeddings]\nbatch_size = 'two'\n", "archive = 3\n", "[archive\n"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_dense_index_and_keyset_pages(spark):
    from threadloom.operators import ordering

    df = spark.createDataFrame([((i * 7919) % 1000,) for i in range(1000)], "k bigint").repartition(7)
    assert [(r["k"], r["index"]) for r in ordering.dense_index(df, ["k"]).orderBy("k").collect()] == [(i, i) for i in range(1000)]
    seen, after = [], None
    while True:
        page, after = ordering.keyset_page(df, "k", after, 150, F.col("k") % 200 > 150)
        seen += [r["k"] for r in page.collect()]
        if after is None:
            break
    assert seen == [k for k in range(1000) if k % 200 > 150]


def test_heads_belong_to_reviews(spark):
    cov = spark.createDataFrame([(1, "reviews", "complete", 5, 1, "a")], "thread_id int, family string, status string, clock int, item_count int, head_sha string")
    held = spark.createDataFrame([(1, "reviews")], "thread_id int, family string")
    want = lambda *rows: spark.createDataFrame(rows, "thread_id int, family string, expected_clock int, current_head string")
    ask = lambda *rows: [r["reusable"] for r in observations.current_for_head(cov, held, want(*rows)).collect()]
    assert ask((1, "reviews", 5, "a")) == [True] and ask((1, "reviews", 5, "b")) == [False] and ask((1, "reviews", 5, None)) == [False] and ask((1, "reviews", 4, "a")) == [False]
    with pytest.raises(Exception, match="head"):
        ask((1, "comments", 5, "a"))


def test_pages_beyond_any_prefix(spark, monkeypatch):
    rows = spark.range(1000).select(F.col("id").alias("k"))
    order = [F.col("k").desc()]
    assert listing.page(rows, order, 10, 1 << 40).collect() == []
    monkeypatch.setattr(listing, "DEEP", 100)
    deep = listing.page(rows, order, 3, 500).orderBy("position").collect()
    assert [(r["k"], r["position"], r["next_offset"]) for r in deep] == [(499, 500, 503), (498, 501, 503), (497, 502, 503)]
    last = listing.page(rows, order, 3, 998).orderBy("position").collect()
    assert [(r["k"], r["next_offset"]) for r in last] == [(1, None), (0, None)]


def test_ledger_rules(spark):
    stages = spark.createDataFrame([(1, "sync", 1, "failed"), (1, "embeddings", 2, "deferred"), (2, "sync", 1, "complete"), (3, "sync", 1, "interrupted"), (3, "clusters", 3, "failed"), (4, "sync", 1, "deferred")], "refresh_id int, stage string, position int, status string")
    got = {r["refresh_id"]: tuple(r)[1:] for r in ledger.refresh_outcomes(stages).collect()}
    assert got == {1: ("partial", None, 2, 1, "sync,embeddings"), 2: ("complete", None, None, None, ""), 3: ("interrupted", 2, None, None, "sync,clusters"), 4: ("partial", None, 1, 1, "sync")}
    runs = spark.createDataFrame([(1, "failed"), (1, "deferred"), (2, "failed"), (3, "deferred"), (3, "deferred"), (4, "complete"), (4, "interrupted")], "batch int, outcome string")
    assert {r["batch"]: r["status"] for r in ledger.retry_summaries(runs, "batch").collect()} == {1: "partial", 2: "failed", 3: "deferred", 4: "interrupted"}


def test_failures_touched_by_a_retry(spark):
    schema = "failure_id int, run_id int, repository string, thread bigint, target string, family string, scope_key string, resolved boolean, retry_count int, retry_run int"
    f = spark.createDataFrame([
        (1, 1, None, None, "o/r", "threads", "open", False, 0, None), (2, 9, None, None, "o/r", "threads", "open", False, 0, None), (3, 1, None, None, "o/r", "threads", "open", True, 0, None), (4, 2, None, None, "o/r", "threads", "open", False, 0, 4),
        (5, 1, "R", 7, "x", "comments", "open", False, 0, None), (6, 1, "R", 8, "x", "comments", "open", False, 0, None), (7, 1, "R", None, "o/r", "threads", "open", False, 0, None), (8, 1, None, None, "o/r", None, "open", False, 0, None),
    ], schema)
    scopes = f.where("failure_id IN (1, 5)")
    assert {r["failure_id"]: (r["retry_count"], r["retry_run"]) for r in ledger.mark_retried(f, scopes, 9).where("retry_count > 0").collect()} == {1: (1, 9), 4: (1, 9), 5: (1, 9)}
    after = {r["failure_id"]: (r["resolved"], r["retry_run"]) for r in ledger.resolve(f, scopes, 9).collect()}
    assert {k for k, v in after.items() if v[0]} == {1, 3, 4, 5} and after[4] == (True, 4) and after[1] == (True, 9) and after[3] == (True, None) and after[2] == (False, None)
    runs = spark.createDataFrame([(1, "default", True, True, False)], "run_id int, thread_scope string, include_comments boolean, include_reviews boolean, include_review_threads boolean")
    jobs = spark.createDataFrame([], "run_id int, target string, family string, scope_key string, job_no int, repo_id string")
    lost = f.where("failure_id = 8").withColumn("target", F.lit("no target"))
    with pytest.raises(Exception, match="no target"):
        ledger.retry_scopes(lost, jobs, runs).collect()
    plan = ledger.retry_scopes(f.where("failure_id IN (1, 8)").withColumn("scope_key", F.lit("weird")), jobs, runs).first()
    assert (plan["scope"], plan["include_comments"], plan["include_reviews"], plan["include_review_threads"], plan["failure_ids"]) == ("default", True, True, False, [1, 8])


def test_equal_failures_each_have_their_repository(spark):
    from threadloom.operators import ledger

    row = [(1, "org/a", "comments", "", None), (1, "org/a", "comments", "", None), (1, "org/a", None, "open", None), (1, "org/a", None, "open", "own"), (2, "org/a", "comments", "", None), (None, "no target", None, None, None)]
    failures = spark.createDataFrame(row * 2, "run_id int, target string, family string, scope_key string, repository string")
    jobs = spark.createDataFrame([(1, "org/a", "comments", "open", 4, "second"), (1, "org/a", "comments", "closed", 3, "first"), (3, "org/a", "comments", "open", 1, "other")], "run_id int, target string, family string, scope_key string, job_no int, repo_id string")
    got = sorted(map(str, (r["found"] for r in ledger.repository_of_failures(failures, jobs).collect())))
    assert got == sorted(["first"] * 4 + ["second"] * 2 + ["own"] * 2 + ["org/a"] * 2 + ["None"] * 2)
