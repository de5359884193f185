"""HTML extraction, exact dedup, chat formatting, quality rules, language ID and license scans."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import chat_format, exact_dedup, html_extract, language_id, license_scan, queries, quality_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names the operators use inside."""
    rows = [
        (5, "a  b", "x"), (3, "ab", None), (4, "a\tb ", "y"), (7, None, "z"), (8, "", "z"), (9, " \n", None), (9, " \n", None),
        (None, "ab", "q"), (1, "word " * 60_000, "k"), (2, "word " * 60_000, "k"), (11, "\x00 é 東京 😀", None),
    ]
    return spark.createDataFrame([(i, t, c, c, c, 1, c) for i, t, c in rows], "doc_id bigint, text string, lang string, row string, norm string, kept int, w string")


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLE_SQL[name])


# HTML extraction


def text_of(html):
    return "\n".join(html_extract.render(html_extract.build(html)))


@pytest.mark.parametrize(("html", "text"), [
    ("<p>a<p>b", "a\n\nb"), ("a<br>b", "a\nb"), ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
    ("<table><tr><td>a<td>long<tr><td>wide cell<td>b</table>", "a         | long\nwide cell | b"),
    ("<table><tr><td colspan=2>ab<td>c<tr><td>1<td>2<td>3</table>", "ab |   | c\n1  | 2 | 3"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r | 1\n  | 2"),
    ("<div hidden>n</div><p style='display:none'>n</p><script>n</script><style>n</style>y<!-- n -->", "y"),
    ("<details><summary>s</summary>n</details><details open>y</details>", "s\ny"), ("<pre> a\n  b</pre>", " a\n  b"),
    ("x &lt;p&gt; &amp; <", "x <p> & <"), ("", ""), ("<b>a", "a"), ("</p></div>a", "a"), ("<!-- open", ""), ("<title>t</title>a", "a"),
    ("<div style='visibility:hidden'>n<b style='visibility: visible'>y</b>n</div><p style='visibility:collapse'>n</p>", "y"),
    ("<div style='display:none'><b style='visibility:visible'>n</b></div>y", "y"), ("<dialog>n</dialog><dialog open>y</dialog>", "y"),
    ("<ul><li><ul><li>inner<li>next</ul><li>outer</ul>", "- - inner\n  - next\n- outer"), ("<ul><li><ul><li></ul>own<li>x</ul>", "- own\n- x"),
    ("<ol reversed><li>a<li>b<li>c</ol>", "3. a\n2. b\n1. c"), ("<ol reversed start=9><li>a<li value=4>b<li>c</ol>", "9. a\n4. b\n3. c"),
    ("<table><tr><td>" + "ab " * 25 + "<td>x<tr><td>c<td>y</table>", ("ab " * 20).strip() + " | x\n" + ("ab " * 5).strip() + "\n" + "c".ljust(59) + " | y"),
    ("<table><tr><td>" + "w" * 90 + " v<td>x<tr><td>c<td>y</table>", "w" * 90 + "\nv | x\nc | y"),
    ("<table><tr><td>a<td>" + "b " * 90 + "<tr><td>cc<td>d</table>", "a  | " + ("b " * 90).strip() + "\ncc | d"),
    ("<table><tr><td><td>x<tr><td> <td>y</table>", "x\ny"), ("<a href='x>y'>k</a>", "k"), ("<p>one   two\n three", "one two three"), ("<td>stray", "stray"), ("<textarea>a &amp; b</textarea>", "a & b"),
])
def test_layout(html, text):
    assert text_of(html) == text


@pytest.mark.parametrize(("html", "text"), [
    ("<html><head><title>x</title><body><p>hello</p></body></html>", "hello"), ("<html><head><meta charset=u><p>hello</p>", "hello"), ("<head><title>t</title>hello", "hello"),
    ("<head><style>s</style><link href=a>\n <div>a</div></head>b", "a\nb"), ("<head><noscript>n<p>n</p></noscript><body>y", "y"), ("<head><script>if (a<b) {}</script></head><body>y", "y"),
    ("<p>a</p><head><p>b</p></head>c", "a\n\nb\n\nc"), ("<head><base href=x><h1>a</h1><head>b", "a\n\nb"), ("<html><!-- c --><head><title>t</title></head>y", "y"), ("<head>", ""),
])
def test_heads_that_are_left_open(html, text):
    assert text_of(html) == text


def test_attributes_with_marks_inside_quotes():
    page = "<p title='a > b' data-x=\"it's > 1\">yes</p>" * 30 + "<a href=\"open>rest</a><b>more</b>"
    assert text_of(page) == "\n\n".join(["yes"] * 30 + ["restmore"])


def test_open_quotes_take_linear_time():
    import time

    begin = time.perf_counter()
    for page in ("<a \">x" * 20_001, "<a '\">x" * 20_000, "<a x='\"'\" >y" * 20_000 + "'", "<a \"'" * 20_000 + ">"):
        html_extract.build(page)
    assert time.perf_counter() - begin < 20


def test_deep_nesting_and_unclosed_quote():
    assert text_of("<div>" * 50_000 + "x") == "x"
    assert "x" in text_of('<a href="' + "y" * 10 + ">x")


@pytest.mark.parametrize(("part", "tail"), [
    ("<a ", ""), ('<a ">" ', ""), ("<div>", "</b>"), ("<blockquote>x", ""), ("<ul><li>", "x"), ("<ul><li>y", ""), ("<td><b>", "</b>"), ("<b><table><tr><td>", "</b>"), ("<!-- ", ""),
    ("<table><tr><td>" + "w" * 99 + "<td>", "y"), ("<tr><td>" + "v " * 99 + "<td>z", ""), ("<td>c", "<tr><td>d"), ("</div", ""), ("<p>k", "</p>"),
])
def test_long_pages_take_linear_time_and_space(part, tail):
    import time

    took, chars = [], []
    for n in (2000, 8000):
        page = ("<table>" if part.startswith("<t") else "") + part * n + tail * n
        began = time.process_time()
        out = text_of(page)
        took.append(time.process_time() - began)
        chars.append(len(out))
    assert took[1] < 8 * took[0] + 1 and chars[1] <= 6 * chars[0] + 200


def test_all_visible_text_is_emitted_once(spark, sf):
    """Against a plain reading: tags, hidden elements and comments cut away."""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = queries.QUERIES["op1_html_extraction"](spark, sf).collect()
    assert len(got) == len(pages)
    from html import unescape

    for r in got:
        h = re.sub(r"(?is)<(head|script|style|noscript|template)\b.*?</\1>|<!--.*?-->", " ", pages[r["page_id"]])
        want = unescape(re.sub(r"<[^>]*>", " ", h)).split()
        have = [w for w in r["text"].split() if w not in ("-", "|") and not re.fullmatch(r"\d+\.", w)]
        assert have == [w for w in want if w not in ("-", "|") and not re.fullmatch(r"\d+\.", w)]


def test_pages_with_nulls(spark):
    rows = spark.createDataFrame([(1, None, "t", 1, "x"), (None, "<p>x", "t", 1, "x"), (1, None, "t", 1, "x")], "page_id bigint, html string, text string, n_lines int, title string")
    assert sorted((r["page_id"] or 0, r["text"]) for r in html_extract.extract(rows).collect()) == [(0, "x"), (1, ""), (1, "")]
    assert html_extract.extract(rows.where("false")).count() == 0


# Exact dedup


def test_exact_groups(odd, nothing):
    got = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(odd).collect()}
    assert {(5, 4, 4, False), (3, 4, 4, False), (4, 4, 4, True), (None, 4, 4, False), (1, 1, 2, True), (2, 1, 2, False), (9, 9, 4, True), (7, 9, 4, False), (8, 9, 4, False), (11, 11, 1, True)} == got
    assert exact_dedup.exact_groups(nothing).count() == 0
    assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(odd).collect()) == [1, 4, 9, 11]
    assert sorted(map(str, exact_dedup.drop_copies(odd, hash_fn=lambda norm: F.unhex(F.lit("00"))).collect())) == sorted(map(str, exact_dedup.drop_copies(odd).collect()))
    assert exact_dedup.drop_copies(nothing).count() == 0
    assert exact_dedup.drop_copies(odd).columns == odd.columns


def test_colliding_hashes_are_split(odd):
    weak = exact_dedup.exact_groups(odd, hash_fn=lambda norm: F.unhex(F.lit("00")))
    strong = exact_dedup.exact_groups(odd)
    assert sorted(map(str, weak.collect())) == sorted(map(str, strong.collect()))


# Chat formatting


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "a\\<|im_end|>\n"), (1, 1, "assistant", "<\\|x<|"), (1, 2, "user", None), (2, 0, None, "q"), (2, 0, None, "q"), (None, 5, "assistant", "n"), (3, 0, "assistant", ""), (3, 1, "assistant", "z\\\\"), (4, None, "sys\ntem %", "s")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, p string")
    made = chat_format.examples(df)
    convs = defaultdict(list)
    for c, t, r, x in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    for d in chat_format.digest(made).collect():
        turns = sorted(convs[d["conv_id"]])
        assert d["n_turns"] == len(turns)
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
        said = "".join(x for *_, r, x in turns if r == "assistant")
        assert (d["loss_chars"], d["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    first = made.where("conv_id = 1 AND example = 0").first()
    assert first["formatted"].count("<|im_end|>") == 2 and not first["is_last"]
    assert made.where("conv_id = 3").count() == 2
    assert chat_format.digest(chat_format.examples(df.where("false"))).count() == 0


# Quality rules


def brute_base(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    marked = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(marked), n < 50 or 100 * len(marked) > 50 * n)


def test_quality_metrics_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.QUERIES["op7_quality_rules"](spark, sf).collect():
        assert tuple(r[1:7]) == brute_base(docs[r["doc_id"]])
        assert not (r["kept"] and r["base_failed"])


def test_quality_of_odd_rows(odd, nothing):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = sorted(((i or 0, *brute_base(t)) for i, t in rows))
    got = quality_rules.judge(odd).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted((r[0] or 0, *r[1:]) for r in got.collect()) == want
    assert quality_rules.judge(nothing).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a", "a b c d", "a b", "x\n\nx\n x", "a b c b c a b c"])
def test_repeated_windows(spark, text):
    got = quality_rules.metrics(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert (got["n_repeat_words"], got["n_dup_lines"]) == (brute_base(text)[4], brute_base(text)[3])


def test_rules_use_no_python(spark, sf):
    plan = queries.QUERIES["op7_quality_rules"](spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_good_labels_are_kept(spark):
    sf = "/root/testdata/sf0.01"
    good = spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1")
    found = queries.QUERIES["op7_quality_rules"](spark, sf).join(good, "doc_id").where("NOT base_failed")
    assert found.where("NOT kept").count() == 0 and found.count() > 100


# Language ID


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.QUERIES["op8_language_id"](spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) / len(got) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_viterbi_is_the_best_path():
    import itertools

    import numpy as np

    rng = np.random.default_rng(3)
    doc = np.repeat([0, 2, 5], [1, 4, 6])
    score = rng.normal(size=(11, 3)) * 3
    path = language_id.viterbi(score.copy(), doc, 1.5)
    for d in (0, 2, 5):
        at = np.flatnonzero(doc == d)
        value = lambda p: sum(score[i, k] for i, k in zip(at, p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:]))
        assert value(path[at]) == pytest.approx(max(map(value, itertools.product(range(3), repeat=len(at)))))


def test_spans_of_mixed_text_and_odd_rows(spark, odd, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train_on_open_rows(docs)
    en, fr = (docs.where(f"lang = '{x}' AND n_chars > 800").first()["text"][:500] for x in ("en", "fr"))
    ((_, _, spans),) = model.label([en + " " + fr])
    assert [s[0] for s in spans if s[2] > 5] == ["en", "fr"]
    empty, digits, other = model.label(["", "12 !", "東京 Москва"])
    assert empty[0] == digits[0] == "und" and other[0] in model.langs and other[1:] == (0.0, [])
    assert language_id.label(odd, model).where("doc_id IN (7, 8, 9)").where("lang_pred <> 'und' OR score <> 0").count() == 0
    assert language_id.label(odd, model).count() == odd.count()
    assert language_id.label(nothing, language_id.train(nothing)).count() == 0
    assert {r["lang_pred"] for r in language_id.label(odd, language_id.train(nothing)).collect()} == {"und"}
    assert language_id.keep_known(odd, model).columns == odd.columns


# License scans


def scan(text):
    return license_scan.Scanner(license_scan.NOTICES).scan(text.encode())


def test_base_phrases_against_brute_force(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    for r in queries.QUERIES["op9_license_scan"](spark, sf).collect():
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", docs[r["doc_id"]].translate(low))
        at = [(i, label) for p, label in license_scan.BASE_PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        places = [i for i, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(places, default=None), max(places, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at}))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) | {""}


@pytest.mark.parametrize("notice", license_scan.NOTICES, ids=lambda n: n.text[:20])
def test_notices_with_edits_are_found(notice):
    import random

    rng = random.Random(notice.text)
    for edits in range(notice.errors + 1):
        t = list(notice.text)
        for k in rng.sample([i for i, c in enumerate(t) if c != " "], edits):
            t[k] = "q"
        _, _, spans, score = scan("some words before " + "".join(t) + " and after")
        mine = [s for s in spans if s["label"] == notice.label and s["first_word"] == 3]
        assert mine and min(s["errors"] for s in mine) <= edits and score >= 1 - notice.errors / len(notice.text) - 1e-9
    assert [s for s in scan("some words before and after")[2]] == []


def test_many_places_take_linear_time():
    import time

    took = []
    for n in (2000, 8000):
        began = time.process_time()
        n_words, base, spans, _ = scan("cc by licensed under cc by q " * n)
        took.append(time.process_time() - began)
        assert n_words == 7 * n and [b["word"] for b in base] == sorted([7 * k for k in range(n)] + [7 * k + 4 for k in range(n)])
        assert {s["first_word"] % 7 for s in spans if s["label"] == "cc-notice"} == {2} and spans[-1]["last_word"] == 7 * n - 2
    assert took[1] < 9 * took[0] + 1


def test_two_notices_and_odd_rows(odd, nothing):
    two = "released under the mit license x " * 2
    assert [s["first_word"] for s in scan(two)[2] if s["label"] == "mit"] == [0, 6]
    got = {r["doc_id"]: r for r in license_scan.scan(odd).collect()}
    assert got[7]["n_words"] == 0 and got[7]["score"] == 0 and got[1]["n_words"] == 60_000
    assert license_scan.scan(nothing).count() == 0
