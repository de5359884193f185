"""Keyword, semantic and hybrid search."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import ACCENTED, FOLDED, keyword_terms, search_tokens
from threadloom.functions.vectors import with_cosine
from threadloom.operators.listing import sort_order

# BM25's constants, and the constant of reciprocal rank fusion.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
RRF = 60
MOST_RANKED = 10_000
_FOLD = str.maketrans(ACCENTED[: len(FOLDED)], FOLDED, ACCENTED[len(FOLDED) :])


class QuerySyntaxError(ValueError):
    """An advanced expression that can't be read."""


COLUMNS = ("title", "body")


@dataclass(frozen=True)
class Phrase:
    """Tokens one after another; first: only at a column's beginning; columns: where it counts (None: everywhere)."""

    tokens: tuple[str, ...]
    prefix: bool = False
    columns: tuple[str, ...] | None = None
    first: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases of one column with at most `distance` tokens between the end of one and the last one's beginning."""

    phrases: tuple[Phrase, ...]
    distance: int
    columns: tuple[str, ...] | None = None


@dataclass(frozen=True)
class Part:
    """A phrase of a Near: it counts where the others are near."""

    near: Near
    number: int


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    left: object
    right: object


def fold(text: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}\p{Co}]+", text.translate(_FOLD).lower())


def parse_expression(text: str):
    """Advanced expressions: phrases, AND (also implied), OR, NOT and parentheses with the usual precedence; prefix*;
    phrase + phrase; ^phrase at a column's beginning; NEAR(phrases, distance); column filters name:, {name name}:, -name:.
    """
    import re

    lexed = re.findall(r'"(?:[^"]|"")*"|[(){},:+^*]|-(?=\s*[\w{])|[^\s(){},:+^*"]+', text)
    if text.count('"') % 2:
        raise QuerySyntaxError("a quote is not closed")
    pos = 0

    def peek(ahead=0):
        return lexed[pos + ahead] if pos + ahead < len(lexed) else None

    def take(wanted=None):
        nonlocal pos
        if wanted and peek() != wanted:
            raise QuerySyntaxError(f"expected {wanted}, found {peek() or 'the end'}")
        pos += 1
        return lexed[pos - 1]

    def named(columns):
        """The columns of a filter that begins here, or None; a filter inside another one narrows it."""
        nonlocal pos
        back, negative, names = pos, False, []
        if peek() == "-":
            take()
            negative = True
        if peek() == "{":
            take()
            while peek() not in ("}", None):
                names.append(take())
            take("}")
        elif peek() is not None:
            names.append(take())
        if peek() != ":":
            pos = back
            if negative:
                raise QuerySyntaxError("- stands before a column filter only")
            return None
        take()
        names = [n.strip('"').lower() for n in names]
        if not names or any(n not in COLUMNS for n in names):
            raise QuerySyntaxError(f"no such column among {names}")
        return tuple(c for c in columns or COLUMNS if (c in names) != negative)

    def phrase(columns, first=False):
        tokens = []
        while True:
            t = peek()
            if t is None or t in "(){},:+^*-" or t in ("AND", "OR", "NOT"):
                raise QuerySyntaxError(f"unexpected {t or 'end'}")
            take()
            tokens += fold(t[1:-1].replace('""', '"') if t[0] == '"' else t)
            if peek() != "+":
                break
            take()
        prefix = peek() == "*"
        if prefix:
            take()
        if not tokens:
            raise QuerySyntaxError("a phrase without a term")
        return Phrase(tuple(tokens), prefix, columns, first)

    def primary(columns=None):
        if peek() == "(":
            take()
            inner = either(columns)
            take(")")
            return inner
        if peek() in ("-", "{") or (peek(1) == ":" and peek() not in (None, "(", ")", ":")):
            own = named(columns)
            if own is None:
                raise QuerySyntaxError("a column filter without a colon")
            return primary(own)
        if peek() == "NEAR" and peek(1) == "(":
            take()
            take()
            found, distance = [], 10
            while peek() not in (")", ",", None):
                found.append(phrase(None))
            if peek() == ",":
                take()
                number = take() if peek() else ""
                if not number.isdigit():
                    raise QuerySyntaxError("the distance of NEAR is no number")
                distance = int(number)
            take(")")
            if not found:
                raise QuerySyntaxError("NEAR without phrases")
            return Near(tuple(found), distance, columns) if len(found) > 1 else Phrase(found[0].tokens, found[0].prefix, columns)
        first = peek() == "^"
        if first:
            take()
        return phrase(columns, first)

    def negated(columns=None):
        out = primary(columns)
        while peek() == "NOT":
            take()
            out = Node("not", out, primary(columns))
        return out

    def both(columns=None):
        out = negated(columns)
        while peek() not in (None, ")", "OR"):
            if peek() == "AND":
                take()
            out = Node("and", out, negated(columns))
        return out

    def either(columns=None):
        out = both(columns)
        while peek() == "OR":
            take()
            out = Node("or", out, both(columns))
        return out

    if not lexed:
        raise QuerySyntaxError("empty expression")
    tree = either()
    if peek() is not None:
        raise QuerySyntaxError(f"unexpected {peek()}")
    return tree


def plain_expression(query: str):
    """All terms of a plain query must match; a term that the tokenizer splits is a phrase. None without terms."""
    phrases = [Phrase(tuple(fold(t))) for t in keyword_terms(query)]
    tree = None
    for p in (p for p in phrases if p.tokens):
        tree = p if tree is None else Node("and", tree, p)
    return tree


def leaves_of(tree) -> list[Phrase | Part]:
    """What is counted and scored: phrases, and each phrase of a Near by itself."""
    if tree is None:
        return []
    if isinstance(tree, Phrase):
        return [tree]
    if isinstance(tree, Near):
        return [Part(tree, i) for i in range(len(tree.phrases))]
    return leaves_of(tree.left) + leaves_of(tree.right)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body names it inside a function over an array."""
    return F.transform(F.array(value), lambda x: body(x))[0]


def phrase_places(tokens: Column, p: Phrase) -> Column:
    """Where a phrase begins in a token array."""
    n = len(p.tokens)

    def here(own, i):
        tests = [F.get(own, i + k) == t for k, t in enumerate(p.tokens)]
        if p.prefix:
            tests[-1] = F.get(own, i + n - 1).startswith(p.tokens[-1])
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return F.coalesce(out, F.lit(False))

    def places(own):
        last = F.lit(0) if p.first else F.greatest(F.size(own) - n, F.lit(0))
        return F.filter(F.sequence(F.lit(0), last), lambda i: here(own, i))

    return let(tokens, places)


def phrase_count(tokens: Column, p: Phrase) -> Column:
    """How often a phrase stands in a token array."""
    if len(p.tokens) == 1 and not p.first:
        return F.size(F.filter(tokens, (lambda t: t.startswith(p.tokens[0])) if p.prefix else (lambda t: t == p.tokens[0])))
    return F.size(phrase_places(tokens, p))


def near_count(places: list[Column], near: Near, number: int) -> Column:
    """How many places of one phrase of a Near lie near places of all others.

    Places count together when each phrase begins at or before the last of them, its end at most `distance` before it.
    """

    sizes = [len(x.tokens) for x in near.phrases]

    def within(at, size, last):
        return F.exists(at, lambda p: (p <= last) & (p + size + near.distance >= last))

    def together(each, last):
        reach = [within(at, size, last) for at, size in zip(each, sizes)]
        out = reach[0]
        for r in reach[1:]:
            out = out & r
        return out

    def counted(s):
        each = [s[f"p{i}"] for i in range(len(sizes))]
        lasts = F.filter(F.array_distinct(F.concat(*each)), lambda last: together(each, last))
        near_last = lambda p, found: F.exists(found, lambda last: (p <= last) & (p + sizes[number] + near.distance >= last))
        return let(lasts, lambda found: F.size(F.filter(each[number], lambda p: near_last(p, found))))

    return let(F.struct(*[at.alias(f"p{i}") for i, at in enumerate(places)]), counted)


def _matches(tree, hits: dict) -> Column:
    if isinstance(tree, Phrase):
        return hits[tree] > 0
    if isinstance(tree, Near):
        return hits[Part(tree, 0)] > 0
    left, right = _matches(tree.left, hits), _matches(tree.right, hits)
    return {"and": left & right, "or": left | right, "not": left & ~right}[tree.op]


def _columns(leaf) -> list[str]:
    chosen = leaf.near.columns if isinstance(leaf, Part) else leaf.columns
    return [c for c in COLUMNS if chosen is None or c in chosen]


def _bm25(leaves: list, length: Column, stats: str) -> Column:
    """Smaller is better. stats is a struct column of _n, _avg and _d0, _d1, ...; counts are the columns _f0, _f1, ..."""
    score = F.lit(0.0)
    for i in range(len(leaves)):
        n, d = F.col(f"{stats}._n"), F.col(f"{stats}._d{i}")
        idf = F.greatest(F.log((n - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"_f{i}").cast("double")
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / F.col(f"{stats}._avg")))
    return -score


def keyword_search(threads: DataFrame, tree, eligible: Column | None = None) -> DataFrame:
    """threads that match, with bm25 (smaller is better); statistics are over all threads.

    One pass counts each phrase in each thread; the counts, a few numbers a thread, are written, and statistics and scores come from
    them, so texts are taken apart once. Archives that are searched often keep an index instead (search_index.py).
    """
    if tree is None:
        return threads.withColumn("bm25", F.lit(None).cast("double")).where(F.lit(False))
    from threadloom.operators.clustering import _kept

    leaves = list(dict.fromkeys(leaves_of(tree)))
    rows = threads.select("thread_id", search_tokens(F.col("title")).alias("_title"), search_tokens(F.col("body")).alias("_body"))
    counts = []
    for i, leaf in enumerate(leaves):
        if isinstance(leaf, Part):
            parts = [near_count([phrase_places(F.col(f"_{c}"), p) for p in leaf.near.phrases], leaf.near, leaf.number) for c in _columns(leaf)]
        else:
            parts = [phrase_count(F.col(f"_{c}"), leaf) for c in _columns(leaf)]
        counts.append(sum(parts[1:], parts[0]).alias(f"_f{i}") if parts else F.lit(0).alias(f"_f{i}"))
    counted = _kept(rows.select("thread_id", (F.size("_title") + F.size("_body")).alias("_len"), *counts))
    stats = counted.agg(F.count("*").alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_f{i}") > 0).alias(f"_d{i}") for i in range(len(leaves))])
    hit = counted.where(_matches(tree, {p: F.col(f"_f{i}") for i, p in enumerate(leaves)}))
    scored = hit.select("*", stats.select(F.struct("*")).scalar().alias("_s")).select("thread_id", _bm25(leaves, F.col("_len"), "_s").alias("bm25"))
    return (threads if eligible is None else threads.where(eligible)).join(scored, "thread_id").select(*threads.columns, "bm25")


def ranked(found: DataFrame, sort: str, k: int, rank: str) -> DataFrame:
    """The first k in the requested order, ranked from 1."""
    order = sort_order(sort, matched=True)
    return found.orderBy(*order).limit(k).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def complete_documents(chunks: DataFrame) -> DataFrame:
    """Thread ids whose chunk set is whole: one count and size, indexes 0 to count - 1."""
    size = F.size("vector")
    return chunks.groupBy("thread_id").agg(
        F.count("*").alias("n"), F.min("chunk_count").alias("lo"), F.max("chunk_count").alias("hi"), F.min(size).alias("s"), F.max(size).alias("t"), F.count_distinct("chunk_index").alias("u"), F.max("chunk_index").alias("last"), F.min("chunk_index").alias("first")
    ).where("lo = hi AND n = lo AND s = t AND u = n AND first = 0 AND last = n - 1").select("thread_id")


def best_chunk(chunks: DataFrame, query: list[float]) -> DataFrame:
    """thread_id, score: the best cosine of a document's chunks; a chunk of another size drops the document."""
    scored = with_cosine(chunks.select("thread_id", "vector"), "vector", query, "s")
    best = scored.groupBy("thread_id").agg(F.max("s").alias("score"), F.bool_and("fits").alias("fits"))
    return best.where("fits AND score > 0 AND NOT isnan(score)").select("thread_id", "score")


def window_size(limit: int, offset: int) -> int:
    """How many candidates a ranked page needs; pages beyond MOST_RANKED are refused."""
    if limit < 1 or offset < 0 or offset + limit > MOST_RANKED:
        raise ValueError(f"offset + limit must lie between 1 and {MOST_RANKED}")
    return offset + limit + 1


def semantic_order(sort: str) -> list[Column]:
    head = {"updated": F.col("updated_at_us").desc(), "created": F.col("created_at_us").desc()}.get(sort, F.col("score").desc())
    return [head, F.col("host"), F.col("repo_id"), F.col("thread_id").cast("string"), F.col("number")]


def semantic_search(threads: DataFrame, chunks: DataFrame, query: list[float], sort: str, k: int) -> DataFrame:
    """threads by their best chunk, the first k, with score and semantic_rank."""
    order = semantic_order(sort)
    return threads.join(best_chunk(chunks, query), "thread_id").orderBy(*order).limit(k).withColumn("semantic_rank", F.row_number().over(Window.orderBy(*order)))


def fused(keyword: DataFrame, semantic: DataFrame, sort: str = "relevance") -> DataFrame:
    """Reciprocal rank fusion: each source gives 1 / (60 + rank); the keyword side's columns win."""
    columns = [c for c in keyword.columns if c not in ("bm25", "keyword_rank", "thread_id")]
    k, s = keyword.alias("k"), semantic.alias("s")
    part = lambda c: F.coalesce(1 / (RRF + F.col(c)), F.lit(0.0))
    both = k.join(s, "thread_id", "full_outer").select("thread_id", *[F.coalesce(f"k.{c}", f"s.{c}").alias(c) for c in columns], "keyword_rank", "semantic_rank", (part("keyword_rank") + part("semantic_rank")).alias("score"))
    return both.orderBy(*semantic_order(sort))


def hybrid_search(threads: DataFrame, chunks: DataFrame, tree, query: list[float], sort: str = "relevance", limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the fusion; each source is cut to the window before."""
    k = window_size(limit, offset)
    keyword = ranked(keyword_search(threads, tree), sort, k, "keyword_rank")
    semantic = semantic_search(threads, chunks, query, sort, k)
    order = semantic_order(sort)
    top = fused(keyword, semantic, sort).limit(k)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
    return numbered.where((F.col("position") >= offset) & (F.col("position") < offset + limit))


def finite_positive(scored: DataFrame, score: str = "score") -> DataFrame:
    """Rows whose score is a finite number above 0."""
    x = F.col(score)
    return scored.where((x > 0) & ~F.isnan(x) & (x < float("inf")))
