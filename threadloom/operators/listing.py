"""Thread lists, coverage, timelines and archive status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import ascii_lower
from threadloom.sources.archive import FAMILIES

SORTS = ("relevance", "updated", "created")
#: The longest prefix of an order that a page sorts for.
DEEP = 100_000


def check_page(limit: int, offset: int) -> None:
    """A page holds 1 to 1000 rows; offsets fit a signed 64-bit number."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must lie between 1 and 1000")
    if not 0 <= offset < 1 << 63:
        raise ValueError("offset out of range")


def in_scope(repositories: list[tuple[str, str]]) -> Column:
    """host and repo_id are among the given pairs; no pairs, no restriction."""
    if not repositories:
        return F.lit(True)
    return F.struct("host", "repo_id").isin([F.struct(F.lit(h).alias("host"), F.lit(r).alias("repo_id")) for h, r in repositories]) if len(repositories) > 64 else _any(
        [(F.col("host") == h) & (F.col("repo_id") == r) for h, r in repositories]
    )


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def filtered(threads: DataFrame, repositories=(), kind: str | None = None, state: str = "all", updated_since_us: int | None = None) -> DataFrame:
    """Scope, kind, state (all keeps states it doesn't know) and an inclusive lower bound of the update time."""
    out = threads.where(in_scope(list(repositories)))
    if kind:
        out = out.where(F.col("kind") == kind)
    if state != "all":
        out = out.where(F.col("state") == state)
    if updated_since_us is not None:
        out = out.where(F.col("updated_at_us") >= updated_since_us)
    return out


def sort_order(sort: str, matched: bool = False) -> list[Column]:
    """The tie chain of lists; relevance without a match is by update time."""
    tail = [ascii_lower(F.col("full_name")), F.col("host"), F.col("number").desc(), F.col("thread_id")]
    head = {"created": [F.col("created_at_us").desc()], "updated": [F.col("updated_at_us").desc()]}.get(sort)
    if head is None:
        head = [F.col("bm25"), F.col("updated_at_us").desc()] if matched else [F.col("updated_at_us").desc()]
    return head + tail


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """Rows offset .. offset + limit of an order with their position, and next_offset where another row follows.

    Top-k over the prefix of the order; one row more than the page tells whether there is a next one. A prefix longer than DEEP rows is
    numbered in ranges of the order instead, so pages at any offset can be asked for.
    """
    check_page(limit, offset)
    if offset + limit >= DEEP:
        from threadloom.operators.ordering import dense_index

        every = dense_index(rows, order, "position")
        mine = every.where((F.col("position") >= offset) & (F.col("position") <= offset + limit))
        more = mine.agg(F.max("position").alias("m")).select((F.col("m") == offset + limit).alias("more")).scalar()
        return mine.where(F.col("position") < offset + limit).withColumn("next_offset", F.when(more, F.lit(offset + limit).cast("long")))
    head = rows.orderBy(*order).limit(offset + limit + 1)
    from pyspark.sql import Window

    numbered = head.select("*", (F.row_number().over(Window.orderBy(*order)) - 1).alias("position"), F.count("*").over(Window.partitionBy(F.lit(1))).alias("found"))
    next_offset = F.when(F.col("found") > offset + limit, F.lit(offset + limit).cast("long"))
    return numbered.where((F.col("position") >= offset) & (F.col("position") < offset + limit)).withColumn("next_offset", next_offset).drop("found")


def ordered_repositories(repositories: DataFrame) -> DataFrame:
    """Repositories with their position: by host, owner, name (A-Z and a-z alike) and id."""
    from threadloom.operators.ordering import dense_index

    part = lambda n: ascii_lower(F.split_part("full_name", F.lit("/"), F.lit(n)))
    return dense_index(repositories, [F.col("host"), part(1), part(2), F.col("repo_id")], "position")


def find_repository(threads: DataFrame, full_name: str) -> DataFrame:
    """Repositories of a name, A-Z and a-z alike."""
    return threads.where(ascii_lower(F.col("full_name")) == ascii_lower(F.lit(full_name))).select("host", "repo_id", "full_name").distinct()


def applicable_families(threads: DataFrame) -> DataFrame:
    """One row for each thread and family that applies to its kind; a row is exploded, nothing is joined."""
    families = F.array(*[F.struct(F.lit(f).alias("family"), F.lit(p).alias("only"), F.lit(i).alias("rank")) for i, (f, p) in enumerate(FAMILIES)])
    each = threads.select("*", F.explode(F.filter(families, lambda f: ~f["only"] | (F.col("kind") == "pull_request"))).alias("f"))
    return each.select(*threads.columns, F.col("f.family").alias("family"), F.col("f.rank").alias("rank"))


def with_coverage(threads: DataFrame, coverage: DataFrame) -> DataFrame:
    """Thread x applicable family with its recorded status, `missing` where there is none."""
    return applicable_families(threads).join(coverage, ["thread_id", "family"], "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def coverage_totals(threads: DataFrame, coverage: DataFrame) -> DataFrame:
    """family, applicable, missing, incomplete, complete; every family has a row."""
    spark = threads.sparkSession
    counted = with_coverage(threads.select("thread_id", "kind"), coverage).groupBy("family").agg(
        F.count("*").alias("applicable"), *[F.count_if(F.col("status") == s).alias(s) for s in ("missing", "incomplete", "complete")]
    )
    names = spark.createDataFrame([(f, i) for i, (f, _) in enumerate(FAMILIES)], "family string, rank int")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("applicable", "missing", "incomplete", "complete")]
    return names.join(counted, "family", "left").select("family", "rank", *zero)


def counts_by_kind(threads: DataFrame) -> DataFrame:
    return threads.agg(F.count("*").alias("threads"), F.count_if(F.col("kind") == "issue").alias("issues"), F.count_if(F.col("kind") == "pull_request").alias("pull_requests"))


def page_with_coverage(threads: DataFrame, coverage: DataFrame, sort: str, limit: int, offset: int = 0) -> DataFrame:
    """A page of threads with the coverage of each; the page is cut before coverage is joined."""
    rows = page(threads, sort_order(sort), limit, offset)
    states = with_coverage(rows.select("thread_id", "kind"), coverage).groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("rank", "family", "status"))).alias("c"))
    text = F.array_join(F.transform("c", lambda c: F.concat(c["family"], F.lit("="), c["status"])), ";")
    return rows.join(states.select("thread_id", text.alias("coverage")), "thread_id", "left")


def coverage_context(threads: DataFrame, coverage: DataFrame, heads: DataFrame) -> DataFrame:
    """Thread x applicable family with status and whether recorded child evidence no longer fits its parent.

    threads carry updated_at_us and expected_comments; coverage (thread_id, family, status, clock_us, item_count,
    head_sha) is compared with the thread's clock, and with the expected count (comments, where complete; an unknown
    count never fits) or with the current pull-request head (heads: thread_id, head_sha; reviews and their threads).
    """
    now = heads.select("thread_id", F.col("head_sha").alias("_head"))
    rows = applicable_families(threads.select("thread_id", "kind", "updated_at_us", "expected_comments")).join(coverage, ["thread_id", "family"], "left").join(now, "thread_id", "left")
    counted = (F.col("status") != "complete") | F.coalesce(F.col("expected_comments") == F.col("item_count"), F.lit(False))
    fits = F.when(F.col("family") == "comments", counted).when(F.col("family").isin("reviews", "review_threads"), F.col("head_sha").eqNullSafe(F.col("_head")))
    stale = F.coalesce(F.col("status"), F.lit("missing")).isin("incomplete", "complete") & fits.isNotNull() & ~(F.col("clock_us").eqNullSafe(F.col("updated_at_us")) & fits)
    return rows.select("thread_id", "family", F.coalesce("status", F.lit("missing")).alias("status"), F.coalesce(stale, F.lit(False)).alias("stale"))


def timeline(threads: DataFrame, comments: DataFrame, reviews: DataFrame | None = None, review_threads: DataFrame | None = None) -> DataFrame:
    """Events of threads: dated first, then kind of event, then identity; equal keys in order of origin.

    thread_id, position, at_us, code (0 thread, 1 comment, 2 review, 3 review thread, 4 its comments), key, wording.
    A review thread has the time of its first comment; its comments are (provider_id, author, body, created_at_us).
    """
    from pyspark.sql import Window

    seq = lambda n: F.lit(n).alias("seq")
    name = F.concat("repo_id", F.lit("#"), F.col("number").cast("string"))
    key = F.col("thread_id").cast("string").alias("key")
    parts = [
        threads.select("thread_id", F.col("created_at_us").alias("at_us"), F.lit(0).alias("code"), key, seq(0), F.concat(name, F.lit(" opened: "), "title").alias("wording")),
        threads.where("state = 'closed'").select("thread_id", F.col("updated_at_us").alias("at_us"), F.lit(0).alias("code"), key, seq(1), F.concat(name, F.lit(" closed")).alias("wording")),
    ]
    of = lambda rows: rows.join(threads.select("thread_id"), "thread_id", "left_semi")
    said = lambda head, author, body: F.concat(head, F.coalesce(author, F.lit("unknown author")), F.lit(": "), body)
    parts.append(of(comments).select("thread_id", F.col("created_at_us").alias("at_us"), F.lit(1).alias("code"), F.col("provider_id").alias("key"), seq(2), said(F.lit("comment by "), F.col("author"), F.col("body")).alias("wording")))
    if reviews is not None:
        state = F.lower(F.col("state"))
        body = F.coalesce(F.concat(F.lit(" — "), "body"), F.lit(""))
        words = F.concat(F.lit("review "), "provider_id", F.lit(" by "), F.coalesce("reviewer", F.lit("unknown reviewer")), F.lit(": "), state, body)
        parts.append(of(reviews).select("thread_id", F.col("submitted_at_us").alias("at_us"), F.lit(2).alias("code"), F.col("provider_id").alias("key"), seq(3), words.alias("wording")))
    if review_threads is not None:
        rows = of(review_threads)
        where = F.coalesce("path", F.lit("unknown path"))
        held = F.concat(F.when(F.col("is_resolved"), "resolved").otherwise("unresolved"), F.when(F.col("is_outdated"), ", outdated").otherwise(""))
        first = F.array_min(F.transform("comments", lambda c: c["created_at_us"]))
        parts.append(rows.select("thread_id", first.alias("at_us"), F.lit(3).alias("code"), F.col("provider_id").alias("key"), seq(4), F.concat(F.lit("review thread "), where, F.lit(": "), held).alias("wording")))
        each = rows.select("thread_id", "provider_id", where.alias("where"), held.alias("held"), F.explode("comments").alias("c"))
        words = said(F.concat(F.lit("review comment on "), "where", F.lit(" ("), "held", F.lit("), by ")), F.col("c.author"), F.col("c.body"))
        parts.append(each.select("thread_id", F.col("c.created_at_us").alias("at_us"), F.lit(4).alias("code"), F.concat("provider_id", F.lit(":"), "c.provider_id").alias("key"), seq(5), words.alias("wording")))
    order = Window.partitionBy("thread_id").orderBy(F.col("at_us").asc_nulls_last(), "code", "key", "seq")
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.select("thread_id", F.row_number().over(order).alias("position"), "at_us", "code", "key", "wording")


def children(rows: DataFrame, thread_id: int | None = None) -> DataFrame:
    """Members of a family by thread, in order of their identity as text."""
    from pyspark.sql import Window

    mine = rows if thread_id is None else rows.where(F.col("thread_id") == thread_id)
    return mine.withColumn("position", F.row_number().over(Window.partitionBy("thread_id").orderBy("provider_id")))


def thread_detail(threads: DataFrame, coverage: DataFrame, families: dict[str, DataFrame], host: str, repo_id: str, number: int) -> DataFrame:
    """One row: the thread of a repository with its coverage, the members of all its child families and its timeline.

    families: comments, reviews and review_threads as timeline() takes them, and pull_request_metadata; those missing are empty.
    Members are arrays in order of their identity; coverage is an array of (rank, family, status).
    """
    one = threads.where((F.col("host") == host) & (F.col("repo_id") == repo_id) & (F.col("number") == number))
    ids = one.select("thread_id")
    states = with_coverage(one.select("thread_id", "kind"), coverage).groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("rank", "family", "status"))).alias("coverage"))
    out = one.join(states, "thread_id", "left")
    for name in ("comments", "pull_request_metadata", "reviews", "review_threads"):
        rows = families.get(name)
        if rows is None:
            continue
        mine = rows.join(ids, "thread_id", "left_semi")
        order = [c for c in ("provider_id",) if c in rows.columns]
        item = F.struct(*order, *[c for c in rows.columns if c not in ("thread_id", *order)])
        out = out.join(mine.groupBy("thread_id").agg(F.sort_array(F.collect_list(item)).alias(name)), "thread_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))
    empty = threads.sparkSession.createDataFrame([], "thread_id bigint, provider_id string, author string, body string, created_at_us bigint")
    events = timeline(one, families.get("comments", empty), families.get("reviews"), families.get("review_threads"))
    line = events.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("position", "at_us", "code", "key", "wording"))).alias("timeline"))
    return out.join(line, "thread_id", "left")


def constraint_violations(threads: DataFrame, comments: DataFrame) -> DataFrame:
    """check_name, violations: rows that break a key, a reference or a domain. One pass over the threads and one over the comments."""
    keys = threads.groupBy("host", "repo_id", "number").agg(
        F.count("*").alias("n"), F.count_if(~F.coalesce(F.col("kind").isin("issue", "pull_request"), F.lit(False))).alias("kinds"),
        F.count_if((F.col("state") == "closed") & (F.col("updated_at_us") < F.col("created_at_us"))).alias("times"),
    ).agg(F.count_if(F.col("n") > 1).alias("duplicate_thread_identity"), F.coalesce(F.sum("kinds"), F.lit(0)).alias("unknown_kind"), F.coalesce(F.sum("times"), F.lit(0)).alias("closed_before_created"))
    orphans = comments.join(threads.select("thread_id"), "thread_id", "left_anti").agg(F.count("*").alias("violations")).select(F.lit("comment_without_thread").alias("check_name"), "violations")
    return keys.unpivot([], ["duplicate_thread_identity", "unknown_kind", "closed_before_created"], "check_name", "violations").unionByName(orphans)


def health(checks: DataFrame) -> DataFrame:
    """checks (check_name, violations) with `healthy`, and a last row `archive` that is healthy where all are."""
    each = checks.select("check_name", "violations", (F.col("violations") == 0).alias("healthy"))
    return each.unionByName(each.agg(F.lit("archive").alias("check_name"), F.sum("violations").alias("violations"), F.bool_and("healthy").alias("healthy")))


def eligible_threads(threads: DataFrame) -> DataFrame:
    """host, repo_id, eligible: the open threads that a repository's clusters may hold; repositories without any count 0."""
    return threads.groupBy("host", "repo_id").agg(F.count_if(F.col("state") == "open").alias("eligible"))


def first_seen(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The distinct keys, in the order in which rows first name them, with their position."""
    from threadloom.operators.ordering import dense_index

    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"))
    return dense_index(first, [F.col("_first"), *map(F.col, keys)], "position").drop("_first")
