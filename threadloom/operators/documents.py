"""Documents of discussions: rendering, chunks, hashes and what is to be embedded anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.functions.hashing import chunk_hash, content_hash
from threadloom.functions.text import chunks_in, dedupe_text, trimmed

# How review states read in a document.
REVIEW_STATES = {"APPROVED": "approved", "CHANGES_REQUESTED": "requested changes", "COMMENTED": "commented", "DISMISSED": "dismissed", "PENDING": "pending"}


def nonempty(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t != "", t)


def without_bots(rows: DataFrame, user_type: str = "user_type") -> DataFrame:
    """rows whose author isn't said to be a bot, in whatever case; authors of no known type are people."""
    return rows.where(~F.coalesce(F.lower(user_type) == "bot", F.lit(False)))


def comment_section(author: Column, body: Column) -> Column:
    """`Comment by X:` and the body; null for an empty body."""
    head = F.when(trimmed(F.coalesce(author, F.lit(""))) != "", F.concat(F.lit("Comment by "), author, F.lit(":"))).otherwise(F.lit("Comment:"))
    return F.when(trimmed(body) != "", F.concat(head, F.lit("\n\n"), trimmed(body)))


def review_section(reviewer: Column, state: Column, body: Column) -> Column:
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in REVIEW_STATES.items() for x in kv]), state), state)
    return F.concat_ws("\n\n", F.concat(F.lit("Review by "), F.coalesce(reviewer, F.lit("unknown reviewer")), F.lit(": "), label), nonempty(body))


def review_thread_section(path: Column, resolved: Column, outdated: Column) -> Column:
    return F.concat(F.lit("Review thread on "), F.coalesce(path, F.lit("unknown path")), F.lit(" ("), F.when(resolved, "resolved").otherwise("unresolved"), F.lit(", "), F.when(outdated, "outdated").otherwise("current"), F.lit(")"))


def render(threads: DataFrame, comments: DataFrame | None = None, complete: DataFrame | None = None, recipe: str = "original_body", version: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """thread_id, title, text, dedupe_text, content_hash, and the columns of threads to keep.

    With comments and complete (thread ids whose comments are complete and not stale) the text is enriched with the
    comments of authors that are no bots, by time and identity.
    """
    title = trimmed(F.coalesce("title", F.lit("")))
    rows = threads.withColumn("title", title)
    said = F.lit(None).cast("string")
    if comments is not None:
        mine = comments.where(~F.coalesce(F.col("is_bot"), F.lit(False))).select("thread_id", "created_at_us", "provider_id", comment_section(F.col("author"), F.col("body")).alias("section"))
        if complete is not None:
            mine = mine.join(complete.select("thread_id").distinct(), "thread_id", "left_semi")
        mine = mine.where("section IS NOT NULL").groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("created_at_us", "provider_id", "section"))).alias("s"))
        rows = rows.join(mine, "thread_id", "left")
        said = F.array_join(F.transform("s", lambda s: s["section"]), "\n\n")
    labels = F.when(trimmed(F.coalesce("label", F.lit(""))) != "", F.concat(F.lit("Labels: "), trimmed(F.col("label"))))
    text = F.concat_ws("\n\n", F.when(F.col("title") != "", F.concat(F.lit("# "), "title")), nonempty(F.col("body")), labels, said)
    rows = rows.withColumn("text", text)
    digest = content_hash(F.lit(recipe), F.lit(version), F.col("host"), F.col("repo_id"), F.col("thread_id").cast("string"), F.col("number"), F.col("title"), F.col("text"))
    return rows.select("thread_id", "title", "text", dedupe_text(F.col("text")).alias("dedupe_text"), digest.alias("content_hash"), *keep)


def child_sections(comments: DataFrame, reviews: DataFrame, review_threads: DataFrame) -> DataFrame:
    """thread_id, family, order (a struct), section: what each child adds to an enriched document, in render order.

    Comments by time and id; reviews by time, undated last, and id; review threads by path, line and id, unknown ones
    first, with their comments (provider_id, author, is_bot, body, created_at_us) below them. Bots say nothing.
    """
    no_bot = lambda c: ~F.coalesce(c, F.lit(False))
    order = lambda n, undated, at, text, line, key: F.struct(F.lit(n).alias("n"), undated.alias("u"), at.alias("at"), text.alias("t"), line.alias("l"), key.alias("k"))
    none, no = F.lit(None).cast("string"), F.lit(None).cast("long")
    said = comments.where(no_bot(F.col("is_bot"))).select("thread_id", F.lit("comments").alias("family"), order(0, F.lit(False), F.col("created_at_us"), none, no, F.col("provider_id")).alias("order"), comment_section(F.col("author"), F.col("body")).alias("section"))
    judged = reviews.where(no_bot(F.col("is_bot"))).select("thread_id", F.lit("reviews").alias("family"), order(1, F.col("submitted_at_us").isNull(), F.col("submitted_at_us"), none, no, F.col("provider_id")).alias("order"), review_section(F.col("reviewer"), F.col("state"), F.col("body")).alias("section"))
    talk = F.array_sort(F.filter("comments", lambda c: no_bot(c["is_bot"])), lambda a, b: F.when(F.struct(a["created_at_us"], a["provider_id"]) < F.struct(b["created_at_us"], b["provider_id"]), -1).when(F.struct(a["created_at_us"], a["provider_id"]) > F.struct(b["created_at_us"], b["provider_id"]), 1).otherwise(0))
    lines = F.array_compact(F.transform(talk, lambda c: comment_section(c["author"], c["body"])))
    head = review_thread_section(F.col("path"), F.col("is_resolved"), F.col("is_outdated"))
    talked = review_threads.select("thread_id", F.lit("review_threads").alias("family"), order(2, F.lit(False), no, F.col("path"), F.col("line").cast("long"), F.col("provider_id")).alias("order"), F.array_join(F.concat(F.array(head), lines), "\n\n").alias("section"))
    return said.unionByName(judged).unionByName(talked).where("section IS NOT NULL")


def render_enriched(threads: DataFrame, sections: DataFrame, current: DataFrame, recipe: str = "discussion_enriched", version: int = 1) -> DataFrame:
    """render() with the sections of the families that are complete and not stale (current: thread_id, family)."""
    mine = sections.join(current.select("thread_id", "family").distinct(), ["thread_id", "family"], "left_semi")
    per = mine.groupBy("thread_id").agg(F.sort_array(F.collect_list(F.struct("order", "section"))).alias("s"))
    said = per.select("thread_id", F.array_join(F.transform("s", lambda s: s["section"]), "\n\n").alias("_said"))
    base = render(threads).select("thread_id", "title", F.col("text").alias("_base"))
    rows = threads.drop("title").join(base, "thread_id").join(said, "thread_id", "left")
    rows = rows.withColumn("text", F.concat_ws("\n\n", F.when(F.col("_base") != "", F.col("_base")), "_said"))
    digest = content_hash(F.lit(recipe), F.lit(version), F.col("host"), F.col("repo_id"), F.col("thread_id").cast("string"), F.col("number"), F.col("title"), F.col("text"))
    return rows.select("thread_id", "title", "text", dedupe_text(F.col("text")).alias("dedupe_text"), digest.alias("content_hash"))


def chunks_of(documents: DataFrame, max_bytes: int) -> DataFrame:
    """thread_id, chunk_index, chunk_count, chunk, chunk_hash."""
    cut = chunks_in(documents.select("thread_id", "text"), "text", max_bytes)
    return cut.select("thread_id", "chunk_index", "chunk_count", "chunk", chunk_hash(F.col("chunk_index"), F.col("chunk")).alias("chunk_hash"))


def pending_chunks(wanted: DataFrame, stored: DataFrame) -> DataFrame:
    """Chunks that no stored one of equal index, count and hash makes unnecessary."""
    return wanted.join(stored.select("thread_id", "chunk_index", "chunk_count", "chunk_hash"), ["thread_id", "chunk_index", "chunk_count", "chunk_hash"], "left_anti")
