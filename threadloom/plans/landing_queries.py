"""Queries over landed pages: provider records made from the archive's relations, written as pages, read through the data source."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from threadloom.operators import documents
from threadloom.operators.clustering import shared_folder
from threadloom.plans.archive_queries import EPOCH_US, HOST, NL2, SECTIONS_SQL, SQL, TRIM, query
from threadloom.sources import landing, pages
from threadloom.sources.archive import coverage, relation, with_relations
from threadloom.streaming import scans

SINCE = EPOCH_US + 1_800_000_000_000


def when(us: str):
    """An instant as a provider writes it; relations keep whole seconds."""
    return f"date_format(to_utc_timestamp(timestamp_micros({us}), current_timezone()), \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"


def record(rows, **fields: str):
    """A column `record` of JSON from SQL expressions; nulls are left out, as providers do."""
    return rows.withColumn("record", F.to_json(F.struct(*[F.expr(e).alias(n) for n, e in fields.items()])))


def issues(s, d):
    rows = record(
        relation(s, d, "threads"), id="thread_id", number="number", state="state", title="title", body="body", user="named_struct('login', concat('u', cast(number % 7 AS string)), 'type', CASE WHEN number % 11 = 0 THEN 'Bot' ELSE 'User' END, 'id', number % 7)",
        comments="thread_id % 6", created_at=when("created_at_us"), updated_at=when("updated_at_us"), closed_at=f"CASE WHEN state = 'closed' THEN {when('updated_at_us')} END",
        labels="array(named_struct('name', label), named_struct('name', 'second'))", assignees="array(named_struct('login', CASE WHEN number % 3 = 0 THEN NULL ELSE 'a1' END))", pull_request="CASE WHEN kind = 'pull_request' THEN named_struct('url', 'u') END",
    )
    return rows.select("repo_id", F.lit("issues").alias("kind"), F.lit(None).cast("bigint").alias("thread_id"), "state", "updated_at_us", "record", "number")


def landed(s, *collections) -> str:
    """A fresh folder with collections of (rows, order)."""
    path = f"{shared_folder(s)}/landed-{uuid.uuid4().hex}"
    for rows, order in collections:
        pages.land(rows, path, order)
    return path


@query("A1_A7_A8_landed_threads", f"""SELECT thread_id, number, repo_id, kind, state, title, md5(body) AS body_md5, label || ', second' AS label, CASE WHEN number % 3 = 0 THEN 0 ELSE 1 END AS n_assignees, created_at_us, updated_at_us,
NULL::BIGINT AS closed_at_us, thread_id % 6 AS expected_comments FROM threads WHERE state = 'open' AND updated_at_us >= {SINCE}""", "threads")
def _(s, d):
    """Pages of a hundred in order of update; those that hold nothing open and new enough are not opened."""
    path = landed(s, (issues(s, d), [F.col("updated_at_us").desc(), F.col("number")]))
    found = landing.threads(landing.records(pages.read_pages(s, path, "issues", "open", SINCE), "issues").drop("thread_id"), HOST)
    return found.select("thread_id", "number", "repo_id", "kind", "state", "title", F.md5("body").alias("body_md5"), "label", F.size("assignees").alias("n_assignees"), "created_at_us", "updated_at_us", "closed_at_us", "expected_comments")


@query("A6_A8_landed_repositories", f"""SELECT repo_id, 'org' AS owner, repo_id AS name, 'org/' || repo_id AS full_name, CASE WHEN repo_id LIKE '%1' THEN NULL ELSE 'main' END AS default_branch, max(updated_at_us) AS updated_at_us FROM threads GROUP BY repo_id""", "threads")
def _(s, d):
    rows = relation(s, d, "threads").groupBy("repo_id").agg(F.max("updated_at_us").alias("updated_at_us"))
    rows = record(rows, id="abs(xxhash64(repo_id))", name="repo_id", full_name="CASE WHEN repo_id LIKE '%2' THEN NULL ELSE concat('org/', repo_id) END", default_branch="CASE WHEN repo_id LIKE '%1' THEN NULL ELSE 'main' END", updated_at=when("updated_at_us"), owner="named_struct('login', 'org')")
    path = landed(s, (rows.select("repo_id", F.lit("repositories").alias("kind"), F.lit(None).cast("bigint").alias("thread_id"), F.lit(None).cast("string").alias("state"), "updated_at_us", "record"), [F.col("record")]))
    found = landing.records(pages.read_pages(s, path, "repositories"), "repositories").withColumnRenamed("repo_id", "page_of")
    return landing.repositories(found, HOST).join(found.select(F.col("id").cast("string").alias("repo_id"), "page_of"), "repo_id").select(F.col("page_of").alias("repo_id"), "owner", "name", "full_name", "default_branch", "updated_at_us")


@query("A3_A8_landed_pull_requests", "SELECT thread_id, number, repo_id, lower(sha) AS head_sha, CASE WHEN number % 4 = 0 THEN NULL ELSE repo_id END AS head_repo, 'main' AS base_name, number % 2 = 0 AS draft, number % 5 = 0 AS merged FROM (SELECT *, upper(md5(title)) || '00000000' AS sha FROM threads WHERE kind = 'pull_request')", "threads")
def _(s, d):
    t = relation(s, d, "threads").where("kind = 'pull_request'").withColumn("rid", F.expr("cast(substr(repo_id, 4) AS bigint)"))
    sha = "concat(upper(md5(title)), '00000000')"
    rows = record(t, id="thread_id", number="number", draft="number % 2 = 0", merged="number % 5 = 0", base=f"named_struct('ref', 'main', 'sha', {sha}, 'repo', named_struct('id', rid))", head=f"named_struct('ref', 'topic', 'sha', {sha}, 'repo', CASE WHEN number % 4 = 0 THEN NULL ELSE named_struct('id', rid) END)")
    path = landed(s, (rows.select("repo_id", F.lit("pulls").alias("kind"), "thread_id", F.lit(None).cast("string").alias("state"), F.lit(None).cast("bigint").alias("updated_at_us"), "record"), [F.col("record")]))
    found = landing.pull_requests(landing.records(pages.read_pages(s, path, "pulls"), "pulls"))
    return found.select("thread_id", "number", F.concat(F.lit("src"), F.col("base.repo_id")).alias("repo_id"), "head_sha", F.concat(F.lit("src"), F.col("head.repo_id")).alias("head_repo"), F.col("base.name").alias("base_name"), "draft", "merged")


def children(s, d):
    """Comments, reviews and review threads as pages of their threads; every second comment of a review thread is on a further page."""
    user = lambda login, bot: f"named_struct('login', {login}, 'type', CASE WHEN {bot} THEN 'Bot' ELSE 'User' END, 'id', 1)"
    said = record(relation(s, d, "comments"), id="cast(provider_id AS bigint)", body="body", created_at=when("created_at_us"), user=user("author", "is_bot"))
    judged = record(relation(s, d, "reviews"), id="cast(provider_id AS bigint)", state="state", body="body", submitted_at=when("submitted_at_us"), user=user("reviewer", "is_bot"))
    node = f"named_struct('id', concat('c', provider_id), 'body', body, 'createdAt', {when('created_at_us')}, 'author', named_struct('login', author, '__typename', CASE WHEN author = 'system' THEN 'Bot' ELSE 'User' END))"
    far = "cast(provider_id AS int) % 2 = 1"
    talk = relation(s, d, "review_threads")
    threads = record(talk, id="concat('t', cast(thread_id AS string), '.', provider_id)", isResolved="is_resolved", isOutdated="is_outdated", path="path", line="line", comments=f"named_struct('nodes', CASE WHEN {far} THEN array() ELSE array({node}) END, 'pageInfo', named_struct('hasNextPage', {far}, 'endCursor', CASE WHEN {far} THEN 'more' END))")
    further = record(talk.where(far), id="concat('c', provider_id)", body="body", createdAt=when("created_at_us"), author="named_struct('login', author, '__typename', CASE WHEN author = 'system' THEN 'Bot' ELSE 'User' END)", parent="concat('t', cast(thread_id AS string), '.', provider_id)")
    collection = lambda rows, kind: (rows.select(F.lit("src").alias("repo_id"), F.lit(kind).alias("kind"), "thread_id", F.lit(None).cast("string").alias("state"), F.lit(None).cast("bigint").alias("updated_at_us"), "record"), [F.col("record")])
    return [collection(said, "comments"), collection(judged, "reviews"), collection(threads, "review_threads"), collection(further, "review_thread_comments")]


@query("A2_A4_A5_A9_landed_documents")
def _(s, d):
    """From landed JSON to enriched documents: pages of all four child collections, normalized, in render order."""
    path = landed(s, *children(s, d))
    rows = lambda kind: landing.records(pages.read_pages(s, path, kind), kind)
    more = rows("review_thread_comments").withColumn("parent", F.get_json_object("record", "$.parent"))
    sections = documents.child_sections(landing.comments(rows("comments")), landing.reviews(rows("reviews")), landing.review_threads(rows("review_threads"), more))
    whole = coverage(s, d).where("status = 'complete'").select("thread_id", "family")
    current = whole.unionByName(whole.where("family = 'reviews'").select("thread_id", F.lit("review_threads").alias("family")))
    return documents.render_enriched(relation(s, d, "threads"), sections, current).select("thread_id", "text")


# Review threads carry the thread in their identity, so they order as t<thread>.<turn> does.
SQL["A2_A4_A5_A9_landed_documents"] = with_relations("", "threads", "comments", "reviews", "review_threads").rstrip() + f""",
{SECTIONS_SQL},
cur AS (SELECT thread_id, family FROM coverage WHERE status = 'complete' UNION ALL SELECT thread_id, 'review_threads' FROM coverage WHERE status = 'complete' AND family = 'reviews'),
said AS (SELECT s.thread_id, string_agg(section, {NL2} ORDER BY n, u, tm NULLS FIRST, t NULLS FIRST, l NULLS FIRST, k) AS said FROM sec s SEMI JOIN cur c ON c.thread_id = s.thread_id AND c.family = s.family WHERE section IS NOT NULL GROUP BY s.thread_id)
SELECT t.thread_id, concat_ws({NL2}, CASE WHEN {TRIM('title')} <> '' THEN '# ' || {TRIM('title')} END, CASE WHEN {TRIM('body')} <> '' THEN {TRIM('body')} END, 'Labels: ' || label, said) AS text FROM threads t LEFT JOIN said USING (thread_id)"""


@query("B18_H29_payload_fields", "SELECT number, repo_id, 'u' || (number % 7) AS login, CASE WHEN number % 11 = 0 THEN 'Bot' ELSE 'User' END AS user_type, (number % 7)::VARCHAR AS user_id, thread_id % 6 AS comments, kind = 'pull_request' AS is_pull_request, label AS first_label, NULL::BIGINT AS missing FROM threads", "threads")
def _(s, d):
    """Fields of whole records, kept as VARIANT: nested ones, one of another type, and one that isn't there."""
    path = landed(s, (issues(s, d), [F.col("number")]))
    p = pages.read_pages(s, path, "issues").withColumn("payload", landing.payload_of())
    at = lambda path, kind: landing.field("payload", path, kind)
    return p.select(
        at("$.number", "bigint").alias("number"), "repo_id", at("$.user.login", "string").alias("login"), at("$.user.type", "string").alias("user_type"), at("$.user.id", "string").alias("user_id"),
        at("$.comments", "bigint").alias("comments"), at("$.pull_request.url", "string").isNotNull().alias("is_pull_request"), at("$.labels[0].name", "string").alias("first_label"), at("$.title", "bigint").alias("missing"),
    )


def scan_events(s, d):
    """The scan log with addresses that repeat within some scans, and the time of each event."""
    return relation(s, d, "scan_log").selectExpr("repo_id", "sequence", "arrival", "action", "threads", "CASE WHEN cursor IS NOT NULL THEN concat('page', cast(arrival % 23 AS string)) END AS cursor", "status", "arrival * 1000 AS at_us")


@query("J3_J7_I8_I9_running_scan")
def _(s, d):
    """The log as a stream in four micro-batches that mix early and late events and repeat a fifth of them."""
    base = f"{shared_folder(s)}/scan-{uuid.uuid4().hex}"
    log = scan_events(s, d)
    for i in range(4):
        log.where(f"arrival * 7 % 4 = {i} OR arrival * 7 % 20 = {i}").coalesce(1).write.mode("append").parquet(f"{base}/log")
    stream = s.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/log")
    scans.start(stream, f"{base}/states", f"{base}/checkpoint").awaitTermination()
    return scans.latest(s, f"{base}/states")


PAST = "(PARTITION BY repo_id, sequence ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
SQL["J3_J7_I8_I9_running_scan"] = with_relations("", "scan_log").rstrip() + f""",
ev AS (SELECT repo_id, sequence, arrival, action, threads, CASE WHEN cursor IS NOT NULL THEN 'page' || (arrival % 23) END AS cursor, status, arrival * 1000 AS at_us FROM scan_log),
b AS (SELECT *, coalesce(max((action = 'begin')::INT) OVER {PAST}, 0) = 1 AS began FROM ev),
l AS (SELECT *, nullif(last_value(CASE WHEN action = 'begin' OR (action = 'page' AND began) THEN coalesce(cursor, '-') END IGNORE NULLS) OVER {PAST}, '-') AS leftover FROM b),
e AS (SELECT *, action = 'finish' AND began AND NOT (status = 'complete' AND leftover IS NOT NULL) AS ends FROM l),
f AS (SELECT *, coalesce(max(ends::INT) OVER {PAST}, 0) = 1 AS ended FROM e),
p AS (SELECT *, action = 'page' AND began AND NOT ended AS page FROM f),
per AS (SELECT repo_id, sequence, count(*) FILTER (page) AS pages, coalesce(sum(threads) FILTER (page), 0)::BIGINT AS threads, nullif(max_by(coalesce(cursor, '-'), arrival) FILTER (page OR action = 'begin'), '-') AS cursor,
  coalesce(min_by(status, arrival) FILTER (ends AND NOT ended), 'in_progress') AS status, min_by(at_us, arrival) FILTER (action = 'begin') AS at_us FROM p GROUP BY repo_id, sequence HAVING bool_or(action = 'begin')),
back AS (SELECT q.repo_id, q.sequence, count(DISTINCT q.arrival) AS revisited FROM p q JOIN p r ON r.repo_id = q.repo_id AND r.sequence = q.sequence AND r.page AND q.page AND r.arrival <= q.arrival AND r.leftover = q.cursor GROUP BY ALL),
mark AS (SELECT repo_id, max_by(at_us, sequence) AS watermark_us, max(sequence) AS watermark_sequence FROM per WHERE status = 'complete' GROUP BY repo_id)
SELECT per.repo_id, per.sequence, pages, threads, cursor, status, coalesce(revisited, 0) AS revisited, watermark_us, watermark_sequence
FROM (SELECT * FROM per QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY sequence DESC) = 1) per LEFT JOIN back USING (repo_id, sequence) LEFT JOIN mark USING (repo_id)"""
