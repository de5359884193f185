"""Queries of the archive, each beside the SQL that DuckDB checks it with."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from threadloom.functions import hashing, identity, text, vectors
from threadloom.operators import clustering, documents, generations, ledger, listing, observations, requests, search
from threadloom.sources.archive import EPOCH_US, HOST, coverage, relation, repositories, with_relations

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None, *names: str):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_relations(sql, *names)
        return f

    return keep


T = "thread_id, number, full_name, kind, state, created_at_us, updated_at_us"
FOLD = "translate(full_name, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TAIL = f"{FOLD}, host, number DESC, thread_id"


def cols():
    return [c.strip() for c in T.split(",")]


@query("B1_scope_filter", f"SELECT {T} FROM threads WHERE (host, repo_id) IN (('{HOST}', 'src1'), ('{HOST}', 'src2'))", "threads")
def _(s, d):
    return listing.filtered(relation(s, d, "threads"), [(HOST, "src1"), (HOST, "src2")]).select(*cols())


@query("B2_B3_kind_state", f"SELECT {T} FROM threads WHERE kind = 'pull_request' AND state = 'open'", "threads")
def _(s, d):
    return listing.filtered(relation(s, d, "threads"), kind="pull_request", state="open").select(*cols())


@query("B3_all_states", "SELECT kind, state, count(*) AS n FROM threads GROUP BY kind, state", "threads")
def _(s, d):
    return listing.filtered(relation(s, d, "threads")).groupBy("kind", "state").agg(F.count("*").alias("n"))


@query("B4_updated_since", f"SELECT {T} FROM threads WHERE updated_at_us >= {EPOCH_US + 1_800_000_000_000}", "threads")
def _(s, d):
    return listing.filtered(relation(s, d, "threads"), updated_since_us=EPOCH_US + 1_800_000_000_000).select(*cols())


@query("B6_repository_lookup", "SELECT DISTINCT host, repo_id, full_name FROM threads WHERE lower(full_name) = lower('ORG/Src3')", "threads")
def _(s, d):
    return listing.find_repository(relation(s, d, "threads"), "ORG/Src3")


@query("B10_blank_match", f"SELECT {T}, 0.0::DOUBLE AS bm25 FROM threads WHERE false", "threads")
def _(s, d):
    return search.keyword_search(relation(s, d, "threads"), search.plain_expression("***")).select(*cols(), "bm25")


@query("B12_finite_positive", "SELECT thread_id, chunk_index, round(list_cosine_similarity(vector, (SELECT embedding FROM embeddings WHERE vec_id = 0))::DOUBLE, 4) AS score FROM chunks WHERE list_cosine_similarity(vector, (SELECT embedding FROM embeddings WHERE vec_id = 0)) > 0 AND thread_id % 7 <> 0 AND thread_id % 11 <> 0 AND thread_id % 13 <> 0", "chunks")
def _(s, d):
    q = _vector(s, d, 0)
    c = relation(s, d, "chunks").select("thread_id", "chunk_index", vectors.cosine(F.col("vector"), F.array(*[F.lit(x) for x in q])).alias("score"))
    # Some scores are no numbers, infinite or 0.
    odd = c.withColumn("score", F.expr("CASE WHEN thread_id % 7 = 0 THEN double('NaN') WHEN thread_id % 11 = 0 THEN double('Infinity') WHEN thread_id % 13 = 0 THEN 0D ELSE score END"))
    return search.finite_positive(odd).withColumn("score", F.round("score", 4))


@query("B13_not_bots", "SELECT thread_id, provider_id, author FROM comments WHERE NOT (author = 'user' AND provider_id::INT % 4 IN (0, 2))", "comments")
def _(s, d):
    """User types in several cases, and unknown ones."""
    kind = F.expr("CASE WHEN author <> 'user' THEN CASE WHEN thread_id % 2 = 0 THEN 'User' END WHEN provider_id % 4 = 0 THEN 'BOT' WHEN provider_id % 4 = 2 THEN 'Bot' WHEN provider_id % 4 = 1 THEN 'robot' END")
    return documents.without_bots(relation(s, d, "comments").withColumn("user_type", kind)).select("thread_id", "provider_id", "author")


@query("B15_C3_C4_coverage", "SELECT t.thread_id, f.family, coalesce(c.status, 'missing') AS status FROM threads t JOIN families f ON NOT f.pull_request_only OR t.kind = 'pull_request' LEFT JOIN coverage c ON c.thread_id = t.thread_id AND c.family = f.family", "threads")
def _(s, d):
    return listing.with_coverage(relation(s, d, "threads"), coverage(s, d)).select("thread_id", "family", "status")


@query("B17_unresolved_failures", "SELECT run_id, job_no, part, family FROM jobs WHERE status = 'failed' AND NOT resolved AND family IN ('comments', 'reviews')", "jobs")
def _(s, d):
    return ledger.selected_failures(relation(s, d, "jobs").where("status = 'failed'"), ["comments", "reviews"]).select("run_id", "job_no", "part", "family")


@query("B22_stored_coverage", "SELECT t.thread_id, coalesce(c.status, 'missing') AS status FROM threads t LEFT JOIN coverage c ON c.thread_id = t.thread_id AND c.family = 'comments'", "threads")
def _(s, d):
    stored = coverage(s, d).where("family = 'comments'").select("thread_id", "status")
    return relation(s, d, "threads").select("thread_id").join(stored, "thread_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


@query("B23_B24_health", """WITH_CHECKS SELECT check_name, violations, violations = 0 AS healthy FROM ch UNION ALL SELECT 'archive', sum(violations)::BIGINT, bool_and(violations = 0) FROM ch""", "threads", "comments")
def _(s, d):
    """An archive with some of each fault."""
    t = relation(s, d, "threads").withColumn("number", F.expr("CASE WHEN thread_id % 50 = 21 THEN number - 20 ELSE number END")).withColumn("kind", F.expr("CASE WHEN thread_id % 40 = 3 THEN 'poll' WHEN thread_id % 40 = 4 THEN NULL ELSE kind END"))
    return listing.health(listing.constraint_violations(t, relation(s, d, "comments").withColumn("thread_id", F.expr("CASE WHEN thread_id % 30 = 5 THEN -thread_id ELSE thread_id END"))))


CHECKS = """,
ft AS (SELECT * REPLACE (CASE WHEN thread_id % 50 = 21 THEN number - 20 ELSE number END AS number, CASE WHEN thread_id % 40 = 3 THEN 'poll' WHEN thread_id % 40 = 4 THEN NULL ELSE kind END AS kind) FROM threads),
ch AS (SELECT 'duplicate_thread_identity' AS check_name, count(*) AS violations FROM (SELECT 1 FROM ft GROUP BY host, repo_id, number HAVING count(*) > 1)
UNION ALL SELECT 'unknown_kind', count(*) FROM ft WHERE kind NOT IN ('issue', 'pull_request') OR kind IS NULL
UNION ALL SELECT 'comment_without_thread', count(*) FROM comments WHERE CASE WHEN thread_id % 30 = 5 THEN -thread_id ELSE thread_id END NOT IN (SELECT thread_id FROM threads)
UNION ALL SELECT 'closed_before_created', count(*) FROM ft WHERE state = 'closed' AND updated_at_us < created_at_us)
"""
SQL["B23_B24_health"] = SQL["B23_B24_health"].replace("\nWITH_CHECKS ", CHECKS)


@query("C1_thread_list", "SELECT t.thread_id, t.title, r.newest FROM threads t JOIN (SELECT host, repo_id, max(updated_at_us) AS newest FROM threads GROUP BY host, repo_id) r USING (host, repo_id)", "threads")
def _(s, d):
    t = relation(s, d, "threads")
    r = repositories(t).select("host", "repo_id", F.col("updated_at_us").alias("newest"))
    return t.join(r, ["host", "repo_id"]).select("thread_id", "title", "newest")


PAGE_SQL = """SELECT thread_id, position - 1 AS position, CASE WHEN found > {o} + {k} THEN {o} + {k} END::BIGINT AS next_offset
FROM (SELECT *, count(*) OVER () AS found FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS position FROM threads {where}) WHERE position <= {o} + {k} + 1)
WHERE position > {o} AND position <= {o} + {k}"""


def _page(s, d, sort, limit, offset, **filters):
    t = listing.filtered(relation(s, d, "threads"), **filters)
    return listing.page(t, listing.sort_order(sort), limit, offset).select("thread_id", F.col("position").cast("long").alias("position"), "next_offset")


@query("F1_list_updated", PAGE_SQL.format(o=0, k=25, where="WHERE state = 'open'", order=f"updated_at_us DESC, {TAIL}"), "threads")
def _(s, d):
    return _page(s, d, "updated", 25, 0, state="open")


@query("F1_list_created", PAGE_SQL.format(o=0, k=25, where="", order=f"created_at_us DESC, {TAIL}"), "threads")
def _(s, d):
    return _page(s, d, "created", 25, 0)


@query("F2_page_next_offset", PAGE_SQL.format(o=40, k=20, where="WHERE kind = 'issue'", order=f"updated_at_us DESC, {TAIL}"), "threads")
def _(s, d):
    return _page(s, d, "updated", 20, 40, kind="issue")


@query("F3_repository_order", """SELECT host, repo_id, full_name, row_number() OVER (ORDER BY host, lower(split_part(full_name, '/', 1)), lower(split_part(full_name, '/', 2)), repo_id) - 1 AS position
FROM (SELECT DISTINCT CASE WHEN thread_id % 3 = 0 THEN 'a.example' ELSE host END AS host, repo_id, concat(CASE thread_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'A-b' WHEN 2 THEN 'a.c' ELSE 'org' END, '/', repo_id) AS full_name FROM threads)""", "threads")
def _(s, d):
    """Owners of which one begins with another, on two hosts."""
    t = relation(s, d, "threads").withColumn("host", F.expr("CASE WHEN thread_id % 3 = 0 THEN 'a.example' ELSE host END")).withColumn("full_name", F.expr("concat(CASE thread_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'A-b' WHEN 2 THEN 'a.c' ELSE 'org' END, '/', repo_id)"))
    return listing.ordered_repositories(repositories(t).select("host", "repo_id", "full_name"))


@query("C8_page_with_coverage", f"""SELECT p.thread_id, string_agg(f.family || '=' || coalesce(c.status, 'missing'), ';' ORDER BY f.rank) AS coverage
FROM (SELECT * FROM threads ORDER BY updated_at_us DESC, {TAIL} LIMIT 20) p JOIN families f ON NOT f.pull_request_only OR p.kind = 'pull_request'
LEFT JOIN coverage c ON c.thread_id = p.thread_id AND c.family = f.family GROUP BY p.thread_id""", "threads")
def _(s, d):
    return listing.page_with_coverage(relation(s, d, "threads"), coverage(s, d), "updated", 20).select("thread_id", "coverage")


def _review_threads(s, d):
    """Each with one comment of its own."""
    own = F.array(F.struct(F.concat(F.lit("c"), "provider_id").alias("provider_id"), "author", (F.col("author") == "system").alias("is_bot"), "body", "created_at_us"))
    return relation(s, d, "review_threads").withColumn("comments", own).select("thread_id", "provider_id", "path", "line", "is_resolved", "is_outdated", "comments")


HELD = "CASE WHEN is_resolved THEN 'resolved' ELSE 'unresolved' END || CASE WHEN is_outdated THEN ', outdated' ELSE '' END"


@query("F14_H32_timeline", f"""SELECT thread_id, row_number() OVER (PARTITION BY thread_id ORDER BY at_us NULLS LAST, code, key, seq) AS position, at_us, code, key, wording FROM (
SELECT thread_id, created_at_us AS at_us, 0 AS code, thread_id::VARCHAR AS key, 0 AS seq, repo_id || '#' || number || ' opened: ' || title AS wording FROM threads
UNION ALL SELECT thread_id, updated_at_us, 0, thread_id::VARCHAR, 1, repo_id || '#' || number || ' closed' FROM threads WHERE state = 'closed'
UNION ALL SELECT thread_id, created_at_us, 1, provider_id, 2, 'comment by ' || coalesce(author, 'unknown author') || ': ' || body FROM comments WHERE thread_id IN (SELECT thread_id FROM threads)
UNION ALL SELECT thread_id, submitted_at_us, 2, provider_id, 3, 'review ' || provider_id || ' by ' || coalesce(reviewer, 'unknown reviewer') || ': ' || lower(state) || coalesce(' — ' || body, '') FROM reviews WHERE thread_id IN (SELECT thread_id FROM threads)
UNION ALL SELECT thread_id, created_at_us, 3, provider_id, 4, 'review thread ' || coalesce(path, 'unknown path') || ': ' || {HELD} FROM review_threads WHERE thread_id IN (SELECT thread_id FROM threads)
UNION ALL SELECT thread_id, created_at_us, 4, provider_id || ':c' || provider_id, 5, 'review comment on ' || coalesce(path, 'unknown path') || ' (' || {HELD} || '), by ' || author || ': ' || body FROM review_threads WHERE thread_id IN (SELECT thread_id FROM threads))""", "threads", "comments", "reviews", "review_threads")
def _(s, d):
    t = relation(s, d, "threads")
    return listing.timeline(t, relation(s, d, "comments"), relation(s, d, "reviews"), _review_threads(s, d)).withColumn("position", F.col("position").cast("long"))


@query("C24_thread_detail")
def _(s, d):
    """A pull request with all its families, among threads of other repositories that have its number."""
    t = relation(s, d, "threads").withColumn("number", F.expr("CASE WHEN thread_id IN (7, 8, 9) THEN 7 ELSE number END"))
    r = relation(s, d, "heads").selectExpr("thread_id", "head_sha", "is_pull_request")
    one = listing.thread_detail(t, coverage(s, d), {"comments": relation(s, d, "comments"), "reviews": relation(s, d, "reviews"), "review_threads": _review_threads(s, d), "pull_request_metadata": r.where("is_pull_request")}, HOST, "src6", 7)
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["provider_id"]), ",").alias(c)
    return one.select(
        "thread_id", "full_name", "kind", "state", "title", F.array_join(F.transform("coverage", lambda c: F.concat(c["family"], F.lit("="), c["status"])), ";").alias("coverage"), ids("comments"), ids("reviews"), ids("review_threads"),
        F.array_join(F.transform("pull_request_metadata", lambda x: x["head_sha"]), ",").alias("heads"), F.array_join(F.transform("timeline", lambda x: F.concat(x["code"].cast("string"), F.lit(":"), x["wording"])), "|").alias("timeline"),
    )


SQL["C24_thread_detail"] = with_relations("", "threads", "comments", "reviews", "review_threads", "heads").rstrip() + ",\nline AS (" + SQL["F14_H32_timeline"][SQL["F14_H32_timeline"].index("SELECT thread_id, row_number()"):] + """)
SELECT t.thread_id, t.full_name, t.kind, t.state, t.title,
(SELECT string_agg(f.family || '=' || coalesce(c.status, 'missing'), ';' ORDER BY f.rank) FROM families f LEFT JOIN coverage c ON c.thread_id = t.thread_id AND c.family = f.family WHERE NOT f.pull_request_only OR t.kind = 'pull_request') AS coverage,
(SELECT coalesce(string_agg(provider_id, ',' ORDER BY provider_id), '') FROM comments c WHERE c.thread_id = t.thread_id) AS comments, (SELECT coalesce(string_agg(provider_id, ',' ORDER BY provider_id), '') FROM reviews c WHERE c.thread_id = t.thread_id) AS reviews,
(SELECT coalesce(string_agg(provider_id, ',' ORDER BY provider_id), '') FROM review_threads c WHERE c.thread_id = t.thread_id) AS review_threads, (SELECT coalesce(string_agg(head_sha, ','), '') FROM heads h WHERE h.thread_id = t.thread_id AND h.is_pull_request) AS heads,
(SELECT string_agg(code || ':' || wording, '|' ORDER BY position) FROM line l WHERE l.thread_id = t.thread_id) AS timeline
FROM threads t WHERE t.thread_id = 7"""


@query("D1_coverage_totals", """SELECT f.family, f.rank, count(t.thread_id) AS applicable, count(*) FILTER (t.thread_id IS NOT NULL AND c.status IS NULL) AS missing,
count(*) FILTER (c.status = 'incomplete') AS incomplete, count(*) FILTER (c.status = 'complete') AS complete
FROM families f LEFT JOIN threads t ON NOT f.pull_request_only OR t.kind = 'pull_request' LEFT JOIN coverage c ON c.thread_id = t.thread_id AND c.family = f.family GROUP BY f.family, f.rank""", "threads")
def _(s, d):
    return listing.coverage_totals(relation(s, d, "threads"), coverage(s, d))


@query("D2_counts_by_kind", "SELECT count(*) AS threads, count(*) FILTER (kind = 'issue') AS issues, count(*) FILTER (kind = 'pull_request') AS pull_requests FROM threads", "threads")
def _(s, d):
    return listing.counts_by_kind(relation(s, d, "threads"))


@query("D4_unresolved_by_family", "SELECT f.family, count(j.run_id) AS unresolved FROM families f LEFT JOIN jobs j ON j.family = f.family AND j.status = 'failed' AND NOT j.resolved GROUP BY f.family", "jobs")
def _(s, d):
    return ledger.unresolved_by_family(relation(s, d, "jobs"))


OUTCOME = """SELECT run_id, count(*) AS jobs, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'deferred') AS deferred, count(*) FILTER (status = 'interrupted') AS interrupted FROM jobs GROUP BY run_id"""
OUTCOME_CASE = "CASE WHEN interrupted > 0 THEN 'interrupted' WHEN failed + deferred = 0 THEN 'complete' WHEN jobs > failed + deferred THEN 'partial' WHEN failed = 0 THEN 'deferred' ELSE 'failed' END"


@query("D14_run_outcome", f"SELECT *, {OUTCOME_CASE} AS outcome FROM ({OUTCOME})", "jobs")
def _(s, d):
    return ledger.run_outcomes(relation(s, d, "jobs"))


@query("D23_retry_summary", f"""SELECT batch, count(*) AS runs, CASE WHEN count(*) = count(*) FILTER (outcome = 'complete') THEN 'complete' WHEN count(*) FILTER (outcome = 'interrupted') > 0 THEN 'interrupted' WHEN count(*) = count(*) FILTER (outcome = 'failed') THEN 'failed'
WHEN count(*) = count(*) FILTER (outcome = 'deferred') THEN 'deferred' ELSE 'partial' END AS status FROM (SELECT run_id // 8 AS batch, {OUTCOME_CASE} AS outcome FROM ({OUTCOME.replace("FROM jobs", "FROM (SELECT * FROM jobs WHERE job_no = 1)")})) GROUP BY batch""", "jobs")
def _(s, d):
    """Runs of one job each, a few to a batch, so that batches fail, defer and mix."""
    runs = ledger.run_outcomes(relation(s, d, "jobs").where("job_no = 1"))
    return ledger.retry_summaries(runs.withColumn("batch", F.floor(F.col("run_id") / 8)), "batch")


@query("D15_refresh_outcome", """SELECT refresh_id, outcome, CASE WHEN outcome = 'interrupted' THEN n END AS pending_items, CASE WHEN outcome = 'partial' THEN n END AS failed_items, CASE WHEN outcome = 'partial' THEN deferred END AS deferred_items, remaining FROM (
SELECT run_id AS refresh_id, count(*) FILTER (status <> 'complete') AS n, count(*) FILTER (status = 'deferred') AS deferred, coalesce(string_agg(stage, ',' ORDER BY position) FILTER (status <> 'complete'), '') AS remaining,
CASE WHEN bool_and(status = 'complete') THEN 'complete' WHEN bool_or(status = 'interrupted') THEN 'interrupted' ELSE 'partial' END AS outcome FROM (
SELECT run_id, job_no AS position, ['sync', 'embeddings', 'clusters'][job_no] AS stage, CASE WHEN part % 9 = 0 THEN 'interrupted' ELSE status END AS status FROM jobs WHERE job_no <= 3) GROUP BY run_id)""", "jobs")
def _(s, d):
    """The first three jobs of each run as the stages of a refresh."""
    stages = relation(s, d, "jobs").where("job_no <= 3").selectExpr("run_id AS refresh_id", "job_no AS position", "element_at(array('sync', 'embeddings', 'clusters'), cast(job_no AS int)) AS stage", "CASE WHEN part % 9 = 0 THEN 'interrupted' ELSE status END AS status")
    return ledger.refresh_outcomes(stages)


@query("C10_job_rows", "SELECT j.run_id, r.status AS run_status, j.status, count(*) AS n FROM jobs j JOIN runs r USING (run_id) GROUP BY ALL", "runs", "jobs")
def _(s, d):
    return ledger.job_rows(relation(s, d, "runs"), relation(s, d, "jobs")).groupBy("run_id", "run_status", "status").agg(F.count("*").alias("n"))


@query("F6_latest_runs", "SELECT run_id, status FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 30", "runs")
def _(s, d):
    return ledger.latest_runs(relation(s, d, "runs"), 30).select("run_id", "status")


@query("B16_F17_recent_failures", "SELECT run_id, status FROM (SELECT * FROM runs ORDER BY started_at DESC, run_id DESC LIMIT 50) WHERE status <> 'complete' ORDER BY started_at DESC, run_id DESC LIMIT 20", "runs")
def _(s, d):
    return ledger.recent_failures(relation(s, d, "runs")).select("run_id", "status")


TOK = r"regexp_extract_all(lower(strip_accents(coalesce({c}, ''))), '[\p{{L}}\p{{N}}]+')"
BM25_BASE = f"""tok AS (SELECT *, {TOK.format(c='title')} AS t, {TOK.format(c='body')} AS b FROM threads),
cnt AS (SELECT *, len(t) + len(b) AS n_tok, {{counts}} FROM tok),
st AS (SELECT count(*) AS n, avg(n_tok) AS a, {{dfs}} FROM cnt),
found AS (SELECT cnt.*, -({{score}}) AS bm25 FROM cnt, st WHERE {{hit}})"""


def bm25_sql(terms: list[str], hit: str) -> str:
    count = lambda w: f"(len(list_filter(t, lambda x: x = '{w}')) + len(list_filter(b, lambda x: x = '{w}')))"
    idf = lambda i: f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6)"
    parts = {
        "counts": ", ".join(f"{count(w)} AS f{i}" for i, w in enumerate(terms)),
        "dfs": ", ".join(f"count(*) FILTER (f{i} > 0) AS d{i}" for i in range(len(terms))),
        "score": " + ".join(f"{idf(i)} * (f{i} * 2.2) / (f{i} + 1.2 * (0.25 + 0.75 * n_tok / a))" for i in range(len(terms))),
        "hit": hit,
    }
    out = BM25_BASE
    for name, part in parts.items():
        out = out.replace("{" + name + "}", part)
    return out


def with_search(sql: str, terms: list[str], hit: str, *names: str) -> str:
    full = with_relations("", "threads", *names)
    return full.rstrip() + ",\n" + bm25_sql(terms, hit) + "\n" + sql


def _found(s, d, expression):
    return search.keyword_search(relation(s, d, "threads"), expression).select("thread_id", F.round("bm25", 6).alias("bm25"))


@query("H1_H4_bm25_keyword")
def _(s, d):
    return _found(s, d, search.plain_expression("with that"))


SQL["H1_H4_bm25_keyword"] = with_search("SELECT thread_id, round(bm25, 6) AS bm25 FROM found", ["with", "that"], "f0 > 0 AND f1 > 0")


@query("H2_advanced_keyword")
def _(s, d):
    return _found(s, d, search.parse_expression("(nicht OR avec) NOT que"))


SQL["H2_advanced_keyword"] = with_search("SELECT thread_id, round(bm25, 6) AS bm25 FROM found", ["nicht", "avec", "que"], "(f0 > 0 OR f1 > 0) AND f2 = 0")


@query("C2_E1_keyword_rank")
def _(s, d):
    found = search.keyword_search(relation(s, d, "threads"), search.plain_expression("with"), F.col("state") == "open")
    found = found.withColumn("bm25", F.round("bm25", 9))
    return search.ranked(found, "relevance", 30, "keyword_rank").select("thread_id", F.col("keyword_rank").cast("long").alias("keyword_rank"))


SQL["C2_E1_keyword_rank"] = with_search(f"SELECT thread_id, row_number() OVER (ORDER BY round(bm25, 9), updated_at_us DESC, {TAIL}) AS keyword_rank FROM found ORDER BY keyword_rank LIMIT 30", ["with"], "f0 > 0 AND state = 'open'")


def _vector(s, d, vec_id: int) -> list[float]:
    return [float(x) for x in s.read.parquet(f"{d}/embeddings.parquet").where(F.col("vec_id") == vec_id).select("embedding").first()[0]]


QVEC = "(SELECT embedding FROM embeddings WHERE vec_id = 3)"
BEST = f"SELECT thread_id, max(list_cosine_similarity(vector::DOUBLE[], {QVEC}::DOUBLE[])) AS score FROM chunks GROUP BY thread_id HAVING max(list_cosine_similarity(vector::DOUBLE[], {QVEC}::DOUBLE[])) > 0"


@query("D7_semantic_best_chunk", f"SELECT thread_id, round(score, 6) AS score FROM ({BEST})", "chunks")
def _(s, d):
    return search.best_chunk(relation(s, d, "chunks"), _vector(s, d, 3)).withColumn("score", F.round("score", 6))


@query("D10_complete_chunk_sets", "SELECT thread_id FROM chunks GROUP BY thread_id HAVING count(*) = min(chunk_count) AND min(chunk_count) = max(chunk_count) AND count(DISTINCT chunk_index) = count(*) AND min(chunk_index) = 0 AND max(chunk_index) = count(*) - 1", "chunks")
def _(s, d):
    return search.complete_documents(relation(s, d, "chunks"))


@query("E2_F8_semantic_rank", f"SELECT thread_id, row_number() OVER (ORDER BY score DESC, host, repo_id, thread_id::VARCHAR, number) AS semantic_rank FROM (SELECT t.*, round(b.score, 9) AS score FROM threads t JOIN ({BEST}) b USING (thread_id)) ORDER BY semantic_rank LIMIT 21", "threads", "chunks")
def _(s, d):
    return search.semantic_search(relation(s, d, "threads"), relation(s, d, "chunks"), _vector(s, d, 3), "relevance", 21).select("thread_id", F.col("semantic_rank").cast("long").alias("semantic_rank"))


@query("C16_E3_hybrid_rrf")
def _(s, d):
    top = search.hybrid_search(relation(s, d, "threads"), relation(s, d, "chunks"), search.plain_expression("with"), _vector(s, d, 3), limit=20)
    return top.select("thread_id", F.col("position").cast("long").alias("position"), F.round("score", 9).alias("score"))


SQL["C16_E3_hybrid_rrf"] = with_search(f""",
kw AS (SELECT *, row_number() OVER (ORDER BY bm25, updated_at_us DESC, {TAIL}) AS kr FROM found QUALIFY kr <= 21),
sem AS (SELECT t.*, row_number() OVER (ORDER BY b.score DESC, host, repo_id, thread_id::VARCHAR, number) AS sr FROM threads t JOIN ({BEST}) b USING (thread_id) QUALIFY sr <= 21),
f AS (SELECT coalesce(k.thread_id, s.thread_id) AS thread_id, coalesce(k.host, s.host) AS host, coalesce(k.repo_id, s.repo_id) AS repo_id, coalesce(k.number, s.number) AS number, coalesce(1 / (60 + kr), 0) + coalesce(1 / (60 + sr), 0) AS score FROM kw k FULL JOIN sem s ON k.thread_id = s.thread_id)
SELECT thread_id, row_number() OVER (ORDER BY score DESC, host, repo_id, thread_id::VARCHAR, number) - 1 AS position, round(score, 9) AS score FROM f QUALIFY position < 20""".lstrip(), ["with"], "f0 > 0", "chunks").replace("WHERE f0 > 0)\n,", "WHERE f0 > 0),")


@query("H5_H6_render", r"SELECT thread_id, '# ' || regexp_replace(title, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'Labels: ' || label AS text FROM threads WHERE title <> ''", "threads")
def _(s, d):
    return documents.render(relation(s, d, "threads")).select("thread_id", "text")


NL2 = "chr(10) || chr(10)"
TRIM = lambda c: rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"
SAID = lambda author, body: f"CASE WHEN {TRIM(body)} <> '' THEN CASE WHEN trim(coalesce({author}, '')) <> '' THEN 'Comment by ' || {author} || ':' ELSE 'Comment:' END || {NL2} || {TRIM(body)} END"
SECTIONS_SQL = f"""sec AS (
SELECT thread_id, 'comments' AS family, 0 AS n, false AS u, created_at_us AS tm, NULL AS t, NULL AS l, provider_id AS k, {SAID('author', 'body')} AS section FROM comments WHERE NOT is_bot
UNION ALL SELECT thread_id, 'reviews', 1, submitted_at_us IS NULL, submitted_at_us, NULL, NULL, provider_id, 'Review by ' || coalesce(reviewer, 'unknown reviewer') || ': ' || CASE state WHEN 'APPROVED' THEN 'approved' WHEN 'CHANGES_REQUESTED' THEN 'requested changes' WHEN 'COMMENTED' THEN 'commented' ELSE state END || CASE WHEN {TRIM('body')} <> '' THEN {NL2} || {TRIM('body')} ELSE '' END FROM reviews WHERE NOT is_bot
UNION ALL SELECT thread_id, 'review_threads', 2, false, NULL, path, line, provider_id, 'Review thread on ' || coalesce(path, 'unknown path') || ' (' || CASE WHEN is_resolved THEN 'resolved' ELSE 'unresolved' END || ', ' || CASE WHEN is_outdated THEN 'outdated' ELSE 'current' END || ')' || CASE WHEN author <> 'system' THEN coalesce({NL2} || {SAID('author', 'body')}, '') ELSE '' END FROM review_threads)"""


@query("H7_H8_H9_B14_F15_render_enriched")
def _(s, d):
    """All three families are taken as current where the comments are complete; reviews where they are."""
    t = relation(s, d, "threads")
    sections = documents.child_sections(relation(s, d, "comments"), relation(s, d, "reviews"), _review_threads(s, d))
    whole = coverage(s, d).where("status = 'complete'").select("thread_id", "family")
    current = whole.unionByName(whole.where("family = 'reviews'").select("thread_id", F.lit("review_threads").alias("family")))
    return documents.render_enriched(t, sections, current).select("thread_id", "text")


SQL["H7_H8_H9_B14_F15_render_enriched"] = with_relations("", "threads", "comments", "reviews", "review_threads").rstrip() + f""",
{SECTIONS_SQL},
cur AS (SELECT thread_id, family FROM coverage WHERE status = 'complete' UNION ALL SELECT thread_id, 'review_threads' FROM coverage WHERE status = 'complete' AND family = 'reviews'),
said AS (SELECT s.thread_id, string_agg(section, {NL2} ORDER BY n, u, tm NULLS FIRST, t NULLS FIRST, l NULLS FIRST, k) AS said FROM sec s SEMI JOIN cur c ON c.thread_id = s.thread_id AND c.family = s.family WHERE section IS NOT NULL GROUP BY s.thread_id)
SELECT t.thread_id, concat_ws({NL2}, CASE WHEN {TRIM('title')} <> '' THEN '# ' || {TRIM('title')} END, CASE WHEN {TRIM('body')} <> '' THEN {TRIM('body')} END, 'Labels: ' || label, said) AS text FROM threads t LEFT JOIN said USING (thread_id)"""


@query("H5_dedupe_text", r"SELECT thread_id, trim(regexp_replace(lower(body), '\s+', ' ', 'g')) AS dedupe_text FROM threads", "threads")
def _(s, d):
    return relation(s, d, "threads").select("thread_id", text.dedupe_text(F.col("body")).alias("dedupe_text"))


FRAME = "unhex(lpad(hex(strlen({x})), 16, '0')) || encode({x})"


@query("H16_content_hash", "SELECT thread_id, sha256(" + " || ".join(
    ["unhex(lpad(hex(strlen('discussion-document-v1')), 16, '0')) || encode('discussion-document-v1')", FRAME.format(x="'original_body'"), "unhex('000000000000000400000001')", FRAME.format(x="host"), FRAME.format(x="repo_id"), FRAME.format(x="thread_id::VARCHAR"), "unhex('0000000000000008' || lpad(hex(number), 16, '0'))", FRAME.format(x="title"), FRAME.format(x="body")]) + ") AS content_hash FROM threads", "threads")
def _(s, d):
    return relation(s, d, "threads").select("thread_id", hashing.content_hash(F.lit("original_body"), F.lit(1), F.col("host"), F.col("repo_id"), F.col("thread_id").cast("string"), F.col("number"), F.col("title"), F.col("body")).alias("content_hash"))


#: White space as the chunker sees it, and the largest chunk and request of the queries.
BLANK = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
CHUNK, BATCH, BATCH_BYTES = 2000, 16, 20_000
# What fits is the longest prefix within the budget; it is cut at its last white space that isn't its beginning, if there is one.
CHUNKS_SQL = rf"""doc AS (SELECT thread_id, regexp_replace('# ' || regexp_replace(title, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || regexp_replace(body, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'Labels: ' || label, '^{BLANK}+|{BLANK}+$', '', 'g') AS text FROM threads),
cut AS (SELECT thread_id, -1 AS chunk_index, '' AS chunk, text AS rest FROM doc UNION ALL
  SELECT thread_id, chunk_index + 1, piece, regexp_replace(substr(rest, length(piece) + 1), '^{BLANK}+', '') FROM (
    SELECT thread_id, chunk_index, rest, CASE WHEN strlen(rest) <= {CHUNK} THEN rest WHEN word <> '' THEN word ELSE fits END AS piece FROM (
      SELECT *, regexp_extract(fits, '(?s)^(.*[^\t-\r \x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]){BLANK}', 1) AS word FROM (
        SELECT *, left(rest, list_max(list_filter(range(greatest(1, length(left(rest, {CHUNK})) - greatest(0, strlen(left(rest, {CHUNK})) - {CHUNK})), length(left(rest, {CHUNK})) + 1), lambda i: strlen(left(rest, i)) <= {CHUNK}))) AS fits FROM cut WHERE rest <> '')))),
chunked AS (SELECT thread_id, chunk_index::INT AS chunk_index, (count(*) OVER (PARTITION BY thread_id))::INT AS chunk_count, chunk,
  sha256(unhex(lpad(hex(strlen('embedding-chunk-v1')), 16, '0')) || encode('embedding-chunk-v1') || unhex('0000000000000004' || lpad(hex(chunk_index), 8, '0')) || unhex(lpad(hex(strlen(chunk)), 16, '0')) || encode(chunk)) AS chunk_hash FROM cut WHERE chunk_index >= 0)"""


def recursive(body: str, *names: str) -> str:
    return "WITH RECURSIVE " + with_relations(body, *names).lstrip()[5:]


def _chunks(s, d):
    return documents.chunks_of(documents.render(relation(s, d, "threads")), CHUNK)


@query("H14_H15_chunks")
def _(s, d):
    return _chunks(s, d).select("thread_id", "chunk_index", "chunk_count", F.octet_length("chunk").alias("bytes"), "chunk_hash")


SQL["H14_H15_chunks"] = recursive("", "threads").rstrip() + f",\n{CHUNKS_SQL}\nSELECT thread_id, chunk_index, chunk_count, strlen(chunk)::INT AS bytes, chunk_hash FROM chunked"


@query("C18_pending_chunks")
def _(s, d):
    wanted = _chunks(s, d)
    return documents.pending_chunks(wanted, wanted.where("thread_id % 2 = 0")).select("thread_id", "chunk_index", "chunk_hash")


SQL["C18_pending_chunks"] = recursive("", "threads").rstrip() + f",\n{CHUNKS_SQL}\nSELECT thread_id, chunk_index, chunk_hash FROM chunked WHERE thread_id % 2 <> 0"


@query("C18_changed_chunks")
def _(s, d):
    """Stored chunks: those of even threads, every third of them under another hash or another count."""
    wanted = _chunks(s, d)
    stored = wanted.where("thread_id % 2 = 0").withColumn("chunk_hash", F.expr("CASE WHEN thread_id % 3 = 0 AND chunk_index % 2 = 1 THEN md5(chunk_hash) ELSE chunk_hash END")).withColumn("chunk_count", F.expr("chunk_count + CASE WHEN thread_id % 7 = 0 THEN 1 ELSE 0 END"))
    return documents.pending_chunks(wanted, stored).select("thread_id", "chunk_index", "chunk_hash")


SQL["C18_changed_chunks"] = recursive("", "threads").rstrip() + f",\n{CHUNKS_SQL}\nSELECT thread_id, chunk_index, chunk_hash FROM chunked WHERE thread_id % 2 <> 0 OR thread_id % 7 = 0 OR (thread_id % 3 = 0 AND chunk_index % 2 = 1)"


@query("F19_request_batches")
def _(s, d):
    chunks = _chunks(s, d).join(relation(s, d, "threads").select("thread_id", "full_name"), "thread_id")
    return requests.request_batches(chunks, "full_name", BATCH, BATCH_BYTES).select("full_name", "thread_id", "chunk_index", "request")


# The fold: the k-th chunk of every repository after the one before it.
SQL["F19_request_batches"] = recursive("", "threads").rstrip() + f""",\n{CHUNKS_SQL},
o AS (SELECT full_name, thread_id, chunk_index, strlen(chunk) AS n, row_number() OVER (PARTITION BY full_name ORDER BY thread_id, chunk_index) AS k FROM chunked JOIN threads USING (thread_id)),
f AS (SELECT full_name, thread_id, chunk_index, k, 0 AS request, 1 AS held, n AS bytes FROM o WHERE k = 1 UNION ALL
  SELECT o.full_name, o.thread_id, o.chunk_index, o.k, CASE WHEN f.held < {BATCH} AND f.bytes + o.n <= {BATCH_BYTES} THEN f.request ELSE f.request + 1 END,
  CASE WHEN f.held < {BATCH} AND f.bytes + o.n <= {BATCH_BYTES} THEN f.held + 1 ELSE 1 END, CASE WHEN f.held < {BATCH} AND f.bytes + o.n <= {BATCH_BYTES} THEN f.bytes + o.n ELSE o.n END
  FROM f JOIN o ON o.full_name = f.full_name AND o.k = f.k + 1)
SELECT full_name, thread_id, chunk_index, request FROM f"""


@query("H10_H11_title_overlap", r"""SELECT a.thread_id, b.thread_id AS other, round(len(list_intersect(a.w, b.w)) / least(len(a.w), len(b.w)), 6) AS overlap
FROM (SELECT *, list_distinct(list_transform(regexp_extract_all(title, '[A-Za-z0-9]{4,}'), lambda x: lower(x))) AS w FROM threads) a
JOIN (SELECT *, list_distinct(list_transform(regexp_extract_all(title, '[A-Za-z0-9]{4,}'), lambda x: lower(x))) AS w FROM threads) b ON b.thread_id = a.thread_id + 1 WHERE len(a.w) > 0 AND len(b.w) > 0""", "threads")
def _(s, d):
    t = relation(s, d, "threads").select("thread_id", text.title_tokens(F.col("title")).alias("w"))
    o = t.select((F.col("thread_id") - 1).alias("thread_id"), F.col("thread_id").alias("other"), F.col("w").alias("v"))
    return t.join(o, "thread_id").where("size(w) > 0 AND size(v) > 0").select("thread_id", "other", F.round(text.overlap_ratio(F.col("w"), F.col("v")), 6).alias("overlap"))


def _mentioning(s, d):
    """Bodies of the adapter hold no mentions, so each names a thread further on: in one of four forms, every third one late
    in the body, where titles must support it."""
    return relation(s, d, "threads").withColumn("title", F.expr(TITLE)).withColumn("body", F.expr(MENTIONING))


# Threads of a repository are 20 numbers apart, so forms, titles and steps use other moduli than its divisors where pairs must differ.
TITLE = "concat('topic', cast(thread_id % 7 AS varchar(20)), ' part', cast(thread_id % 9 AS varchar(20)))"
MENTIONING = """concat(CASE WHEN thread_id % 3 = 0 THEN repeat('late ', 50) ELSE '' END, 'See ', CASE thread_id % 4 WHEN 0 THEN '#' WHEN 1 THEN concat(upper(full_name), '#') WHEN 2 THEN 'issues/' ELSE concat('x/y ', full_name, '/pull/') END,
cast(number + 20 * (1 + thread_id % 9) AS varchar(20)), ' and other/name#7 ', body)"""
MENTION_SQL = """SELECT a.thread_id AS a, b.thread_id AS b, 0.94::DOUBLE AS score FROM threads a JOIN threads b ON b.number = a.number + 20 * (1 + a.thread_id % 9) AND a.full_name = b.full_name
WHERE a.thread_id % 3 <> 0 OR a.thread_id % 7 = b.thread_id % 7 OR a.thread_id % 9 = b.thread_id % 9"""


@query("H12_H13_C15_mentions", MENTION_SQL, "threads")
def _(s, d):
    return clustering.reference_edges(_mentioning(s, d))


THRESHOLD, CROSS, FANOUT = 0.2, 0.3, 4


def _near(s, d):
    """Titles of two words each, so that some pairs support each other and others do not; mentions compete with similar threads."""
    t = _mentioning(s, d).where("state = 'open'")
    return t, clustering.neighbours(t, relation(s, d, "chunks"), THRESHOLD, CROSS, FANOUT, clustering.reference_edges(t))


PAIRS = f"""v AS (SELECT c.thread_id, c.vector::DOUBLE[] AS vector, t.kind, t.full_name FROM chunks c JOIN threads t USING (thread_id) WHERE t.state = 'open'),
p AS (SELECT a.thread_id AS a, b.thread_id AS b, a.kind = b.kind AS same, a.thread_id % 7 = b.thread_id % 7 OR a.thread_id % 9 = b.thread_id % 9 AS support, max(list_cosine_similarity(a.vector, b.vector)) AS score FROM v a JOIN v b ON a.full_name = b.full_name AND a.thread_id <> b.thread_id GROUP BY ALL),
m AS (SELECT * FROM ({MENTION_SQL}) WHERE a IN (SELECT thread_id FROM v) AND b IN (SELECT thread_id FROM v)),
u AS (SELECT a, b, score FROM p WHERE score >= {THRESHOLD} AND (support OR score >= 0.9) AND (same OR score >= {CROSS}) UNION ALL SELECT a, b, score FROM m UNION ALL SELECT b, a, score FROM m),
n AS (SELECT a, b, max(score) AS score, row_number() OVER (PARTITION BY a ORDER BY max(score) DESC, b) AS rank FROM u GROUP BY a, b QUALIFY rank <= {FANOUT})"""


@query("C14_E4_topk_neighbours")
def _(s, d):
    return _near(s, d)[1].select("a", "b", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


SQL["C14_E4_topk_neighbours"] = with_relations("", "threads", "chunks").rstrip() + ",\n" + PAIRS + "\nSELECT a, b, round(score, 6) AS score, rank FROM n"


@query("E5_F12_candidate_edges")
def _(s, d):
    return clustering.ordered_edges(clustering.candidate_edges(_near(s, d)[1]).withColumn("score", F.round("score", 6)))


SQL["E5_F12_candidate_edges"] = with_relations("", "threads", "chunks").rstrip() + ",\n" + PAIRS + """
SELECT *, row_number() OVER (ORDER BY score DESC, a, b) - 1 AS position FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, round(max(score), 6) AS score FROM n GROUP BY 1, 2)"""

MOST = 6


def _members(s, d):
    t, near = _near(s, d)
    return t, clustering.with_representatives(clustering.bounded_components(t, clustering.candidate_edges(near), MOST))


# The fold over edges in order, with the label of every thread in a list; a label is the smallest thread of its cluster.
FOLD_EDGES = f"""WITH RECURSIVE {with_relations("", "threads", "chunks").strip()[5:]},
{PAIRS},
ids AS (SELECT thread_id, row_number() OVER (ORDER BY thread_id) AS i FROM threads WHERE state = 'open'),
e AS (SELECT x.a, x.b, x.score, ia.i AS ia, ib.i AS ib, row_number() OVER (ORDER BY x.score DESC, x.a, x.b) AS k FROM (SELECT least(a, b) AS a, greatest(a, b) AS b, max(score) AS score FROM n GROUP BY 1, 2) x JOIN ids ia ON ia.thread_id = x.a JOIN ids ib ON ib.thread_id = x.b),
f AS (SELECT 0::BIGINT AS k, range(1, (SELECT count(*) + 1 FROM ids)) AS l, false AS kept UNION ALL
  SELECT e.k, CASE WHEN f.l[e.ia] = f.l[e.ib] OR len(list_filter(f.l, lambda x: x IN (f.l[e.ia], f.l[e.ib]))) > {MOST} THEN f.l ELSE list_transform(f.l, lambda x: CASE WHEN x IN (f.l[e.ia], f.l[e.ib]) THEN least(f.l[e.ia], f.l[e.ib]) ELSE x END) END,
  f.l[e.ia] = f.l[e.ib] OR len(list_filter(f.l, lambda x: x IN (f.l[e.ia], f.l[e.ib]))) <= {MOST} FROM f JOIN e ON e.k = f.k + 1),
mem AS (SELECT i.thread_id, j.thread_id AS cluster FROM ids i, (SELECT l FROM f ORDER BY k DESC LIMIT 1) z, ids j WHERE j.i = z.l[i.i]),
kept AS (SELECT e.* FROM e JOIN f ON f.k = e.k AND f.kept),
link AS (SELECT a AS x, b AS y, score FROM kept UNION ALL SELECT b, a, score FROM kept),
deg AS (SELECT m.thread_id, m.cluster, count(l.x) AS degree FROM mem m LEFT JOIN link l ON l.x = m.thread_id GROUP BY ALL),
rep AS (SELECT cluster, first(thread_id ORDER BY degree DESC, thread_id) AS representative, count(*) AS size FROM deg GROUP BY cluster)
"""


@query("D18_D9_components")
def _(s, d):
    t, near = _near(s, d)
    return clustering.bounded_components(t, clustering.candidate_edges(near), MOST).select("thread_id", "cluster", F.col("degree").cast("long").alias("degree"))


SQL["D18_D9_components"] = FOLD_EDGES + "SELECT thread_id, cluster, degree FROM deg"


@query("E6_representative")
def _(s, d):
    return _members(s, d)[1].select("thread_id", "cluster", "representative", "size", F.round("score", 6).alias("score"))


SQL["E6_representative"] = FOLD_EDGES + "SELECT d.thread_id, d.cluster, r.representative, r.size, round(CASE WHEN d.thread_id = r.representative THEN 1.0 ELSE (SELECT max(score) FROM link WHERE x = d.thread_id AND y = r.representative) END, 6) AS score FROM deg d JOIN rep r USING (cluster)"


@query("F13_H17_stable_keys")
def _(s, d):
    members = _members(s, d)[1]
    return clustering.ordered_clusters(members).join(clustering.stable_keys(members).drop("size"), "cluster")


SQL["F13_H17_stable_keys"] = FOLD_EDGES + """SELECT cluster, size, row_number() OVER (ORDER BY size DESC, cluster) - 1 AS position, key AS stable_key FROM (
SELECT cluster, count(*) AS size, 'members-' || sha256(encode('cluster-members-v1') || unhex('00') || unhex(string_agg(lpad(hex(thread_id), 16, '0'), '' ORDER BY thread_id))) AS key FROM mem GROUP BY cluster)"""


CLUSTERS = "g AS (SELECT thread_id // 7 AS cluster, thread_id FROM threads), x AS (SELECT thread_id // 5 AS cluster, thread_id FROM threads WHERE thread_id % 11 <> 0)"


def _clusterings(s, d):
    t = relation(s, d, "threads")
    g = t.select(F.floor(F.col("thread_id") / 7).alias("cluster"), "thread_id")
    x = t.where("thread_id % 11 <> 0").select(F.floor(F.col("thread_id") / 5).alias("cluster"), "thread_id")
    return t, g, x


@query("C17_identity_overlap")
def _(s, d):
    _, g, x = _clusterings(s, d)
    return clustering.overlaps(g, x)


SQL["C17_identity_overlap"] = with_relations("", "threads").rstrip() + f""",\n{CLUSTERS}
SELECT g.cluster AS generated_id, x.cluster AS existing_id, count(*) AS overlap, (SELECT count(*) FROM g g2 WHERE g2.cluster = g.cluster) + (SELECT count(*) FROM x x2 WHERE x2.cluster = x.cluster) - count(*) AS union_size FROM g JOIN x USING (thread_id) GROUP BY g.cluster, x.cluster"""


@query("E7_identity_matching")
def _(s, d):
    _, g, x = _clusterings(s, d)
    return clustering.match_identities(clustering.overlaps(g, x))


SQL["E7_identity_matching"] = "WITH RECURSIVE " + with_relations("", "threads").strip()[5:] + f""",\n{CLUSTERS},
c AS (SELECT g.cluster AS gid, x.cluster AS eid, count(*) AS overlap, (SELECT count(*) FROM g g2 WHERE g2.cluster = g.cluster) + (SELECT count(*) FROM x x2 WHERE x2.cluster = x.cluster) - count(*) AS u FROM g JOIN x USING (thread_id) GROUP BY g.cluster, x.cluster),
o AS (SELECT *, row_number() OVER (ORDER BY overlap DESC, u, eid, gid) AS k FROM c),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS es, NULL::BIGINT AS gid, NULL::BIGINT AS eid UNION ALL
  SELECT o.k, CASE WHEN o.gid IN f.gs OR o.eid IN f.es THEN f.gs ELSE list_append(f.gs, o.gid) END, CASE WHEN o.gid IN f.gs OR o.eid IN f.es THEN f.es ELSE list_append(f.es, o.eid) END,
  CASE WHEN NOT (o.gid IN f.gs OR o.eid IN f.es) THEN o.gid END, CASE WHEN NOT (o.gid IN f.gs OR o.eid IN f.es) THEN o.eid END FROM f JOIN o ON o.k = f.k + 1)
SELECT gid AS generated_id, eid AS existing_id FROM f WHERE gid IS NOT NULL"""


def _generation(s, d, complete):
    """A generation that leaves out every third thread and some clusters; members are excluded by the decision table alone."""
    _, g, x = _clusterings(s, d)
    held = x.withColumn("state", F.expr("CASE WHEN thread_id % 17 = 0 THEN 'removed' WHEN thread_id % 13 = 0 THEN 'excluded' ELSE 'active' END"))
    decided = g.where("thread_id % 8 = 1").unionByName(x.where("thread_id % 13 = 0")).withColumn("excluded", F.col("thread_id") % 3 != 2)
    return generations.members_after(held, decided, g.where("thread_id % 3 <> 0 AND cluster % 4 <> 1"), complete)


GENERATION = f"""{CLUSTERS}, mem AS (SELECT *, CASE WHEN thread_id % 17 = 0 THEN 'removed' WHEN thread_id % 13 = 0 THEN 'excluded' ELSE 'active' END AS state FROM x),
dec AS (SELECT *, thread_id % 3 <> 2 AS excluded FROM (SELECT * FROM g WHERE thread_id % 8 = 1 UNION ALL SELECT * FROM x WHERE thread_id % 13 = 0)), gen AS (SELECT * FROM g WHERE thread_id % 3 <> 0 AND cluster % 4 <> 1)"""
MEMBERS_AFTER = """SELECT m.cluster, m.thread_id, CASE WHEN m.state IN ('active', 'excluded') AND (m.thread_id IN (SELECT thread_id FROM gen){lost}) THEN 'removed' ELSE m.state END AS state
FROM mem m WHERE NOT EXISTS (SELECT 1 FROM gen o WHERE o.cluster = m.cluster AND o.thread_id = m.thread_id)
UNION ALL SELECT o.cluster, o.thread_id, CASE WHEN EXISTS (SELECT 1 FROM dec q WHERE q.cluster = o.cluster AND q.thread_id = o.thread_id AND q.excluded) THEN 'excluded' ELSE 'active' END FROM gen o"""


@query("I12_next_generation")
def _(s, d):
    return _generation(s, d, True)


SQL["I12_next_generation"] = with_relations("", "threads").rstrip() + f",\n{GENERATION}\n" + MEMBERS_AFTER.format(lost=" OR m.cluster IN (SELECT cluster FROM gen)")


@query("I12_C12_partial_generation")
def _(s, d):
    return _generation(s, d, False)


SQL["I12_C12_partial_generation"] = with_relations("", "threads").rstrip() + f",\n{GENERATION}\n" + MEMBERS_AFTER.format(lost="")


@query("I12_saved_generation")
def _(s, d):
    """The clusters after a saved complete generation: matched ones keep id and key, others get new ids."""
    _, g, x = _clusterings(s, d)
    held = x.where("cluster % 5 <> 2").withColumn("state", F.expr("CASE WHEN thread_id % 17 = 0 THEN 'removed' ELSE 'active' END"))
    old = x.select("cluster").distinct().selectExpr("cluster", "concat('key-', cast(cluster AS string)) AS stable_key", "CASE WHEN cluster % 9 = 0 THEN 'retired' ELSE 'active' END AS status", "cluster * 5 AS representative", "cast(1 AS bigint) AS last_run", "CASE WHEN cluster % 9 = 0 THEN cast(7 AS bigint) END AS retired_at_us")
    heads = g.groupBy("cluster").agg(F.min("thread_id").alias("representative"))
    proposed = g.join(heads, "cluster").withColumn("score", F.lit(0.5))
    return generations.save(proposed, old, held, x.limit(0).withColumn("excluded", F.lit(True)), True, 10, 10, 2, 99)["clusters"]


SQL["I12_saved_generation"] = "WITH RECURSIVE " + with_relations("", "threads").strip()[5:] + f""",\n{CLUSTERS},
held AS (SELECT * FROM x WHERE cluster % 5 <> 2 AND thread_id % 17 <> 0),
c AS (SELECT g.cluster AS gid, h.cluster AS eid, count(*) AS overlap, (SELECT count(*) FROM g g2 WHERE g2.cluster = g.cluster) + (SELECT count(*) FROM held h2 WHERE h2.cluster = h.cluster) - count(*) AS u FROM g JOIN held h USING (thread_id) GROUP BY g.cluster, h.cluster),
o AS (SELECT *, row_number() OVER (ORDER BY overlap DESC, u, eid, gid) AS k FROM c),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS es, NULL::BIGINT AS gid, NULL::BIGINT AS eid UNION ALL
  SELECT o.k, CASE WHEN o.gid IN f.gs OR o.eid IN f.es THEN f.gs ELSE list_append(f.gs, o.gid) END, CASE WHEN o.gid IN f.gs OR o.eid IN f.es THEN f.es ELSE list_append(f.es, o.eid) END,
  CASE WHEN NOT (o.gid IN f.gs OR o.eid IN f.es) THEN o.gid END, CASE WHEN NOT (o.gid IN f.gs OR o.eid IN f.es) THEN o.eid END FROM f JOIN o ON o.k = f.k + 1),
pr AS (SELECT cluster AS gid, min(thread_id) AS head, 'members-' || sha256(encode('cluster-members-v1') || unhex('00') || unhex(string_agg(lpad(hex(thread_id), 16, '0'), '' ORDER BY thread_id))) AS key FROM g GROUP BY cluster),
to_ AS (SELECT pr.*, f.eid FROM pr LEFT JOIN (SELECT gid, eid FROM f WHERE gid IS NOT NULL) f USING (gid)),
fresh AS (SELECT *, (SELECT max(cluster) FROM x) + row_number() OVER (ORDER BY key) AS id FROM to_ WHERE eid IS NULL),
ex AS (SELECT DISTINCT cluster FROM x)
SELECT e.cluster, 'key-' || e.cluster AS stable_key, CASE WHEN t.gid IS NOT NULL THEN 'active' ELSE 'retired' END AS status, coalesce(t.head, e.cluster * 5) AS representative, CASE WHEN t.gid IS NOT NULL THEN 2 ELSE 1 END::BIGINT AS last_run,
  CASE WHEN t.gid IS NULL THEN CASE WHEN e.cluster % 9 = 0 THEN 7 ELSE 99 END END::BIGINT AS retired_at_us FROM ex e LEFT JOIN to_ t ON t.eid = e.cluster
UNION ALL SELECT id, key, 'active', head, 2, NULL FROM fresh"""


@query("C22_D6_cluster_summary")
def _(s, d):
    """Titles of canonical members, where a cluster has one, then of representatives, then of the lowest active number."""
    t, g, _ = _clusterings(s, d)
    m = g.withColumn("state", F.when(F.col("thread_id") % 13 == 0, "excluded").otherwise("active")).withColumn("representative", F.when(F.col("cluster") % 2 == 0, F.col("cluster") * 7 + 3))
    canonical = g.where("cluster % 3 = 0 AND thread_id % 7 = 5").select("cluster", "thread_id")
    return clustering.cluster_summaries(m, t, canonical)


SQL["C22_D6_cluster_summary"] = with_relations("", "threads").rstrip() + f""",\n{CLUSTERS}, m AS (SELECT g.*, CASE WHEN thread_id % 13 = 0 THEN 'excluded' ELSE 'active' END AS state, CASE WHEN cluster % 2 = 0 THEN cluster * 7 + 3 END AS representative, CASE WHEN cluster % 3 = 0 THEN cluster * 7 + 5 END AS canonical FROM g)
SELECT m.cluster, count(*) FILTER (m.state = 'active') AS active, count(*) FILTER (m.state = 'excluded') AS excluded, first(t.title ORDER BY (m.thread_id = m.canonical) IS NOT TRUE, (m.thread_id = m.representative) IS NOT TRUE, m.state <> 'active', t.number) AS title FROM m JOIN threads t USING (thread_id) GROUP BY m.cluster"""

LATEST = "row_number() OVER (PARTITION BY thread_id, family ORDER BY source_clock DESC NULLS LAST, sequence DESC) = 1"


@query("E8_I2_canonical_observation", f"SELECT thread_id, family, payload, sequence FROM observations QUALIFY {LATEST}", "observations")
def _(s, d):
    return observations.canonical(relation(s, d, "observations"), ["thread_id", "family"], ["payload"]).select("thread_id", "family", "payload", "sequence")


@query("I2_J2_dispositions", f"""SELECT disposition, count(*) AS n FROM (SELECT CASE WHEN c.sequence IS NULL OR (o.source_clock, o.sequence) > (c.source_clock, c.sequence) THEN 'applied' WHEN o.sequence = c.sequence THEN 'replayed' ELSE 'skipped' END AS disposition
FROM observations o LEFT JOIN (SELECT * FROM (SELECT * FROM observations WHERE sequence % 2 = 0) QUALIFY {LATEST}) c ON o.thread_id = c.thread_id AND o.family = c.family) GROUP BY disposition""", "observations")
def _(s, d):
    log = relation(s, d, "observations")
    now = observations.canonical(log.where("sequence % 2 = 0"), ["thread_id", "family"], ["payload"])
    return observations.dispositions(log, now, ["thread_id", "family"], "payload").groupBy("disposition").agg(F.count("*").alias("n"))


@query("H27_J4_conflicts", "SELECT thread_id, family, source_clock, min(s) AS sequence, count(DISTINCT payload) AS payloads FROM (SELECT *, 1::BIGINT AS s FROM observations) GROUP BY thread_id, family, source_clock HAVING count(DISTINCT payload) > 1", "observations")
def _(s, d):
    log = relation(s, d, "observations").withColumn("sequence", F.lit(1).cast("long"))
    return observations.conflicts(log, ["thread_id", "family"], "payload")


@query("I1_I7_upsert", "SELECT t.thread_id, CASE WHEN t.thread_id % 3 = 0 THEN 'new' ELSE t.state END AS state FROM threads t UNION ALL SELECT -thread_id, 'new' FROM threads WHERE thread_id % 3 = 0", "threads")
def _(s, d):
    t = relation(s, d, "threads").select("thread_id", "state")
    new = t.where("thread_id % 3 = 0").withColumn("state", F.lit("new"))
    return observations.upsert(t, new.unionByName(new.withColumn("thread_id", -F.col("thread_id"))), ["thread_id"])


@query("I6_current_membership", """SELECT o.thread_id, o.family, o.sequence, o.payload FROM observations o JOIN (SELECT thread_id, family, max(sequence) AS sequence FROM observations WHERE status = 'complete' GROUP BY thread_id, family) l USING (thread_id, family, sequence)""", "observations")
def _(s, d):
    log = relation(s, d, "observations")
    return observations.current_membership(log.select("thread_id", "family", "sequence", "status"), log.select("thread_id", "family", "sequence", "payload"), ["thread_id", "family"]).select("thread_id", "family", "sequence", "payload")


@query("D11_D12_staged_merge", "SELECT run_id, family, part AS provider_id, count(DISTINCT items) AS n_payloads, min(items) AS payload, count(*) AS received FROM jobs GROUP BY run_id, family, part", "jobs")
def _(s, d):
    j = relation(s, d, "jobs").select("run_id", "family", F.col("part").alias("provider_id"), F.col("items").alias("payload"))
    return observations.merged_pages(j, ["run_id", "family"])


@query("D13_page_contiguity", "SELECT run_id, count(DISTINCT job_no - 1) AS pages, sum(items)::BIGINT AS received, min(job_no - 1) = 0 AND max(job_no - 1) = count(DISTINCT job_no) - 1 AS contiguous FROM jobs GROUP BY run_id", "jobs")
def _(s, d):
    j = relation(s, d, "jobs").select("run_id", (F.col("job_no") - 1).alias("page_index"), "items")
    return observations.page_sets(j, ["run_id"])


@query("J3_H22_overlap_scan", f"SELECT thread_id, updated_at_us FROM threads WHERE updated_at_us >= {EPOCH_US + 1_000_000_000_000} - 86400000000", "threads")
def _(s, d):
    return observations.scan_window(relation(s, d, "threads"), "updated_at_us", F.lit(EPOCH_US + 1_000_000_000_000)).select("thread_id", "updated_at_us")


@query("D16_eligible_threads", "SELECT host, repo_id, count(*) FILTER (state = 'open') AS eligible FROM threads GROUP BY host, repo_id", "threads")
def _(s, d):
    return listing.eligible_threads(relation(s, d, "threads"))


@query("D17_first_seen_repositories", "SELECT host, repo_id, row_number() OVER (ORDER BY min((number * 7919) % 1009 * 100000 + thread_id)) - 1 AS position FROM threads GROUP BY host, repo_id", "threads")
def _(s, d):
    """Repositories in the order in which a list of threads names them."""
    t = relation(s, d, "threads").withColumn("place", F.expr("(number * 7919) % 1009 * 100000 + thread_id"))
    return listing.first_seen(t, ["host", "repo_id"], ["place"])


@query("B21_reusable_families", """SELECT t.thread_id, 'comments' AS family, coalesce(c.status = 'complete' AND (SELECT count(*) FROM comments m WHERE m.thread_id = t.thread_id) = t.thread_id % 8, false) AS reusable FROM threads t LEFT JOIN coverage c ON c.thread_id = t.thread_id AND c.family = 'comments'""", "threads", "comments")
def _(s, d):
    t = relation(s, d, "threads")
    want = t.select("thread_id", F.lit("comments").alias("family"), F.col("updated_at_us").alias("expected_clock"), (F.col("thread_id") % 8).alias("expected_count"))
    cov = coverage(s, d).join(t.select("thread_id", F.col("updated_at_us").alias("clock")), "thread_id").withColumn("item_count", F.col("thread_id") % 8)
    return observations.reusable_families(cov, relation(s, d, "comments").withColumn("family", F.lit("comments")), want)


@query("B21_reusable_for_head")
def _(s, d):
    """Reviews against the head of their pull request; heads, clocks, counts and statuses that fit and don't."""
    state, heads = relation(s, d, "review_state"), relation(s, d, "heads")
    t = relation(s, d, "threads")
    held = relation(s, d, "reviews").withColumn("family", F.lit("reviews"))
    cov = state.withColumn("clock", F.col("clock_us")).withColumn("item_count", F.col("thread_id") % 8)
    want = t.join(heads, "thread_id").select("thread_id", F.lit("reviews").alias("family"), F.col("updated_at_us").alias("expected_clock"), F.expr("CASE WHEN is_pull_request THEN head_sha END").alias("current_head"))
    return observations.current_for_head(cov, held, want)


SQL["B21_reusable_for_head"] = with_relations("", "threads", "reviews", "review_state", "heads").rstrip() + """
SELECT t.thread_id, 'reviews' AS family, coalesce(c.status = 'complete' AND c.clock_us IS NOT DISTINCT FROM t.updated_at_us AND c.head_sha = CASE WHEN h.is_pull_request THEN h.head_sha END AND (SELECT count(*) FROM reviews m WHERE m.thread_id = t.thread_id) = t.thread_id % 8, false) AS reusable
FROM threads t JOIN heads h USING (thread_id) LEFT JOIN review_state c ON c.thread_id = t.thread_id"""

RAW = "CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 3 = 0 THEN ' soon ' WHEN event_id % 3 = 1 THEN 'soon' ELSE 'later' END"


def raw_observations(s, d):
    """Observations of which most have no usable clock."""
    e = s.read.parquet(f"{d}/events.parquet").selectExpr("user_id * 10 + event_id % 10 AS k", "event_id AS sequence", "value AS payload", f"CASE WHEN event_id % 10 < 3 THEN ts END AS source_clock", f"{RAW} AS raw_clock")
    return e


@query("H27_ambiguous_clocks", f"SELECT k, count(DISTINCT trim(coalesce(raw_clock, ''))) AS spellings FROM (SELECT user_id * 10 + event_id % 10 AS k, CASE WHEN event_id % 10 < 3 THEN ts END AS c, {RAW} AS raw_clock FROM events) GROUP BY k HAVING max(c) IS NULL AND spellings > 1")
def _(s, d):
    return observations.ambiguous_keys(raw_observations(s, d), ["k"])


@query("H27_strict_canonical", f"""SELECT k, payload, sequence FROM (SELECT user_id * 10 + event_id % 10 AS k, event_id AS sequence, value AS payload, CASE WHEN event_id % 10 < 3 THEN ts END AS c, {RAW} AS raw_clock FROM events) e
WHERE k NOT IN (SELECT user_id * 10 + event_id % 10 FROM events WHERE event_id % 10 >= 3 GROUP BY 1 HAVING count(DISTINCT trim(coalesce({RAW}, ''))) > 1) QUALIFY row_number() OVER (PARTITION BY k ORDER BY c DESC NULLS LAST, sequence DESC) = 1""")
def _(s, d):
    log = raw_observations(s, d)
    return observations.canonical_strict(log.join(observations.ambiguous_keys(log, ["k"]), "k", "left_anti"), ["k"], ["payload"]).select("k", "payload", "sequence")


SELECTED = """sel AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN replace(url, 'http://', 'HTTPS://') WHEN 2 THEN concat('https://Git.Example.:443/o.rg/', cast(page_id AS varchar(20)), '.git//?tab=1#x') WHEN 3 THEN concat('org/n-', cast(page_id AS varchar(20)))
WHEN 4 THEN 'a/b/c' WHEN 5 THEN concat('https://[0:0::1]:8443/o/', cast(page_id AS varchar(20))) WHEN 6 THEN 'https://bad_host/o/n' ELSE 'o rg/name' END AS s FROM pages)"""
CANONICAL = "CASE WHEN a = '[0:0::1]:8443' THEN '[::1]:8443' ELSE regexp_replace(regexp_replace(lower(a), ':443$', ''), '\\.$', '') END"


SQL["H24_parse_repository"] = with_relations("").rstrip() + ",\n" + SELECTED + rf""",
p AS (SELECT page_id, s, s LIKE '%://%' AS url, regexp_extract(s, '(?i)^https://([^/]*)/', 1) AS a, rtrim(regexp_extract(s, '(?i)^https://[^/]*/([^?#]*)', 1), '/') AS path FROM sel),
q AS (SELECT *, CASE WHEN url THEN path ELSE s END AS t FROM p),
r AS (SELECT *, regexp_full_match(t, '[^\s/#?@]+/[^\s/#?@]+') AND (NOT url OR (a <> '' AND a <> 'bad_host')) AS ok FROM q)
SELECT page_id, CASE WHEN ok THEN CASE WHEN url THEN {CANONICAL} ELSE 'git.example' END END AS host, CASE WHEN ok THEN split_part(t, '/', 1) END AS owner, CASE WHEN ok THEN split_part(t, '/', 2) END AS name FROM r"""


@query("H24_parse_repository")
def _(s, d):
    """Addresses of pages, of repositories on hosts to be made canonical, short names, and what is neither."""
    rows = s.read.parquet(f"{d}/pages.parquet").selectExpr("page_id", SELECTED[SELECTED.index("CASE") : SELECTED.index(" FROM pages)")])
    return rows.select("page_id", identity.parse_repository(F.col("s"), HOST).alias("r")).select("page_id", "r.*")


SELECTOR = "CASE thread_id % 6 WHEN 0 THEN concat(full_name, '#', cast(number AS varchar(20))) WHEN 1 THEN concat('https://Git.Example:443/', full_name, '/pull/', cast(number AS varchar(20)), '/?a=b') WHEN 2 THEN concat('HTTPS://git.example./', full_name, '/issues/00', cast(number AS varchar(20)), '#c1') WHEN 3 THEN concat(full_name, '#0') WHEN 4 THEN concat('https://git.example/', full_name, '/pulls/', cast(number AS varchar(20))) ELSE concat(full_name, '/issues/', cast(number AS varchar(20))) END"


@query("H25_parse_thread", "SELECT thread_id, CASE WHEN m < 3 THEN 'git.example' END AS host, CASE WHEN m < 3 THEN 'org' END AS owner, CASE WHEN m < 3 THEN substr(full_name, 5) END AS name, CASE m WHEN 1 THEN 'pull' WHEN 2 THEN 'issues' END AS kind, CASE WHEN m < 3 THEN number END AS number FROM (SELECT *, thread_id % 6 AS m FROM threads)", "threads")
def _(s, d):
    """Short selectors, addresses of both kinds, and three forms that are none."""
    t = relation(s, d, "threads").select("thread_id", F.expr(SELECTOR).alias("sel"))
    return t.select("thread_id", identity.parse_thread(F.col("sel"), HOST).alias("r")).select("thread_id", "r.*")


@query("H21_H26_source_clock", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'missing' WHEN event_id % 3 = 1 THEN 'valid' ELSE 'invalid' END AS state, CASE WHEN event_id % 3 = 2 THEN 'not-a-time' END AS raw, CASE WHEN event_id % 3 = 1 THEN epoch_us(ts) END AS us FROM events")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", F.when(F.col("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).when(F.col("event_id") % 3 == 2, "not-a-time").alias("raw"))
    return e.select("event_id", identity.source_clock(F.col("raw")).alias("c")).select("event_id", "c.*")


@query("H18_H19_D20_vectors", "SELECT thread_id, chunk_index, round(sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])), 5) AS norm, array_to_string(list_transform(vector[1:8]::DOUBLE[], lambda x: round(x / sqrt(list_dot_product(vector::DOUBLE[], vector::DOUBLE[])), 4)::DECIMAL(9, 4)), ' ') AS unit FROM chunks", "chunks")
def _(s, d):
    first = F.transform(F.slice(vectors.unit(F.col("vector")), 1, 8), lambda x: F.round(x, 4).cast("decimal(9,4)").cast("string"))
    return relation(s, d, "chunks").select("thread_id", "chunk_index", F.round(vectors.norm(F.col("vector")), 5).alias("norm"), F.array_join(first, " ").alias("unit"))


@query("H2_near_columns_keyword")
def _(s, d):
    return search.keyword_search(relation(s, d, "threads"), search.parse_expression("NEAR(with that, 40) OR {title}: ^the OR -title: (que + les)")).select("thread_id")


NEAR_SQL = """WITH tok AS (SELECT thread_id, {t} AS t, {b} AS b FROM threads),
pos AS (SELECT thread_id, 'title' AS c, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM tok UNION ALL SELECT thread_id, 'body', unnest(b), generate_subscripts(b, 1) - 1 FROM tok),
near AS (SELECT DISTINCT x.thread_id FROM pos x JOIN pos y ON x.thread_id = y.thread_id AND x.c = y.c WHERE x.w = 'with' AND y.w = 'that' AND x.i + 1 + 40 >= y.i AND y.i + 1 + 40 >= x.i),
two AS (SELECT DISTINCT x.thread_id FROM pos x JOIN pos y ON x.thread_id = y.thread_id AND x.c = 'body' AND y.c = 'body' AND y.i = x.i + 1 WHERE x.w = 'que' AND y.w = 'les')
SELECT thread_id FROM (SELECT thread_id FROM near UNION SELECT thread_id FROM pos WHERE c = 'title' AND i = 0 AND w = 'the' UNION SELECT thread_id FROM two)"""
SQL["H2_near_columns_keyword"] = with_relations("", "threads").rstrip() + ",\n" + NEAR_SQL.format(t=TOK.format(c="title"), b=TOK.format(c="body"))[5:]


@query("A13_H4_indexed_bm25")
def _(s, d):
    """The same search over a written index."""
    import uuid

    from threadloom.operators.search_index import SearchIndex

    index = SearchIndex.create(relation(s, d, "threads"), f"{clustering.shared_folder(s)}/index-{uuid.uuid4().hex}", buckets=16)
    return index.find(search.plain_expression("with that")).select("thread_id", F.round("bm25", 6).alias("bm25"))


@query("A13_incremental_index")
def _(s, d):
    """An index of older texts after threads were added, changed and removed, some of its segments merged."""
    import uuid

    from threadloom.operators.search_index import SearchIndex

    t = relation(s, d, "threads")
    older = t.where("thread_id % 5 <> 0").withColumn("body", F.expr("CASE WHEN thread_id % 7 < 2 THEN concat('with that and with that ', title) ELSE body END"))
    index = SearchIndex.create(older, f"{clustering.shared_folder(s)}/index-{uuid.uuid4().hex}", buckets=16)
    index.apply(t.where("thread_id % 5 = 0 OR thread_id % 7 = 0"))
    index.apply(t.where("thread_id % 7 = 1 AND thread_id % 11 <> 0"), t.where("thread_id % 11 = 0"))
    index.merge()
    index.apply(t.where("thread_id % 11 > 1 AND thread_id % 13 = 0"), t.where("thread_id % 11 = 1"))
    return index.find(search.plain_expression("with that")).select("thread_id", F.round("bm25", 6).alias("bm25"))


SQL["A13_incremental_index"] = SQL["H1_H4_bm25_keyword"].replace("FROM documents)", "FROM documents WHERE (doc_id + 1) % 11 > 1)", 1)
SQL["A13_H4_indexed_bm25"] = SQL["H1_H4_bm25_keyword"]


@query("A16_json_envelope", """SELECT '{"schema_version":1,"command":"threads","data":{"thread_id":' || thread_id || ',"kind":"' || kind || '"},"warnings":[]}' AS value FROM threads""", "threads")
def _(s, d):
    from threadloom.sources.landing import envelope

    return envelope(relation(s, d, "threads").select("thread_id", "kind"), "threads")
