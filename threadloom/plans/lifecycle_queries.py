"""Queries over what an archive keeps of its own work: currency of vectors, coverage in context, decisions, acquisition."""

from __future__ import annotations

from pyspark.sql import functions as F

from threadloom.functions import identity
from threadloom.operators import decisions, embeddings, families, ledger, listing, observations, ordering
from threadloom.plans.archive_queries import CLUSTERS, EPOCH_US, HOST, LATEST, SQL, _clusterings, query
from threadloom.sources.archive import relation, repositories, with_relations


def state(s, d):
    """Recorded coverage of two child families, with its clock, count, head and time."""
    return relation(s, d, "review_state").unionByName(relation(s, d, "comment_state"))


def context(s, d):
    heads = relation(s, d, "heads")
    t = relation(s, d, "threads").join(heads.select("thread_id", F.col("expected_comments").cast("long").alias("expected_comments")), "thread_id")
    return listing.coverage_context(t, state(s, d), heads.where("is_pull_request").select("thread_id", "head_sha"))


STATE = "fam AS (SELECT * FROM review_state UNION ALL SELECT * FROM comment_state)"
CONTEXT = STATE + """,
ctx AS (SELECT t.thread_id, f.family, coalesce(c.status, 'missing') AS status,
  CASE WHEN c.status IS NULL THEN false WHEN f.family = 'comments' THEN NOT (c.clock_us = t.updated_at_us AND (c.status <> 'complete' OR coalesce(h.expected_comments = c.item_count, false)))
       WHEN f.family IN ('reviews', 'review_threads') THEN NOT (c.clock_us = t.updated_at_us AND c.head_sha IS NOT DISTINCT FROM CASE WHEN h.is_pull_request THEN h.head_sha END) ELSE false END AS stale
  FROM threads t JOIN heads h USING (thread_id) JOIN families f ON NOT f.pull_request_only OR t.kind = 'pull_request' LEFT JOIN fam c ON c.thread_id = t.thread_id AND c.family = f.family)"""


def more(sql: str, *names: str, before: str = "") -> str:
    """The relations named, further common table expressions, and the statement."""
    return with_relations("", *names).rstrip() + (",\n" + before if before else "") + "\n" + sql


@query("C5_C9_H28_coverage_context")
def _(s, d):
    return context(s, d)


SQL["C5_C9_H28_coverage_context"] = more("SELECT * FROM ctx", "threads", "heads", "review_state", "comment_state", before=CONTEXT)


@query("D5_newest_evidence")
def _(s, d):
    return embeddings.newest_evidence(state(s, d))


SQL["D5_newest_evidence"] = more("SELECT thread_id, max(observed_at_us) AS observed_at_us FROM fam GROUP BY thread_id", "review_state", "comment_state", before=STATE)


def vectors(s, d):
    """Every ninth vector was made from a text that has changed since."""
    v = relation(s, d, "stored_vectors").join(relation(s, d, "stored_documents").select("document_id", "content_hash"), "document_id")
    return v.withColumn("document_hash", F.when(F.col("vec_id") % 9 == 0, "before").otherwise(F.col("content_hash"))).drop("content_hash")


VECTORS = "v AS (SELECT s.*, CASE WHEN vec_id % 9 = 0 THEN 'before' ELSE content_hash END AS document_hash FROM stored_vectors s JOIN stored_documents USING (document_id))"
CURRENT = "d.recipe = '{recipe}' AND d.recipe_version = 1 AND d.source_updated_at_us = t.updated_at_us AND v.endpoint = 'main' AND v.model = 'new' AND v.document_hash = d.content_hash"


@query("B7_C7_current_vectors")
def _(s, d):
    docs = embeddings.current_documents(relation(s, d, "stored_documents"), relation(s, d, "threads"), "original_body", 1)
    return embeddings.current_vectors(vectors(s, d), docs, "main", "new").select("document_id", "thread_id", "vec_id")


SQL["B7_C7_current_vectors"] = more(f"SELECT v.document_id, t.thread_id, v.vec_id FROM v JOIN stored_documents d USING (document_id) JOIN threads t ON t.thread_id = d.thread_id WHERE {CURRENT.format(recipe='original_body')}", "threads", "stored_documents", "stored_vectors", before=VECTORS)


@query("B8_B9_current_enriched_vectors")
def _(s, d):
    docs = embeddings.current_documents(relation(s, d, "stored_documents"), relation(s, d, "threads"), "discussion_enriched", 1, context(s, d), state(s, d))
    return embeddings.current_vectors(vectors(s, d), docs, "main", "new").select("document_id", "thread_id", "vec_id")


SQL["B8_B9_current_enriched_vectors"] = more(
    f"""SELECT v.document_id, t.thread_id, v.vec_id FROM v JOIN stored_documents d USING (document_id) JOIN threads t ON t.thread_id = d.thread_id WHERE {CURRENT.format(recipe='discussion_enriched')}
AND d.built_at_us >= coalesce((SELECT max(observed_at_us) FROM fam WHERE fam.thread_id = t.thread_id), 0) AND NOT EXISTS (SELECT 1 FROM ctx WHERE ctx.thread_id = t.thread_id AND ctx.stale)""",
    "threads", "heads", "review_state", "comment_state", "stored_documents", "stored_vectors", before=VECTORS + ",\n" + CONTEXT,
)


@query("D17_distinct_documents", "SELECT DISTINCT document_id, recipe, content_hash FROM stored_documents JOIN stored_vectors USING (document_id)", "stored_documents", "stored_vectors")
def _(s, d):
    return relation(s, d, "stored_documents").join(relation(s, d, "stored_vectors"), "document_id").select("document_id", "recipe", "content_hash").distinct()


@query("I10_upsert_documents", f"""SELECT d.thread_id, d.recipe, d.document_id, 1 AS recipe_version, CASE WHEN thread_id % 3 = 0 THEN 'changed' ELSE content_hash END AS content_hash, d.title, d.source_updated_at_us + CASE WHEN thread_id % 4 = 0 THEN 5 ELSE 0 END AS source_updated_at_us,
CASE WHEN thread_id % 3 = 0 OR recipe_version <> 1 THEN {EPOCH_US} ELSE built_at_us END AS built_at_us, thread_id % 3 = 0 AS content_changed, thread_id % 3 = 0 OR thread_id % 4 = 0 OR recipe_version <> 1 AS written FROM stored_documents d
UNION ALL SELECT -thread_id, recipe, NULL, 1, CASE WHEN thread_id % 3 = 0 THEN 'changed' ELSE content_hash END, title, source_updated_at_us + CASE WHEN thread_id % 4 = 0 THEN 5 ELSE 0 END, {EPOCH_US}, true, true FROM stored_documents WHERE thread_id % 5 = 0""", "stored_documents")
def _(s, d):
    now = relation(s, d, "stored_documents")
    made = now.selectExpr("thread_id", "recipe", "1 AS recipe_version", "CASE WHEN thread_id % 3 = 0 THEN 'changed' ELSE content_hash END AS content_hash", "title", "source_updated_at_us + CASE WHEN thread_id % 4 = 0 THEN 5 ELSE 0 END AS source_updated_at_us")
    new = made.where("thread_id % 5 = 0").withColumn("thread_id", -F.col("thread_id"))
    return embeddings.upsert_documents(now, made.unionByName(new), EPOCH_US)


@query("I11_upsert_vectors")
def _(s, d):
    v = vectors(s, d).select("document_id", "endpoint", "model", "document_hash", "chunk_index", "vec_id")
    new = v.withColumn("vec_id", -F.col("vec_id") - 1).withColumn("chunk_index", F.col("chunk_index") + F.when(F.col("document_id") % 20 == 0, 0).otherwise(5))
    return embeddings.upsert_vectors(v, new, relation(s, d, "stored_documents"))


SQL["I11_upsert_vectors"] = more(
    """SELECT * FROM merged""",
    "stored_documents", "stored_vectors", before=VECTORS + """,
n AS (SELECT document_id, endpoint, model, document_hash, chunk_index + CASE WHEN document_id % 20 = 0 THEN 0 ELSE 5 END AS chunk_index, -vec_id - 1 AS vec_id FROM v WHERE vec_id % 9 <> 0),
merged AS (SELECT document_id, endpoint, model, document_hash, chunk_index, vec_id FROM n UNION ALL SELECT document_id, endpoint, model, document_hash, chunk_index, vec_id FROM v ANTI JOIN n USING (document_id, endpoint, model, document_hash, chunk_index))""",
)


@query("D22_embedding_report", "SELECT count(*) AS documents, sum(items)::BIGINT AS selected, sum(CASE WHEN status = 'complete' THEN items END)::BIGINT AS embedded, sum(CASE WHEN status = 'deferred' THEN items ELSE 0 END)::BIGINT AS skipped, count(*) FILTER (status = 'failed') AS failed, bool_or(items > 49) AS cancelled FROM jobs", "jobs")
def _(s, d):
    j = relation(s, d, "jobs")
    when = lambda x: F.when(F.col("status") == x, F.col("items"))
    return embeddings.report(j.select(F.lit(1).alias("documents"), F.col("items").alias("selected"), when("complete").alias("embedded"), when("deferred").alias("skipped"), (F.col("status") == "failed").cast("int").alias("failed"), (F.col("items") > 49).alias("cancelled")))


# Clusters and decisions

BOARD = f"cl AS (SELECT DISTINCT thread_id // 3 AS cluster, '{HOST}' AS host, 'src' AS repo_id, CASE WHEN (thread_id // 3) % 4 = 0 THEN 'retired' ELSE 'active' END AS status, (thread_id // 3) * 3 + 2 AS canonical FROM threads), mem AS (SELECT thread_id // 3 AS cluster, thread_id, CASE WHEN thread_id % 7 = 0 THEN 'removed' WHEN thread_id % 5 = 0 THEN 'excluded' ELSE 'active' END AS state FROM threads)"


def board(s, d):
    """Clusters of three threads of one repository, with members of every state."""
    t = relation(s, d, "threads").withColumn("repo_id", F.lit("src"))
    c = F.floor(F.col("thread_id") / 3)
    clusters = t.select(c.alias("cluster")).distinct().selectExpr("cluster", f"'{HOST}' AS host", "'src' AS repo_id", "CASE WHEN cluster % 4 = 0 THEN 'retired' ELSE 'active' END AS status", "cluster * 3 + 2 AS canonical")
    return t, clusters, t.select(c.alias("cluster"), "thread_id", F.when(F.col("thread_id") % 7 == 0, "removed").when(F.col("thread_id") % 5 == 0, "excluded").otherwise("active").alias("state"))


@query("C6_F4_list_clusters")
def _(s, d):
    _, clusters, members = board(s, d)
    return decisions.list_clusters(clusters.select("cluster", "status"), members, 20, 10).select("cluster", "active", F.col("position").cast("long").alias("position"), "next_offset")


SQL["C6_F4_list_clusters"] = more("SELECT cluster, active, position - 1 AS position, CASE WHEN found > 30 THEN 30 END::BIGINT AS next_offset FROM (SELECT *, row_number() OVER (ORDER BY active DESC, cluster) AS position, count(*) OVER () AS found FROM (SELECT cl.cluster, count(m.thread_id) AS active FROM cl LEFT JOIN mem m ON m.cluster = cl.cluster AND m.state = 'active' WHERE status = 'active' GROUP BY cl.cluster)) WHERE position BETWEEN 11 AND 30", "threads", before=BOARD)


@query("C20_F5_cluster_members")
def _(s, d):
    t, _, members = board(s, d)
    return decisions.cluster_members(members, t).select("cluster", "thread_id", "state", "number", "title", F.col("position").cast("long").alias("position"))


SQL["C20_F5_cluster_members"] = more("SELECT cluster, thread_id, mem.state, number, title, row_number() OVER (PARTITION BY cluster ORDER BY number, thread_id) AS position FROM mem JOIN threads USING (thread_id) WHERE mem.state IN ('active', 'excluded')", "threads", before=BOARD)

JUDGED = BOARD + """,
j0 AS (SELECT de.*, cl.host AS ch, cl.repo_id AS cr, t.thread_id, m.state FROM decisions de LEFT JOIN cl USING (cluster) LEFT JOIN threads t ON t.number = de.number AND cl.cluster IS NOT NULL LEFT JOIN mem m ON m.cluster = de.cluster AND m.thread_id = t.thread_id),
j1 AS (SELECT *, state IS NOT NULL AND state <> 'removed' AS live, host = ch AND repo_id = cr AS home FROM j0),
j2 AS (SELECT *, coalesce(last_value(CASE WHEN action IN ('exclude', 'include') AND live AND home THEN CASE WHEN action = 'exclude' THEN 'excluded' ELSE 'active' END END IGNORE NULLS) OVER (PARTITION BY cluster, thread_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), state) AS now FROM j1),
j AS (SELECT *, CASE WHEN ch IS NULL THEN 'cluster_missing' WHEN action IN ('dismiss', 'restore') THEN 'ok' WHEN NOT home THEN 'member_missing' WHEN thread_id IS NULL THEN 'thread_missing' WHEN NOT live THEN 'member_missing' WHEN action = 'canonical' AND now <> 'active' THEN 'member_missing' ELSE 'ok' END AS result FROM j2)"""


def judged(s, d):
    t, clusters, members = board(s, d)
    return clusters, members, decisions.judged(relation(s, d, "decisions"), clusters, members, t)


@query("C11_I13_judged_decisions")
def _(s, d):
    return judged(s, d)[2].select("seq", "cluster", "action", "result", "reason")


SQL["C11_I13_judged_decisions"] = more("SELECT seq, cluster, action, result, trim(reason) AS reason FROM j", "threads", "decisions", before=JUDGED)


@query("I13_members_after_decisions")
def _(s, d):
    _, members, done = judged(s, d)
    return decisions.members_after(members, decisions.events_of(done))


SQL["I13_members_after_decisions"] = more("SELECT m.cluster, m.thread_id, coalesce((SELECT CASE WHEN max_by(action, seq) = 'exclude' THEN 'excluded' ELSE 'active' END FROM j WHERE j.cluster = m.cluster AND j.thread_id = m.thread_id AND result = 'ok' AND action IN ('exclude', 'include') HAVING count(*) > 0), m.state) AS state FROM mem m", "threads", "decisions", before=JUDGED)


@query("I13_clusters_after_decisions")
def _(s, d):
    clusters, _, done = judged(s, d)
    return decisions.clusters_after(clusters.select("cluster", "canonical"), decisions.events_of(done))


SQL["I13_clusters_after_decisions"] = more("""SELECT cl.cluster, CASE WHEN NOT EXISTS (SELECT 1 FROM j WHERE j.cluster = cl.cluster AND result = 'ok' AND action = 'exclude' AND j.thread_id = coalesce(k.t, cl.canonical) AND j.seq > coalesce(k.s, -1)) THEN coalesce(k.t, cl.canonical) END AS canonical,
CASE WHEN x.a = 'dismiss' THEN x.at END AS dismissed_at_us, CASE WHEN x.a = 'dismiss' THEN x.r ELSE '' END AS dismissal_reason FROM cl
LEFT JOIN (SELECT cluster, max_by(thread_id, seq) AS t, max(seq) AS s FROM j WHERE result = 'ok' AND action = 'canonical' GROUP BY cluster) k USING (cluster)
LEFT JOIN (SELECT cluster, max_by(action, seq) AS a, max_by(at_us, seq) AS at, max_by(trim(reason), seq) AS r FROM j WHERE result = 'ok' AND action IN ('dismiss', 'restore') GROUP BY cluster) x USING (cluster)""", "threads", "decisions", before=JUDGED)


@query("I13_audit_events")
def _(s, d):
    return decisions.events_of(judged(s, d)[2])


SQL["I13_audit_events"] = more("SELECT seq, cluster, CASE action WHEN 'dismiss' THEN 'dismissed' WHEN 'restore' THEN 'restored' WHEN 'exclude' THEN 'member_excluded' WHEN 'include' THEN 'member_included' ELSE 'canonical_set' END AS event_type, CASE WHEN action NOT IN ('dismiss', 'restore') THEN thread_id END AS thread_id, trim(reason) AS reason, at_us FROM j WHERE result = 'ok'", "threads", "decisions", before=JUDGED)


@query("B11_I12_retired_clusters")
def _(s, d):
    _, g, x = _clusterings(s, d)
    return decisions.retired(x.select("cluster").distinct(), g.where("cluster % 3 <> 0"))


SQL["B11_I12_retired_clusters"] = more("SELECT cluster, CASE WHEN cluster NOT IN (SELECT cluster FROM g WHERE cluster % 3 <> 0) THEN 'retired' ELSE 'active' END AS status FROM (SELECT DISTINCT cluster FROM x)", "threads", before=CLUSTERS)


# Acquisition

RANKED = "coalesce(source_clock, TIMESTAMP '0001-01-01')"


@query("I4_family_reservations", f"""SELECT thread_id, family, sequence, coalesce({RANKED} >= max({RANKED}) OVER (PARTITION BY thread_id, family ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS reserved FROM (SELECT * REPLACE (CASE WHEN sequence % 6 = 0 THEN NULL ELSE source_clock END AS source_clock) FROM observations)""", "observations")
def _(s, d):
    return families.reservations(clocked(s, d)).select("thread_id", "family", "sequence", "reserved")


def clocked(s, d):
    """Every sixth observation has no usable clock."""
    return relation(s, d, "observations").withColumn("source_clock", F.when(F.col("sequence") % 6 != 0, F.col("source_clock")))


@query("I5_J4_staged_pages", "SELECT run_id, job_no % 3 AS page_index, min(items) AS payload, count(*) - 1 AS replays, count(DISTINCT items) > 1 AS conflict FROM jobs GROUP BY run_id, job_no % 3", "jobs")
def _(s, d):
    j = relation(s, d, "jobs").select("run_id", (F.col("job_no") % 3).alias("page_index"), F.col("items").alias("payload"))
    return families.staged_pages(j, ["run_id"])


HELD_SQL = f"held AS (SELECT thread_id, family, sequence FROM observations QUALIFY {LATEST}), res AS (SELECT thread_id, family, sequence, sequence * 2 AS arrival, status FROM observations UNION ALL SELECT thread_id, family, sequence, sequence * 2 + 1, status FROM observations WHERE sequence % 4 = 0)"


@query("I6_J5_finishes")
def _(s, d):
    log = relation(s, d, "observations")
    held = families.current_reservations(log)
    res = log.select("thread_id", "family", "sequence", (F.col("sequence") * 2).alias("arrival"), "status")
    res = res.unionByName(res.where("sequence % 4 = 0").withColumn("arrival", F.col("arrival") + 1)).withColumn("head_sha", F.when(F.col("sequence") % 5 != 0, "a"))
    return families.finishes(res, held).select("thread_id", "family", "sequence", "arrival", "disposition")


SQL["I6_J5_finishes"] = more("""SELECT r.thread_id, r.family, r.sequence, r.arrival, CASE WHEN h.sequence IS DISTINCT FROM r.sequence THEN 'skipped' WHEN r.arrival % 2 = 1 THEN 'replayed' WHEN r.family IN ('reviews', 'review_threads') AND r.status = 'complete' AND r.sequence % 5 = 0 THEN 'invalid' ELSE 'applied' END AS disposition
FROM res r LEFT JOIN held h ON h.thread_id = r.thread_id AND h.family = r.family""", "observations", before=HELD_SQL)


PAST = "(PARTITION BY repo_id, sequence ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@query("I8_scan_states", f"""SELECT repo_id, sequence, count(*) FILTER (page) AS pages, coalesce(sum(threads) FILTER (page), 0)::BIGINT AS threads, nullif(max_by(coalesce(cursor, '-'), arrival) FILTER (page OR action = 'begin'), '-') AS cursor,
coalesce(min_by(status, arrival) FILTER (ends AND NOT ended), 'in_progress') AS status FROM (
SELECT *, action = 'page' AND began AND NOT ended AS page FROM (
SELECT *, coalesce(max(ends::INT) OVER {PAST}, 0) = 1 AS ended FROM (
SELECT *, action = 'finish' AND began AND NOT (status = 'complete' AND leftover IS NOT NULL) AS ends FROM (
SELECT l.*, coalesce(max((action = 'begin')::INT) OVER {PAST}, 0) = 1 AS began, nullif(last_value(CASE WHEN action <> 'finish' THEN coalesce(cursor, '-') END IGNORE NULLS) OVER {PAST}, '-') AS leftover
FROM scan_log l SEMI JOIN (SELECT repo_id, max(sequence) AS sequence FROM scan_log WHERE action = 'begin' GROUP BY repo_id) b USING (repo_id, sequence))))) GROUP BY repo_id, sequence""", "scan_log")
def _(s, d):
    return families.scan_states(relation(s, d, "scan_log"))


@query("I9_C13_watermarks", """SELECT coalesce(c.key, n.key) AS key, CASE WHEN n.sequence > coalesce(c.sequence, -1) THEN n.watermark_us ELSE c.watermark_us END AS watermark_us, CASE WHEN n.sequence > coalesce(c.sequence, -1) THEN n.sequence ELSE c.sequence END AS sequence
FROM (SELECT DISTINCT repo_id AS key, 7::BIGINT AS watermark_us, repo_id % 6 AS sequence FROM scan_log) c FULL JOIN (SELECT repo_id AS key, max_by(arrival * 100, sequence * 1000000 + arrival) AS watermark_us, max(sequence) AS sequence FROM scan_log WHERE status = 'complete' AND cursor IS NULL GROUP BY repo_id) n USING (key)""", "scan_log")
def _(s, d):
    log = relation(s, d, "scan_log")
    now = log.select(F.col("repo_id").alias("key"), F.lit(7).cast("long").alias("watermark_us"), (F.col("repo_id") % 6).alias("sequence")).distinct()
    last = log.where("status = 'complete'").groupBy("repo_id", "sequence", "status", "cursor").agg(F.max("arrival").alias("arrival"))
    per = last.where("cursor IS NULL").select(F.col("repo_id").alias("key"), (F.col("arrival") * 100).alias("watermark_us"), "sequence", "status", "cursor")
    return observations.advance_watermark(now, per)


@query("J7_revisited_pages")
def _(s, d):
    e = relation(s, d, "scan_log").selectExpr("repo_id AS scan", "arrival AS page_index", "concat('u', cast(arrival % 40 AS varchar(20))) AS url", "concat('u', cast((arrival * 7 + 3) % 90 AS varchar(20))) AS next_url")
    return families.revisited(e)


SQL["J7_revisited_pages"] = more("SELECT DISTINCT p.scan, p.page_index FROM pg p JOIN pg q ON q.scan = p.scan AND q.url = p.next_url AND q.page_index <= p.page_index", "scan_log", before="pg AS (SELECT repo_id AS scan, arrival AS page_index, 'u' || (arrival % 40) AS url, 'u' || ((arrival * 7 + 3) % 90) AS next_url FROM scan_log)")


@query("J6_commit_order", """SELECT repo_id AS scan, coalesce(max(arrival) FILTER (k = 0) < min(arrival) FILTER (k = 1), min(arrival) FILTER (k = 1) IS NULL) AND coalesce(max(arrival) FILTER (k = 1) < min(arrival) FILTER (k = 2), min(arrival) FILTER (k = 2) IS NULL) AS ok
FROM (SELECT repo_id, sequence, arrival + CASE WHEN repo_id % 2 = 0 THEN (arrival % 3) * 100000 ELSE 0 END AS arrival, arrival % 3 AS k FROM scan_log) GROUP BY repo_id""", "scan_log")
def _(s, d):
    log = relation(s, d, "scan_log").selectExpr("repo_id AS scan", "arrival + CASE WHEN repo_id % 2 = 0 THEN (arrival % 3) * 100000 ELSE 0 END AS arrival", "CASE arrival % 3 WHEN 0 THEN 'observation' WHEN 1 THEN 'cursor' ELSE 'coverage' END AS step")
    return families.committed(log)


@query("J8_units", "SELECT DISTINCT target, u.state FROM (SELECT target, CASE WHEN run_id % 3 = 0 THEN '' ELSE scope_key END AS scope_key FROM jobs) j JOIN (VALUES ('open'), ('closed')) u(state) ON j.scope_key NOT IN ('open', 'closed') OR j.scope_key = u.state", "jobs")
def _(s, d):
    return families.units_of(relation(s, d, "jobs").select("target", F.when(F.col("run_id") % 3 == 0, "").otherwise(F.col("scope_key")).alias("scope_key")))


@query("J9_isolated_failures", "SELECT run_id, count(*) FILTER (status <> 'failed') AS done, count(*) FILTER (status = 'failed') AS failed, CASE WHEN bool_and(status <> 'failed') THEN 'complete' WHEN bool_and(status = 'failed') THEN 'failed' ELSE 'partial' END AS outcome FROM jobs GROUP BY run_id", "jobs")
def _(s, d):
    return families.outcomes(relation(s, d, "jobs").select("run_id", F.when(F.col("status") == "failed", "failed").alias("error")))


@query("C23_F16_child_membership", "SELECT thread_id, provider_id, row_number() OVER (PARTITION BY thread_id ORDER BY provider_id) AS position FROM comments", "comments")
def _(s, d):
    return listing.children(relation(s, d, "comments").select("thread_id", "provider_id")).withColumn("position", F.col("position").cast("long"))


# Ledger

FAILURES = """fl AS (SELECT run_id, job_no, part, CASE WHEN part % 5 = 0 THEN 'org/gone' || part % 7 WHEN part % 5 = 1 THEN 'not a target' ELSE target END AS target, CASE WHEN part % 4 = 0 THEN NULL ELSE family END AS family, CASE WHEN part % 3 = 0 THEN '' ELSE scope_key END AS scope_key, CASE WHEN part % 6 = 0 THEN 'own' || (part % 18) END AS repository, CASE WHEN part % 12 = 0 THEN part % 8 END AS thread, run_id * 10 + job_no AS failure_id, resolved, 0 AS retry_count, NULL::INTEGER AS retry_run FROM jobs WHERE status = 'failed')"""


def failures(s, d):
    return relation(s, d, "jobs").where("status = 'failed'").selectExpr(
        "run_id", "job_no", "part", "CASE WHEN part % 5 = 0 THEN concat('org/gone', cast(part % 7 AS varchar(20))) WHEN part % 5 = 1 THEN 'not a target' ELSE target END AS target", "CASE WHEN part % 4 = 0 THEN NULL ELSE family END AS family",
        "CASE WHEN part % 3 = 0 THEN '' ELSE scope_key END AS scope_key", "CASE WHEN part % 6 = 0 THEN concat('own', cast(part % 18 AS varchar(20))) END AS repository", "CASE WHEN part % 12 = 0 THEN part % 8 END AS thread", "run_id * 10 + job_no AS failure_id", "resolved", "0 AS retry_count", "cast(NULL AS int) AS retry_run",
    )


@query("C19_repository_of_failures")
def _(s, d):
    jobs = relation(s, d, "jobs").withColumn("repo_id", F.concat("target", F.lit("@"), F.col("job_no").cast("string")))
    return ledger.repository_of_failures(failures(s, d), jobs).select("run_id", "job_no", "part", "found")


SQL["C19_repository_of_failures"] = more("""SELECT run_id, job_no, part, coalesce(repository, (SELECT min_by(j.target || '@' || j.job_no, j.job_no) FROM jobs j WHERE j.run_id = fl.run_id AND j.target = fl.target AND (fl.family IS NULL OR j.family = fl.family) AND (fl.scope_key = '' OR j.scope_key = fl.scope_key)),
CASE WHEN regexp_full_match(target, '[A-Za-z0-9._-]+/[A-Za-z0-9._-]+') THEN target END) AS found FROM fl""", "jobs", before=FAILURES)


@query("D3_work_diagnostics")
def _(s, d):
    return ledger.diagnostics(relation(s, d, "runs"), relation(s, d, "jobs"), failures(s, d))


SQL["D3_work_diagnostics"] = more("""SELECT (SELECT count(*) FROM jobs WHERE status = 'failed') AS failed_jobs, (SELECT count(*) FROM jobs WHERE status = 'deferred') AS deferred_jobs, (SELECT count(*) FROM runs WHERE status = 'in_progress') AS in_progress_runs,
(SELECT count(*) FROM fl WHERE NOT resolved AND family IS NULL) AS unassigned_failures, (SELECT count(*) FROM fl WHERE NOT resolved) AS unresolved_failures""", "runs", "jobs", before=FAILURES)

#: The run that retries, which has failures of its own, and the scopes it works on: some of selectors, some of threads.
RETRY_RUN = 3
WORKED = "family IN ('comments', 'reviews') AND scope_key <> '' AND (repository IS NULL OR part % 5 < 3)"
TOUCHED = f"""hit AS (SELECT f.*, NOT f.resolved AND f.run_id <> {RETRY_RUN} AND (
  (f.repository IS NULL AND EXISTS (SELECT 1 FROM fl g WHERE {{worked}} AND g.repository IS NULL AND g.target = f.target AND g.family = f.family AND g.scope_key = f.scope_key))
  OR EXISTS (SELECT 1 FROM fl g WHERE {{worked}} AND g.repository = f.repository AND g.thread = f.thread AND g.family = f.family AND g.scope_key = f.scope_key)) AS hit FROM fl f)""".replace("{worked}", "g." + WORKED.replace(" AND scope_key", " AND g.scope_key").replace("(repository", "(g.repository").replace("OR part", "OR g.part"))


@query("B20_I15_mark_retried")
def _(s, d):
    f = failures(s, d)
    return ledger.mark_retried(f, f.where(WORKED), RETRY_RUN).select("run_id", "job_no", "part", "retry_count", "retry_run")


SQL["B20_I15_mark_retried"] = more(f"SELECT run_id, job_no, part, CASE WHEN hit THEN 1 ELSE 0 END AS retry_count, CASE WHEN hit THEN {RETRY_RUN} END AS retry_run FROM hit", "jobs", before=FAILURES + ",\n" + TOUCHED)


@query("I15_resolve_failures")
def _(s, d):
    """Some were retried by an earlier run already, which stays."""
    f = failures(s, d).withColumn("retry_run", F.expr("CASE WHEN part % 4 = 1 THEN 2 END"))
    return ledger.resolve(f, f.where(WORKED), RETRY_RUN).select("run_id", "job_no", "part", "resolved", "retry_run")


SQL["I15_resolve_failures"] = more(f"SELECT run_id, job_no, part, resolved OR hit AS resolved, CASE WHEN part % 4 = 1 THEN 2 WHEN hit THEN {RETRY_RUN} END AS retry_run FROM hit", "jobs", before=FAILURES + ",\n" + TOUCHED)

ASKED = "CASE run_id % 3 WHEN 0 THEN 'default' WHEN 1 THEN 'open' ELSE 'all' END AS thread_scope, run_id % 2 = 0 AS include_comments, run_id % 5 = 0 AS include_reviews, run_id % 7 < 3 AS include_review_threads"


@query("D19_F18_retry_scopes")
def _(s, d):
    """Failures of all runs whose repository can be told; runs asked for different scopes and families."""
    runs = relation(s, d, "runs").selectExpr("run_id", *[x.strip() for x in ASKED.split(", ") if x])
    jobs = relation(s, d, "jobs").withColumn("repo_id", F.col("target"))
    plan = ledger.retry_scopes(failures(s, d).where("target <> 'not a target' OR repository IS NOT NULL"), jobs, runs)
    return plan.withColumn("failure_ids", F.array_join(F.transform("failure_ids", lambda x: x.cast("string")), ","))


SQL["D19_F18_retry_scopes"] = more(f"""SELECT run_id, repository, scope, bool_or(CASE WHEN family IS NULL THEN include_comments ELSE family = 'comments' END) AS include_comments, bool_or(CASE WHEN family IS NULL THEN include_reviews ELSE family = 'reviews' END) AS include_reviews,
bool_or(CASE WHEN family IS NULL THEN include_review_threads ELSE family = 'review_threads' END) AS include_review_threads, string_agg(failure_id::VARCHAR, ',' ORDER BY failure_id) AS failure_ids FROM (
SELECT fl.*, r.* EXCLUDE (run_id), coalesce(repository, (SELECT any_value(j.target) FROM jobs j WHERE j.run_id = fl.run_id AND j.target = fl.target AND (fl.family IS NULL OR j.family = fl.family) AND (fl.scope_key = '' OR j.scope_key = fl.scope_key)), target) AS found_,
CASE WHEN scope_key IN ('open', 'closed', 'all') THEN scope_key ELSE thread_scope END AS scope FROM fl JOIN (SELECT run_id, {ASKED} FROM runs) r USING (run_id) WHERE NOT resolved AND (target <> 'not a target' OR repository IS NOT NULL))
GROUP BY run_id, found_, scope""".replace("SELECT run_id, repository, scope,", "SELECT run_id, found_ AS repository, scope,"), "runs", "jobs", before=FAILURES)


@query("C10_jobs_of_repositories", "SELECT j.run_id, j.job_no, j.part, r.host, r.repo_id FROM jobs j JOIN (SELECT DISTINCT full_name, host, repo_id FROM threads) r ON r.full_name = j.target", "threads", "jobs")
def _(s, d):
    return ledger.jobs_of_repositories(relation(s, d, "jobs"), repositories(relation(s, d, "threads"))).select("run_id", "job_no", "part", "host", "repo_id")


RUN_LOG = "rl AS (SELECT run_id % 150 AS run_id, run_id AS arrival, CASE WHEN run_id % 2 = 0 OR run_id < 150 THEN 'create' ELSE 'finish' END AS action, CASE WHEN run_id % 2 = 0 OR run_id < 150 THEN NULL ELSE status END AS status, scope_id AS parent FROM runs)"


def run_log(s, d):
    return relation(s, d, "runs").selectExpr("run_id % 150 AS run_id", "run_id AS arrival", "CASE WHEN run_id % 2 = 0 OR run_id < 150 THEN 'create' ELSE 'finish' END AS action", "CASE WHEN run_id % 2 = 0 OR run_id < 150 THEN NULL ELSE status END AS status", "scope_id AS parent")


@query("I14_run_states")
def _(s, d):
    return ledger.run_states(run_log(s, d))


SQL["I14_run_states"] = more("SELECT run_id, min(arrival) FILTER (action = 'create') AS started_at, min(arrival) FILTER (action = 'finish') AS finished_at, coalesce(min_by(status, arrival) FILTER (action = 'finish'), 'in_progress') AS status, min_by(parent, arrival) FILTER (action = 'create') AS parent FROM rl JOIN (SELECT run_id, min(arrival) AS c FROM rl WHERE action = 'create' GROUP BY run_id) USING (run_id) WHERE arrival >= c GROUP BY run_id", "runs", before=RUN_LOG)


@query("I14_refused_finishes")
def _(s, d):
    return ledger.refused(run_log(s, d))


SQL["I14_refused_finishes"] = more("SELECT run_id, arrival FROM rl WHERE action = 'finish' AND (NOT EXISTS (SELECT 1 FROM rl c WHERE c.run_id = rl.run_id AND c.action = 'create' AND c.arrival < rl.arrival) OR EXISTS (SELECT 1 FROM rl f WHERE f.run_id = rl.run_id AND f.action = 'finish' AND f.arrival < rl.arrival AND EXISTS (SELECT 1 FROM rl c WHERE c.run_id = f.run_id AND c.action = 'create' AND c.arrival < f.arrival)))", "runs", before=RUN_LOG)


@query("E10_first_failures", "SELECT run_id, min_by(kind, a) FILTER (kind <> 'rate_limited') AS hard, min_by(kind, a) FILTER (kind = 'rate_limited') AS deferred FROM (SELECT run_id, job_no * 1000000 + part AS a, CASE part % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'permission' ELSE 'not_found' END AS kind FROM jobs WHERE status = 'failed') GROUP BY run_id", "jobs")
def _(s, d):
    f = relation(s, d, "jobs").where("status = 'failed'").selectExpr("run_id", "job_no * 1000000 + part AS arrival", "CASE part % 3 WHEN 0 THEN 'rate_limited' WHEN 1 THEN 'permission' ELSE 'not_found' END AS kind")
    return ledger.first_failures(f)


@query("H36_exit_codes", "SELECT run_id, CASE status WHEN 'complete' THEN 0 WHEN 'partial' THEN 3 WHEN 'in_progress' THEN NULL END AS code FROM runs", "runs")
def _(s, d):
    return relation(s, d, "runs").select("run_id", ledger.exit_code(F.col("status")).alias("code"))


@query("D21_version_range", "SELECT min(sequence) AS lo, max(sequence) AS hi, count(*) = max(sequence) - min(sequence) + 1 AS contiguous FROM observations", "observations")
def _(s, d):
    return relation(s, d, "observations").agg(F.min("sequence").alias("lo"), F.max("sequence").alias("hi"), (F.count("*") == F.max("sequence") - F.min("sequence") + 1).alias("contiguous"))


# Orders

@query("E9_dense_index", "SELECT thread_id, row_number() OVER (ORDER BY host, repo_id, number, thread_id) - 1 AS index FROM threads", "threads")
def _(s, d):
    return ordering.dense_index(relation(s, d, "threads").select("host", "repo_id", "number", "thread_id"), ["host", "repo_id", "number", "thread_id"]).select("thread_id", "index")


@query("I3_reserved_sequences", "SELECT run_id, job_no, part, row_number() OVER (ORDER BY run_id, job_no, part, items) + 500 AS sequence FROM jobs", "jobs")
def _(s, d):
    j = relation(s, d, "jobs").select("run_id", "job_no", "part", "items")
    return ordering.reserve_sequences(j, ["run_id", "job_no", "part", "items"], 500).drop("items")


@query("B5_F7_keyset_page", "SELECT thread_id, kind FROM (SELECT * FROM threads WHERE thread_id > 30 ORDER BY thread_id LIMIT 50) WHERE kind = 'issue'", "threads")
def _(s, d):
    return ordering.keyset_page(relation(s, d, "threads"), "thread_id", 30, 50, F.col("kind") == "issue")[0].select("thread_id", "kind")


@query("H23_hosts", r"SELECT page_id, CASE WHEN regexp_matches(url, '^https?://[^/]+') THEN lower(regexp_replace(regexp_extract(url, '^https?://([^/]+)', 1), '\.?(:443)?$', '')) END AS host FROM pages")
def _(s, d):
    pages = s.read.parquet(f"{d}/pages.parquet")
    return pages.select("page_id", identity.host(F.nullif(F.regexp_extract("url", "^https?://([^/]+)", 1), F.lit(""))).alias("host"))

