"""Archive relations over the driver's tables, each as select expressions that Spark and DuckDB both read.

The same text builds the DataFrame and the SQL of the oracle, so both see one relation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HOST = "git.example"
EPOCH_US = 1_704_067_200_000_000

# relation: (table, expressions)
RELATIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "threads": ("documents", (
        "doc_id + 1 AS thread_id", "doc_id + 1 AS number", f"'{HOST}' AS host", "source AS repo_id", "concat('org/', source) AS full_name",
        "CASE WHEN doc_id % 3 = 0 THEN 'pull_request' ELSE 'issue' END AS kind",
        "CASE WHEN doc_id % 97 = 0 THEN 'locked' WHEN doc_id % 5 = 0 THEN 'closed' ELSE 'open' END AS state",
        "substr(text, 1, 60) AS title", "text AS body", "lang AS label", f"{EPOCH_US} + doc_id * 60000000 AS created_at_us",
        f"{EPOCH_US} + (doc_id * 7919 % 1000) * 3600000000 AS updated_at_us",
    )),
    "chunks": ("embeddings", (
        "cast(floor(vec_id / 2) AS bigint) + 1 AS thread_id", "cast(vec_id % 2 AS int) AS chunk_index", "2 AS chunk_count", "embedding AS vector",
    )),
    "comments": ("conversations", (
        "conv_id + 1 AS thread_id", "cast(turn AS varchar(20)) AS provider_id", "role AS author", "role = 'system' AS is_bot", "text AS body",
        f"{EPOCH_US} + conv_id * 60000000 + turn * 1000000 AS created_at_us",
    )),
    "observations": ("events", (
        "event_id + 1 AS sequence", "user_id AS thread_id",
        "CASE event_type WHEN 'view' THEN 'threads' WHEN 'click' THEN 'comments' WHEN 'signup' THEN 'pull_request_metadata' WHEN 'purchase' THEN 'reviews' ELSE 'review_threads' END AS family",
        "cast(date_trunc('day', ts) AS timestamp) AS source_clock", "value AS payload", "CASE WHEN event_id % 7 = 0 THEN 'incomplete' ELSE 'complete' END AS status",
    )),
    "reviewed": ("labels", (
        "doc_id + 1 AS thread_id", "CASE WHEN quality = 1 THEN 'complete' ELSE 'incomplete' END AS reviews", "CASE WHEN toxic = 0 THEN 'complete' ELSE 'incomplete' END AS comments",
    )),
    "reviews": ("conversations", (
        "conv_id + 1 AS thread_id", "cast(turn AS varchar(20)) AS provider_id", "CASE WHEN turn % 6 = 5 THEN NULL ELSE role END AS reviewer",
        "CASE turn % 4 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'CHANGES_REQUESTED' WHEN 2 THEN 'under discussion' ELSE 'COMMENTED' END AS state", "role = 'system' AS is_bot",
        "CASE WHEN turn % 3 = 2 THEN ' ' ELSE text END AS body", f"CASE WHEN turn % 3 = 1 THEN NULL ELSE {EPOCH_US} + conv_id * 60000000 + (9 - turn) * 2000000 END AS submitted_at_us",
    )),
    "review_threads": ("conversations", (
        "conv_id + 1 AS thread_id", "cast(turn AS varchar(20)) AS provider_id", "CASE WHEN turn % 4 = 0 THEN NULL ELSE concat('src/f', cast(turn % 3 AS varchar(20))) END AS path",
        "CASE WHEN turn % 5 = 0 THEN NULL ELSE turn END AS line", "turn % 2 = 0 AS is_resolved", "turn % 3 = 0 AS is_outdated", "role AS author", "text AS body",
        f"{EPOCH_US} + conv_id * 60000000 + turn * 3000000 AS created_at_us",
    )),
    "stored_documents": ("documents", (
        "doc_id * 10 AS document_id", "doc_id + 1 AS thread_id", "CASE WHEN doc_id % 4 = 3 THEN 'discussion_enriched' ELSE 'original_body' END AS recipe",
        "CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1 END AS recipe_version", "md5(text) AS content_hash", "substr(text, 1, 60) AS title",
        f"{EPOCH_US} + (doc_id * 7919 % 1000) * 3600000000 - CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS source_updated_at_us", f"{EPOCH_US} + doc_id * 1000000 AS built_at_us",
    )),
    "stored_vectors": ("embeddings", (
        "vec_id", "cast(floor(vec_id / 2) AS bigint) * 10 AS document_id", "cast(vec_id % 2 AS int) AS chunk_index", "CASE WHEN cast(floor(vec_id / 2) AS bigint) % 7 = 0 THEN 'other' ELSE 'main' END AS endpoint",
        "CASE WHEN cast(floor(vec_id / 2) AS bigint) % 13 = 0 THEN 'old' ELSE 'new' END AS model",
    )),
    "review_state": ("labels", (
        "doc_id + 1 AS thread_id", "'reviews' AS family", "CASE WHEN quality = 1 THEN 'complete' ELSE 'incomplete' END AS status", f"{EPOCH_US} + (doc_id * 7919 % 1000) * 3600000000 - CASE WHEN doc_id % 4 = 1 THEN 1 ELSE 0 END AS clock_us",
        "cast(NULL AS bigint) AS item_count", "CASE WHEN doc_id % 9 < 5 THEN 'a' WHEN doc_id % 9 < 7 THEN 'b' END AS head_sha", f"{EPOCH_US} + doc_id * 1000000 + CASE WHEN doc_id % 2 = 0 THEN -5 ELSE 5 END AS observed_at_us",
    )),
    "comment_state": ("labels", (
        "doc_id + 1 AS thread_id", "'comments' AS family", "CASE WHEN toxic = 0 THEN 'complete' ELSE 'incomplete' END AS status", f"{EPOCH_US} + (doc_id * 7919 % 1000) * 3600000000 - CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS clock_us",
        "doc_id % 6 AS item_count", "cast(NULL AS varchar(9)) AS head_sha", f"{EPOCH_US} + doc_id * 1000000 + CASE WHEN doc_id % 3 = 0 THEN -7 ELSE 7 END AS observed_at_us",
    )),
    "heads": ("documents", ("doc_id + 1 AS thread_id", "CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'c' END AS head_sha", "doc_id % 3 = 0 AS is_pull_request", "CASE WHEN doc_id % 7 = 0 THEN NULL ELSE doc_id % 6 END AS expected_comments")),
    "decisions": ("events", (
        "event_id AS seq", "user_id % 60 AS cluster", "CASE event_type WHEN 'view' THEN 'dismiss' WHEN 'click' THEN 'restore' WHEN 'signup' THEN 'exclude' WHEN 'purchase' THEN 'include' ELSE 'canonical' END AS action",
        f"'{HOST}' AS host", "CASE WHEN event_id % 10 = 9 THEN 'elsewhere' ELSE 'src' END AS repo_id", "(user_id % 60) * 3 + event_id % 4 + 1 AS number", "concat('  because ', cast(event_id AS varchar(20)), ' ') AS reason", "event_id * 10 AS at_us",
    )),
    "scan_log": ("events", (
        "user_id % 25 AS repo_id", "cast(floor(event_id / 200) AS bigint) AS sequence", "event_id AS arrival", "CASE event_type WHEN 'view' THEN 'begin' WHEN 'error' THEN 'finish' ELSE 'page' END AS action",
        "cast(floor(value) AS bigint) AS threads", "CASE WHEN event_id % 5 < 2 THEN NULL ELSE concat('page', cast(event_id AS varchar(20))) END AS cursor", "CASE WHEN event_type <> 'error' THEN NULL WHEN event_id % 3 = 0 THEN 'incomplete' ELSE 'complete' END AS status",
    )),
    "runs": ("orders", (
        "o_orderkey AS run_id", "CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'in_progress' ELSE 'partial' END AS status",
        "o_orderdate AS started_at", "o_custkey AS scope_id",
    )),
    "jobs": ("lineitem", (
        "l_orderkey AS run_id", "l_linenumber AS job_no", "CASE l_returnflag WHEN 'R' THEN 'failed' WHEN 'A' THEN 'deferred' ELSE 'complete' END AS status",
        "l_partkey AS part", "concat('org/src', cast(l_suppkey % 20 AS varchar(20))) AS target",
        "CASE l_linenumber % 5 WHEN 0 THEN 'threads' WHEN 1 THEN 'comments' WHEN 2 THEN 'pull_request_metadata' WHEN 3 THEN 'reviews' ELSE 'review_threads' END AS family",
        "CASE WHEN l_linestatus = 'O' THEN 'open' ELSE 'closed' END AS scope_key", "l_linestatus = 'F' AS resolved", "cast(l_quantity AS bigint) AS items", "l_shipdate AS at",
    )),
}

#: Evidence families in their order of presentation, and whether they apply to pull requests only.
FAMILIES = (("threads", False), ("comments", False), ("pull_request_metadata", True), ("reviews", True), ("review_threads", True))


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, columns = RELATIONS[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*columns)


def relation_sql(name: str) -> str:
    table, columns = RELATIONS[name]
    return f"SELECT {', '.join(columns)} FROM {table}"


def repositories(threads: DataFrame) -> DataFrame:
    from pyspark.sql import functions as F

    return threads.groupBy("host", "repo_id", "full_name").agg(F.max("updated_at_us").alias("updated_at_us"))


def with_relations(body: str, *names: str) -> str:
    """SQL for DuckDB: the named relations and families as common table expressions before body."""
    parts = [f"{n} AS ({relation_sql(n)})" for n in names]
    parts.append("families(family, pull_request_only, rank) AS (VALUES " + ", ".join(f"('{f}', {str(p).lower()}, {i})" for i, (f, p) in enumerate(FAMILIES)) + ")")
    parts.append("coverage AS (SELECT doc_id + 1 AS thread_id, 'reviews' AS family, CASE WHEN quality = 1 THEN 'complete' ELSE 'incomplete' END AS status FROM labels UNION ALL SELECT doc_id + 1, 'comments', CASE WHEN toxic = 0 THEN 'complete' ELSE 'incomplete' END FROM labels)")
    return "WITH " + ",\n".join(parts) + "\n" + body


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """thread_id, family, status of recorded coverage."""
    both = relation(spark, sf_dir, "reviewed")
    return both.selectExpr("thread_id", "stack(2, 'reviews', reviews, 'comments', comments) AS (family, status)")
