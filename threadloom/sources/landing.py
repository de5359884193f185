"""Landing files: provider pages as JSON lines, read with explicit schemas and normalized to archive relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The fields of provider records that relations are made from.
USER = "user struct<login string, type string, id bigint>"
ISSUE = (
    f"id bigint, number bigint, state string, title string, body string, {USER}, comments bigint, created_at string, updated_at string, "
    "closed_at string, html_url string, labels array<struct<name string>>, assignees array<struct<login string>>, pull_request struct<url string>"
)
COMMENT = f"id bigint, body string, created_at string, updated_at string, {USER}"
REVIEW = f"id bigint, state string, body string, submitted_at string, commit_id string, {USER}"
BRANCH = "struct<ref string, sha string, repo struct<id bigint>>"
PULL = f"id bigint, number bigint, draft boolean, merged boolean, base {BRANCH}, head {BRANCH}"
REPOSITORY = "id bigint, node_id string, name string, full_name string, private boolean, html_url string, default_branch string, updated_at string, owner struct<login string>"
TALK = "struct<id string, body string, createdAt string, updatedAt string, author struct<login string, `__typename` string>, pullRequestReview struct<id string>>"
REVIEW_THREAD = (
    "id string, isResolved boolean, isOutdated boolean, path string, line bigint, startLine bigint, "
    f"comments struct<nodes array<{TALK}>, pageInfo struct<hasNextPage boolean, endCursor string>>"
)
SCHEMAS = {"issues": ISSUE, "comments": COMMENT, "reviews": REVIEW, "pulls": PULL, "repositories": REPOSITORY, "review_threads": REVIEW_THREAD, "review_thread_comments": TALK[7:-1]}
# Review states that have a meaning of their own; others are kept as they are.
REVIEW_STATES = ("APPROVED", "CHANGES_REQUESTED", "COMMENTED", "DISMISSED", "PENDING")


def records(pages: DataFrame, kind: str) -> DataFrame:
    """The records of landed pages as columns, beside repo_id, thread_id and url; a record that doesn't fit fails the read.

    `thread_id` is the page's thread, so records of their own id keep it apart as `id`.
    """
    parsed = F.from_json("record", SCHEMAS[kind], {"mode": "FAILFAST"})
    return pages.where(F.col("kind") == kind).select("repo_id", "thread_id", "url", "record", parsed.alias("_r")).select("repo_id", "thread_id", "url", "record", "_r.*")


def payload_of(record: str = "record") -> Column:
    """The whole record as a VARIANT; nothing that the provider sent is lost."""
    return F.parse_json(record)


def field(payload: Column | str, path: str, kind: str) -> Column:
    """One field of a payload, null where it is missing or of another type."""
    return F.try_variant_get(payload, path, kind)


def refused(bad: Column, what: str, value: Column) -> Column:
    """value, or an error where bad holds."""
    return F.when(bad, F.raise_error(F.lit(what)).cast("string")).otherwise(value.cast("string"))


def instant(c: Column, required: bool = False) -> Column:
    """Microseconds of a provider's time; a text that is none is an error, as is a missing one that is required."""
    from threadloom.functions.identity import micros

    bad = (c.isNotNull() & micros(c).isNull()) | (c.isNull() if required else F.lit(False))
    return refused(bad, "not a time of the provider", micros(c)).cast("bigint")


def sha(c: Column) -> Column:
    """A commit id: 40 or 64 hexadecimal digits, lower case."""
    return refused(~F.coalesce(c.rlike("^([0-9a-fA-F]{40}|[0-9a-fA-F]{64})$"), F.lit(False)), "not a commit id", F.lower(c))


def is_bot(user: Column) -> Column:
    return F.coalesce(F.lower(user["type"]) == "bot", F.lit(False))


def repositories(rows: DataFrame, host: str) -> DataFrame:
    """host, repo_id, owner, name, full_name, default_branch, updated_at_us; a repository without an owner is an error."""
    owner = refused(F.coalesce(F.col("owner.login"), F.lit("")) == "", "a repository without an owner", F.col("owner.login"))
    rows = rows.withColumn("_owner", owner)
    return rows.select(
        F.lit(host).alias("host"), F.col("id").cast("string").alias("repo_id"), F.col("_owner").alias("owner"), "name",
        F.coalesce("full_name", F.concat("_owner", F.lit("/"), "name")).alias("full_name"), "default_branch", instant(F.col("updated_at")).alias("updated_at_us"),
    )


def branch(c: str) -> Column:
    """name, sha and repo_id of a base or head; its repository may be gone."""
    return F.struct(F.col(f"{c}.ref").alias("name"), sha(F.col(f"{c}.sha")).alias("sha"), F.col(f"{c}.repo.id").cast("string").alias("repo_id"))


def pull_requests(rows: DataFrame) -> DataFrame:
    """thread_id (of the page, if it has one), base, head, head_sha, draft, merged of pull requests."""
    of = F.col("thread_id") if "thread_id" in rows.columns else F.lit(None).cast("bigint")
    return rows.select(of.alias("thread_id"), "number", branch("base").alias("base"), branch("head").alias("head"), "draft", "merged").withColumn("head_sha", F.col("head.sha"))


def read(spark: SparkSession, path: str, kind: str, strict: bool = False) -> DataFrame:
    """Records of one kind; strict readers reject a page with a malformed record."""
    return spark.read.schema(SCHEMAS[kind]).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_stream(spark: SparkSession, path: str, kind: str, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(SCHEMAS[kind]).option("maxFilesPerTrigger", files_per_trigger).json(path)


def threads(issues: DataFrame, host: str, repo_id: str | None = None, full_name: str | Column | None = None) -> DataFrame:
    """Issues and pull requests (told by the presence of pull_request) as threads.

    The repository is the one named, or that of the page (repo_id). States other than open and closed are kept.
    """
    of = F.col("repo_id") if repo_id is None else F.lit(repo_id)
    name = full_name if isinstance(full_name, Column) else F.lit(full_name)
    names = F.transform(F.coalesce("labels", F.array().cast("array<struct<name string>>")), lambda x: x["name"])
    people = F.filter(F.transform(F.coalesce("assignees", F.array().cast("array<struct<login string>>")), lambda x: x["login"]), lambda x: x.isNotNull())
    number = refused(F.coalesce(F.col("number"), F.lit(0)) <= 0, "a thread without a number", F.col("number")).cast("bigint")
    return issues.select(
        F.col("id").alias("thread_id"), number.alias("number"), F.lit(host).alias("host"), of.alias("repo_id"), name.alias("full_name"),
        F.when(F.col("pull_request").isNotNull(), "pull_request").otherwise("issue").alias("kind"), "state", "title", "body",
        F.array_join(names, ", ").alias("label"), names.alias("labels"),
        instant(F.col("created_at"), True).alias("created_at_us"), instant(F.col("updated_at"), True).alias("updated_at_us"), instant(F.col("closed_at")).alias("closed_at_us"),
        people.alias("assignees"), F.col("comments").alias("expected_comments"), "html_url",
    )


def _thread(rows: DataFrame) -> Column:
    return (F.col("thread_id") if "thread_id" in rows.columns else F.lit(None).cast("bigint")).alias("thread_id")


def comments(rows: DataFrame) -> DataFrame:
    return rows.select(
        _thread(rows), F.col("id").cast("string").alias("provider_id"), F.col("user.login").alias("author"), is_bot(F.col("user")).alias("is_bot"), "body",
        instant(F.col("created_at"), True).alias("created_at_us"), instant(F.col("updated_at")).alias("updated_at_us"),
    )


def reviews(rows: DataFrame) -> DataFrame:
    commit = F.when(F.coalesce("commit_id", F.lit("")) != "", sha(F.col("commit_id")))
    return rows.select(
        _thread(rows), F.col("id").cast("string").alias("provider_id"), F.col("user.login").alias("reviewer"), F.col("user.id").cast("string").alias("reviewer_id"), is_bot(F.col("user")).alias("is_bot"),
        "state", F.col("state").isin(*REVIEW_STATES).alias("known_state"), "body", instant(F.col("submitted_at")).alias("submitted_at_us"), commit.alias("head_sha"),
    )


def _talk(c: Column) -> Column:
    bot = F.coalesce(F.lower(c["author"]["__typename"]) == "bot", F.lit(False))
    return F.struct(
        c["id"].alias("provider_id"), c["author"]["login"].alias("author"), bot.alias("is_bot"), c["body"].alias("body"), instant(c["createdAt"], True).alias("created_at_us"),
        c["pullRequestReview"]["id"].alias("review_id"),
    )


def review_threads(rows: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """Review threads with all their comments, as the document's sections take them.

    A thread's comments may go on in pages of their own: more (parent: the review thread's id, and the fields of a comment). One that says it
    has more and names no cursor is an error, as is one whose further comments aren't there.
    """
    info = F.col("comments.pageInfo")
    open_ = F.coalesce(info["hasNextPage"], F.lit(False))
    rows = rows.withColumn("_nodes", F.transform(F.coalesce("comments.nodes", F.array().cast(f"array<{TALK}>")), _talk))
    rest = F.lit(None).cast(rows.schema["_nodes"].dataType)
    if more is not None:
        each = more.select("parent", _talk(F.struct("id", "body", "createdAt", "author", "pullRequestReview")).alias("_c"))
        rows = rows.join(each.groupBy(F.col("parent").alias("id")).agg(F.collect_list("_c").alias("_more")), "id", "left")
        rest = F.col("_more")
    broken = open_ & ((F.coalesce(info["endCursor"], F.lit("")) == "") | rest.isNull())
    whole = F.concat("_nodes", F.coalesce(rest, F.array().cast(rows.schema["_nodes"].dataType)))
    line = refused(F.coalesce(F.col("line") < 0, F.lit(False)), "a line below 0", F.col("line")).cast("bigint")
    said = F.when(broken, F.raise_error(F.lit("comments go on without a cursor, or in a page that is not there")).cast("string").isNull()).otherwise(F.lit(True))
    return rows.select(
        _thread(rows), F.col("id").alias("provider_id"), F.col("isResolved").alias("is_resolved"), F.col("isOutdated").alias("is_outdated"), "path", line.alias("line"), F.col("startLine").alias("start_line"),
        F.when(said, whole).alias("comments"),
    )


def envelope(rows: DataFrame, command: str) -> DataFrame:
    """Rows as JSON envelopes: schema_version, command, data, warnings."""
    data = F.struct(*[F.col(c) for c in rows.columns])
    return rows.select(F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(command).alias("command"), data.alias("data"), F.array().cast("array<string>").alias("warnings"))).alias("value"))


def create_archive(frames: dict[str, DataFrame], path: str) -> None:
    """Write relations as an archive folder, one Parquet table each."""
    for name, df in frames.items():
        df.write.mode("errorifexists").parquet(f"{path}/{name}.parquet")


def open_archive(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    """A relation of an archive under an explicit schema."""
    return spark.read.schema(schema).parquet(f"{path}/{name}.parquet")
