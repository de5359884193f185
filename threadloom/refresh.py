"""Refresh: what changed goes on from stage to stage, and nothing else does.

Three stages over one store, each of which works off what the tables say is out of date, so a run that failed or stopped goes on
where it was, and a run without changes publishes nothing:

- sync merges threads that differ from those stored and are no older;
- embeddings renders threads whose document is of another source time, and embeds documents whose vectors are of another content;
- clusters builds the clusters of repositories whose open threads, documents or titles differ from those that their clusters were built from.

A stage that fails is recorded and the others still run; the outcome is that of ledger.refresh_outcomes.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.operators import clustering, documents, ledger
from threadloom.operators.clustering import _kept
from threadloom.operators.embedding_service import Service, embedded
from threadloom.sources.store import Migration, Store, Table, Write

THREAD = "thread_id bigint, host string, repo_id string, number bigint, full_name string, kind string, state string, title string, body string, label string, updated_at_us bigint"


def schema(buckets: int = 64) -> list[Migration]:
    """The tables of a refreshed archive; buckets should grow with it, as a task rewrites one."""
    return [
        Migration("refresh", {
            "threads": Table(THREAD, ("thread_id",), buckets),
            "documents": Table("thread_id bigint, content_hash string, embedded_hash string, text string, source_updated_at_us bigint", ("thread_id",), buckets),
            "vectors": Table("thread_id bigint, chunk_index int, chunk_count int, chunk_hash string, vector array<double>", ("thread_id", "chunk_index"), buckets, dealt=("thread_id",)),
            "built": Table("full_name string, input string", ("full_name",), min(buckets, 8)),
            "members": Table("thread_id bigint, full_name string, cluster bigint, representative bigint, score double", ("thread_id",), buckets),
        }),
    ]


#: A task's error as Spark reports it, where the task could not reach the service: the line that names the exception.
UNREACHABLE = re.compile(r"^ {0,2}(?:\w+\.)*(?:Connection\w*|Timeout)Error\b", re.MULTILINE)
STAGES = ("sync", "embeddings", "clusters")
#: The folder in the archive that holds what a stage needs only while it runs.
STAGED = "_staged"


@dataclass
class Stage:
    status: str
    touched: int = 0
    failure: str | None = None


@dataclass
class Report:
    """Stages that ran, what each touched, and the outcome as ledger.refresh_outcomes says it."""

    stages: dict[str, Stage] = field(default_factory=dict)
    outcome: str = "complete"
    remaining: tuple[str, ...] = ()


class Refresh:
    def __init__(self, store: Store, embed: Service | Callable[[list[str]], list] | None, max_bytes: int = 2000, threshold: float = 0.8, cross_kind: float = 0.9, fanout: int = 16, most: int = 40):
        self.store, self.embed, self.max_bytes = store, embed, max_bytes
        self.cluster = (threshold, cross_kind, fanout, most)

    @classmethod
    def create(cls, spark: SparkSession, path: str, embed, buckets: int = 64, **options) -> Refresh:
        return cls(Store.create(spark, path, schema(buckets)), embed, **options)

    def run(self, incoming: DataFrame | None = None, stages: tuple[str, ...] = STAGES) -> Report:
        """Runs the stages chosen; incoming are threads as they were just read, needed for sync alone."""
        if not stages or any(s not in STAGES for s in stages) or ("sync" in stages and incoming is None):
            raise ValueError("a refresh needs stages, and threads to sync")
        work = {"sync": lambda: self.sync(incoming), "embeddings": self.embeddings, "clusters": self.clusters}
        report = Report()
        for name in (s for s in STAGES if s in stages):
            try:
                try:
                    report.stages[name] = Stage("complete", work[name]())
                finally:
                    self.store.files.remove(f"{self.store.path}/{STAGED}")
            except (ConnectionError, TimeoutError) as e:
                report.stages[name] = Stage("deferred", failure=str(e))
            except KeyboardInterrupt as e:
                report.stages[name] = Stage("interrupted", failure=str(e))
                break
            except Exception as e:  # a failed stage doesn't keep the others from their work
                report.stages[name] = Stage("deferred" if UNREACHABLE.search(str(e)) else "failed", failure=str(e)[:500])
        rows = [(0, n, i, s.status) for i, (n, s) in enumerate(report.stages.items())]
        made = ledger.refresh_outcomes(self.store.spark.createDataFrame(rows, "refresh_id int, stage string, position int, status string")).first()
        report.outcome, report.remaining = made["outcome"], tuple(x for x in made["remaining"].split(",") if x)
        return report

    def _staged(self, rows: DataFrame) -> DataFrame:
        """rows as they are now, in compressed files that go when the stage ends."""
        path = f"{self.store.path}/{STAGED}/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(path)
        return self.store.spark.read.schema(rows.schema).parquet(path)

    def sync(self, incoming: DataFrame) -> int:
        """Threads that are new, or differ and are no older than those stored."""
        held = self.store.read("threads")
        digest = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in held.columns])
        older = held.select("thread_id", digest.alias("_was"), F.col("updated_at_us").alias("_at"))
        new = incoming.select(*held.columns, digest.alias("_is")).join(older, "thread_id", "left")
        changed = self._staged(new.where("_was IS NULL OR (_was <> _is AND (_at IS NULL OR updated_at_us >= _at))").select(*held.columns))
        n = changed.count()
        if n:
            self.store.merge("threads", changed)
        return n

    def embeddings(self) -> int:
        """Documents that were rendered anew, and the vectors of those whose text is another.

        Both are written at once, so a text is written once; where embedding fails, what was rendered is kept without vectors.
        """
        threads, held = self.store.read("threads"), self.store.read("documents")
        now = held.select("thread_id", "embedded_hash", F.col("source_updated_at_us").alias("_at"))
        stale = threads.join(now, "thread_id", "left").where(F.coalesce(F.col("_at") != F.col("updated_at_us"), F.lit(True)))
        made = documents.render(stale, keep=("embedded_hash", "updated_at_us")).withColumnRenamed("updated_at_us", "source_updated_at_us")
        made = self._staged(made.select(*held.columns))
        n = made.count()
        outdated = "embedded_hash IS NULL OR embedded_hash <> content_hash"
        left = held.where(outdated).join(made.select("thread_id"), "thread_id", "left_anti").select(*held.columns)
        wanted = made.where(outdated).unionByName(left)
        m = wanted.count()
        if not m:
            if n:
                self.store.merge("documents", made)
            return n
        try:
            if self.embed is None:
                raise RuntimeError("no embedding service")
            vectors = self._staged(embedded(documents.chunks_of(wanted, self.max_bytes), self.embed))
        except Exception:
            if n:
                self.store.merge("documents", made)
            raise
        write = Write(self.store)
        # All chunks of a document are replaced together; a document without text has none.
        ids = wanted.select("thread_id")
        marks = ids.select("thread_id", F.lit(-1).alias("chunk_index"), F.lit(None).cast("int").alias("chunk_count"), F.lit(None).cast("string").alias("chunk_hash"), F.lit(None).cast("array<double>").alias("vector"))
        write.merge("vectors", vectors.unionByName(marks), lambda old, new: old.join(new.select("thread_id").distinct(), "thread_id", "left_anti").select(*old.columns).unionByName(new.where("chunk_index >= 0").select(*old.columns)))
        write.merge("documents", made.unionByName(left).withColumn("embedded_hash", F.col("content_hash")))
        write.commit()
        return n + m

    def clusters(self) -> int:
        """The repositories whose clusters were built anew."""
        held = self.store.read("documents").where("embedded_hash IS NOT NULL").select("thread_id", "embedded_hash")
        open_ = self.store.read("threads").where("state = 'open'").join(held, "thread_id")
        # What a repository's clusters are made of; the order of its threads doesn't matter.
        parts = F.xxhash64("thread_id", "kind", F.coalesce("title", F.lit("")), F.coalesce("body", F.lit("")), "embedded_hash")
        input_ = F.concat_ws(":", F.count("*").cast("string"), F.hex(F.bit_xor(parts)), F.hex(F.bit_xor(F.xxhash64(F.lit(1), parts))))
        now = open_.groupBy("full_name").agg(input_.alias("input"))
        before = self.store.read("built").select("full_name", F.col("input").alias("_was"))
        both = now.join(before, "full_name", "full").withColumn("input", F.coalesce("input", F.lit("none")))
        changed = _kept(both.where(~F.col("input").eqNullSafe(F.col("_was"))).select("full_name", "input"))
        n = changed.count()
        if not n:
            return 0
        threshold, cross_kind, fanout, most = self.cluster
        mine = open_.join(changed.select("full_name"), "full_name", "left_semi")
        near = clustering.neighbours(mine, self.store.read("vectors").join(mine.select("thread_id"), "thread_id", "left_semi"), threshold, cross_kind, fanout, clustering.reference_edges(mine))
        parts = clustering.bounded_components(mine, clustering.candidate_edges(near), most)
        found = clustering.with_representatives(parts.join(mine.select("thread_id", "number"), "thread_id")).join(mine.select("thread_id", "full_name"), "thread_id")
        columns = self.store.read("members").columns
        found = _kept(found.select(*columns))
        old = self.store.read("members").join(changed.select("full_name"), "full_name", "left_semi").select("thread_id").join(found.select("thread_id"), "thread_id", "left_anti")
        gone = old.select("thread_id", *[F.lit(None).cast(dict(found.dtypes)[c]).alias(c) for c in columns if c != "thread_id"])
        write = Write(self.store)
        write.merge("members", found.unionByName(gone), lambda was, new: was.join(new.select("thread_id"), "thread_id", "left_anti").select(*columns).unionByName(new.where("cluster IS NOT NULL").select(*columns)))
        write.merge("built", changed)
        write.commit()
        return n


def sync_repositories(refresh: Refresh, landed: DataFrame, host: str, full_names: DataFrame) -> Report:
    """The sync stage alone, from landed issue records (landing.records) and (repo_id, full_name) of their repositories."""
    from threadloom.sources import landing

    rows = landing.threads(landed.drop("thread_id"), host).drop("full_name").join(full_names, "repo_id")
    newest = rows.groupBy("thread_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "thread_id"]), F.struct("updated_at_us", F.xxhash64("title", "body", "state"))).alias("r")).select("thread_id", "r.*")
    return refresh.run(newest, ("sync",))
