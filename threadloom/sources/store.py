"""A stored archive: bucketed tables under a version manifest, changed by merges that rewrite only the buckets they touch.

A table is Parquet files, each of one bucket of the table's key. A version is one JSON manifest that names the files of every bucket of every table,
the migrations that made the schema, and the last batch of each stream that was merged. A write stages new files for the buckets that its
changes touch, all other files keep their names; its rules are checked, and one new manifest then publishes all its tables at once. A write
that breaks a rule, or that fails, publishes nothing, and readers of the old version are not disturbed.

CHECK conditions are counted while the files are written (observe), over the rows of touched buckets; keys and references are then
counted over the columns that they name, all in one query. One application writes at a time; publishing over a version that another
writer has published in between fails.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

Rule = Callable[[DataFrame, DataFrame], DataFrame]


class StoreError(RuntimeError):
    """An archive that isn't there, isn't of this history, or was changed by another writer."""


class Violation(StoreError):
    """A write that breaks rules: their names and how many rows break each."""

    def __init__(self, found: dict[str, int]):
        super().__init__(", ".join(f"{n} ({k})" for n, k in sorted(found.items())))
        self.found = found


@dataclass(frozen=True)
class Table:
    """keys tell rows apart; dealt, some of the keys (all by default), tell their bucket."""

    schema: str
    keys: tuple[str, ...]
    buckets: int = 64
    dealt: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    """Rows of table for which an SQL condition is false; null passes."""

    table: str
    name: str
    condition: str


@dataclass(frozen=True)
class Unique:
    table: str
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """Rows of table whose columns (none of them null) name no row of parent."""

    table: str
    name: str
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Migration:
    """A step of the schema: tables that it creates and rules that hold from then on."""

    name: str
    tables: dict[str, Table] = field(default_factory=dict)
    rules: tuple = ()

    @property
    def digest(self) -> str:
        said = [self.name, sorted((n, t.schema, t.keys, t.buckets, t.dealt) for n, t in self.tables.items()), [repr(r) for r in self.rules]]
        return hashlib.sha256(json.dumps(said).encode()).hexdigest()


class Files:
    """Small files through Hadoop's file system, wherever the archive lies."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark.sparkContext._jvm
        root = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self.jvm.org.apache.hadoop.fs.Path(path)

    def names(self, pattern: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.globStatus(self.at(pattern)) or [])

    def read(self, path: str) -> str:
        stream = self.fs.open(self.at(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def publish(self, path: str, text: str) -> None:
        """Writes a whole file that must not be there yet."""
        part = self.at(f"{path}.{uuid.uuid4().hex}.part")
        out = self.fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self.fs.exists(self.at(path)) or not self.fs.rename(part, self.at(path)):
            self.fs.delete(part, False)
            raise StoreError(f"{path} is there already: another writer was faster")

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def upsert(current: DataFrame, changes: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The changed rows over those of equal keys."""
    return current.join(changes.select(*keys), list(keys), "left_anti").select(*current.columns).unionByName(changes.select(*current.columns))


class Store:
    """One archive folder. Reads see the version that was newest when the store was opened or last published."""

    def __init__(self, spark: SparkSession, path: str, migrations: list[Migration]):
        self.spark, self.path, self.migrations = spark, path, migrations
        self.files = Files(spark, path)
        versions = self.versions()
        if not versions:
            raise StoreError(f"no archive at {path}")
        self.manifest = self._manifest(versions[-1])
        history = self.manifest["migrations"]
        if [m["digest"] for m in history] != [m.digest for m in migrations[: len(history)]]:
            raise StoreError("the archive's history is not the one this program knows")

    @classmethod
    def create(cls, spark: SparkSession, path: str, migrations: list[Migration]) -> Store:
        files = Files(spark, path)
        if files.names(f"{path}/_versions/*.json"):
            raise StoreError(f"an archive is at {path} already")
        files.publish(f"{path}/_versions/{0:012d}.json", json.dumps({"version": 0, "migrations": [], "tables": {}, "streams": {}}))
        store = cls(spark, path, migrations)
        store.migrate()
        return store

    def versions(self) -> list[int]:
        return [int(n[:12]) for n in self.files.names(f"{self.path}/_versions/*.json")]

    def history(self) -> DataFrame:
        """version, n_migrations, n_files of every version that is kept."""
        rows = [(m["version"], len(m["migrations"]), sum(len(f) for t in m["tables"].values() for f in t.values())) for m in map(self._manifest, self.versions())]
        return self.spark.createDataFrame(rows, "version bigint, n_migrations int, n_files int")

    def _manifest(self, version: int) -> dict:
        return json.loads(self.files.read(f"{self.path}/_versions/{version:012d}.json"))

    @property
    def tables(self) -> dict[str, Table]:
        return {n: t for m in self.migrations[: len(self.manifest["migrations"])] for n, t in m.tables.items()}

    @property
    def rules(self) -> list:
        return [r for m in self.migrations[: len(self.manifest["migrations"])] for r in m.rules]

    def migrate(self) -> None:
        """Publishes one version for each migration that the archive hasn't had; tables begin empty, and rules must hold."""
        for m in self.migrations[len(self.manifest["migrations"]) :]:
            before = self.manifest
            after = before | {"migrations": [*before["migrations"], {"name": m.name, "digest": m.digest}], "tables": before["tables"] | {n: {} for n in m.tables}}
            self.manifest = after
            write = Write(self)
            try:
                write.validate({r.table for r in m.rules}, m.rules, whole=True)
                write.publish()
            except Exception:
                self.manifest = before
                raise

    def read(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        files = (self.manifest if version is None else self._manifest(version))["tables"][name]
        chosen = [f"{self.path}/{f}" for b, fs in files.items() if buckets is None or int(b) in buckets for f in fs]
        return load(self.spark, chosen, self.tables[name].schema)

    def merge(self, name: str, changes: DataFrame, rule: Rule | None = None) -> None:
        """One table in one write."""
        write = Write(self)
        write.merge(name, changes, rule)
        write.commit()

    def vacuum(self, keep: int = 2) -> int:
        """Removes all but the newest versions, and the files that none of those names; how many files went."""
        versions = self.versions()
        old, kept = [self._manifest(v) for v in versions[:-keep]], [self._manifest(v) for v in versions[-keep:]]
        names = lambda ms: {f for m in ms for t in m["tables"].values() for fs in t.values() for f in fs}
        gone = names(old) - names(kept)
        for m in old:
            self.files.remove(f"{self.path}/_versions/{m['version']:012d}.json")
        for f in gone:
            self.files.remove(f"{self.path}/{f}")
        return len(gone)


def load(spark: SparkSession, files: list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)


class Write:
    """Merges into several tables that become visible together, or not at all."""

    def __init__(self, store: Store):
        self.store, self.manifest = store, store.manifest
        self.staged: dict[str, dict[str, list[str]]] = {n: dict(f) for n, f in store.manifest["tables"].items()}
        self.touched: dict[str, set[str]] = {}
        self.found: dict[str, int] = {}
        self.streams: dict[str, int] = dict(store.manifest["streams"])

    def read(self, name: str, buckets: set[str] | None = None) -> DataFrame:
        """A table as this write leaves it."""
        chosen = [f"{self.store.path}/{f}" for b, fs in self.staged[name].items() if buckets is None or b in buckets for f in fs]
        return load(self.store.spark, chosen, self.store.tables[name].schema)

    def merge(self, name: str, changes: DataFrame, rule: Rule | None = None) -> None:
        """The buckets that changes' keys fall into, after rule(current rows of those buckets, changes); by default changes replace
        rows of equal keys. The rule may drop and add rows of those buckets, but no others."""
        table = self.store.tables[name]
        bucket = F.pmod(F.xxhash64(*(table.dealt or table.keys)), F.lit(table.buckets)).cast("int")
        mine = {str(r["b"]) for r in changes.select(bucket.alias("b")).distinct().collect()}  # at most table.buckets numbers
        if not mine:
            return
        current = self.read(name, mine)
        columns = current.columns
        after = (rule or (lambda old, new: upsert(old, new, table.keys)))(current, changes).select(*columns)
        checks = [r for r in self.store.rules if isinstance(r, Check) and r.table == name]
        seen = Observation()
        counted = after.observe(seen, F.count("*").alias("rows"), *[F.count_if(~F.expr(c.condition)).alias(f"c{i}") for i, c in enumerate(checks)])
        # A row whose key lies in a bucket that isn't rewritten would stand beside its older self.
        stray = F.when(F.col("_bucket").isin(*map(int, mine)), F.col("_bucket")).otherwise(F.raise_error(F.lit(f"a rule of {name} made rows of other buckets")).cast("int"))
        folder = f"{name}/{uuid.uuid4().hex}"
        dealt = counted.withColumn("_bucket", bucket).withColumn("_bucket", stray).repartition(min(len(mine), 4096), "_bucket")
        dealt.sortWithinPartitions("_bucket", *table.keys).write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.store.path}/{folder}")
        for i, c in enumerate(checks):
            if seen.get[f"c{i}"]:
                self.found[c.name] = self.found.get(c.name, 0) + seen.get[f"c{i}"]
        for b in mine:
            self.staged[name][b] = []
        if seen.get["rows"]:
            written = self.store.spark.read.parquet(f"{self.store.path}/{folder}")
            for r in written.select("_bucket", F.col("_metadata.file_path").alias("f")).distinct().collect():  # a row for each new file
                self.staged[name][str(r["_bucket"])].append(folder + r["f"].split(folder, 1)[1])
        self.touched.setdefault(name, set()).update(mine)

    def validate(self, names: set[str], rules, whole: bool = False) -> None:
        """Counts what breaks the keys and references of the named tables, and the checks too where whole."""
        counts = []
        for r in rules:
            if isinstance(r, Check) and whole:
                counts.append(self.read(r.table).where(~F.expr(r.condition)).agg(F.count("*").alias("n")).select(F.lit(r.name).alias("rule"), "n"))
            elif isinstance(r, Unique) and r.table in names:
                many = self.read(r.table).where(" AND ".join(f"{c} IS NOT NULL" for c in r.columns)).groupBy(*r.columns).agg(F.count("*").alias("_many")).where("_many > 1")
                counts.append(many.agg(F.count("*").alias("n")).select(F.lit(r.name).alias("rule"), "n"))
            elif isinstance(r, Reference) and {r.table, r.parent} & names:
                known = self.read(r.parent).select(*[F.col(p).alias(c) for p, c in zip(r.parent_columns, r.columns)])
                lost = self.read(r.table).where(" AND ".join(f"{c} IS NOT NULL" for c in r.columns)).select(*r.columns).join(known, list(r.columns), "left_anti")
                counts.append(lost.agg(F.count("*").alias("n")).select(F.lit(r.name).alias("rule"), "n"))
        for name in sorted(names & set(self.touched)):
            table = self.store.tables[name]
            many = self.read(name, self.touched[name]).groupBy(*table.keys).agg(F.count("*").alias("_many")).where("_many > 1")
            counts.append(many.agg(F.count("*").alias("n")).select(F.lit(f"{name}_key").alias("rule"), "n"))
        if counts:
            every = counts[0]
            for c in counts[1:]:
                every = every.unionByName(c)
            self.found |= {r["rule"]: self.found.get(r["rule"], 0) + r["n"] for r in every.where("n > 0").collect()}  # a row for each rule
        if self.found:
            raise Violation(self.found)

    def commit(self) -> int:
        """Publishes what was merged, or raises Violation and removes what was staged. A write that merged nothing publishes nothing."""
        if not self.touched and self.streams == self.store.manifest["streams"]:
            return self.manifest["version"]
        try:
            self.validate(set(self.touched), self.store.rules)
            return self.publish()
        except Exception:
            self.discard()
            raise

    def publish(self) -> int:
        version = self.manifest["version"] + 1
        after = self.store.manifest | {"version": version, "tables": self.staged, "streams": self.streams}
        self.store.files.publish(f"{self.store.path}/_versions/{version:012d}.json", json.dumps(after))
        self.store.manifest = after
        return version

    def discard(self) -> None:
        old = {f for t in self.manifest["tables"].values() for fs in t.values() for f in fs}
        for folder in {"/".join(f.split("/")[:2]) for t in self.staged.values() for fs in t.values() for f in fs if f not in old}:
            self.store.files.remove(f"{self.store.path}/{folder}")


def merging(store: Store, name: str, stream: str, rule: Rule | None = None):
    """A foreachBatch function that merges each batch once: a batch that is run again after it was published changes nothing."""

    def add(batch: DataFrame, batch_id: int) -> None:
        if store.manifest["streams"].get(stream, -1) >= batch_id:
            return
        write = Write(store)
        write.merge(name, batch, rule)
        write.streams[stream] = batch_id
        write.commit()

    return add
