"""Landed provider pages as a Spark data source: batch and stream readers, and a writer.

A landing folder holds pages (each one's address, the address of the next page and the body as the provider sent it) in files of one JSON
line for each page, and manifests, JSON lines that name the pages with their files and places there; a page without a place is a file of its own. A manifest is written once, after its pages, so a page without one is not
there yet. Readers plan from manifests alone: pages form chains by their next addresses, one chain for each page that is marked as the
first of a walk; a chain is read up to the first page that hasn't landed, and pages behind the gap wait for it. Partitions are runs of consecutive pages, so a repository of any size is read by many tasks;
short chains share a partition, so tasks grow with the bytes of pages and not with the number of threads.

What is wanted is said by options (repo_id, kind, state, since_us) and applied when partitions are planned. Filters of a query are not
taken over: Spark 4.1.2 keeps what a plan has pushed into a Python source for later plans of the same DataFrame. Pages outside them are never opened: a manifest knows the states
and the newest update of each page. The stream's offset is the number of pages read of each chain, so each page is read once, across restarts.

Defined cases: a page that landed twice counts once, as it landed first; a chain that comes back to a page is an error; so are bodies that aren't JSON, and GraphQL pages with an entry in `errors`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "repo_id string, kind string, thread_id bigint, url string, page_index int, item_index int, state string, updated_at_us bigint, record string"
#: What the writer takes; rows of one page must lie together, in order.
LAND_SCHEMA = "repo_id string, kind string, thread_id bigint, url string, next string, first boolean, state string, updated_at_us bigint, record string"
#: Where the items of a page's body are, for bodies that are neither a list nor one record.
NESTED = {"review_threads": ("data", "repository", "pullRequest", "reviewThreads", "nodes"), "review_thread_comments": ("data", "node", "comments", "nodes")}


class PageError(ValueError):
    """A landed page, or a chain of pages, that no reader may accept."""


def files_of(path: str):
    """The file system of a folder, and its path there."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return (LocalFileSystem(), path) if path.startswith("/") else FileSystem.from_uri(path)


@dataclass(frozen=True)
class Scope:
    """What a reader is asked for; None means everything."""

    repositories: tuple[str, ...] | None = None
    kinds: tuple[str, ...] | None = None
    state: str | None = None
    since_us: int | None = None

    def holds(self, page: dict) -> bool:
        """Whether the collection of a page is asked for."""
        return (self.repositories is None or page["repo_id"] in self.repositories) and (self.kinds is None or page["kind"] in self.kinds)

    def wants(self, page: dict) -> bool:
        return (
            self.holds(page)
            and (self.state is None or self.state in page["states"])
            and (self.since_us is None or (page["newest_us"] is not None and page["newest_us"] >= self.since_us))
        )

    def keeps(self, state: str | None, updated_at_us: int | None) -> bool:
        return (self.state is None or state == self.state) and (self.since_us is None or (updated_at_us is not None and updated_at_us >= self.since_us))


def scope_of(options: dict) -> Scope:
    """From the options repo_id and kind (comma-separated), state (open, closed or all) and since_us."""
    names = lambda key: tuple(x.strip() for x in options[key].split(",")) if options.get(key) else None
    state = options.get("state")
    if state not in (None, "all", "open", "closed"):
        raise PageError(f"state {state!r} is none of all, open, closed")
    return Scope(names("repo_id"), names("kind"), None if state in (None, "all") else state, int(options["since_us"]) if options.get("since_us") else None)


def manifest(path: str, scope: Scope = Scope()) -> list[dict]:
    """The pages of all manifests in the order in which they landed, each address of a collection once; collections outside the scope are left out."""
    from pyarrow.fs import FileSelector, FileType

    fs, base = files_of(path)
    names = sorted(f.path for f in fs.get_file_info(FileSelector(f"{base}/_manifests", allow_not_found=True)) if f.type == FileType.File and f.path.endswith(".jsonl"))
    seen, out = set(), []
    for name in names:
        with fs.open_input_stream(name) as stream:
            for line in stream.read().decode().splitlines():
                page = json.loads(line)
                if not scope.holds(page):
                    continue
                key = (page["repo_id"], page["kind"], page["thread_id"], page["url"])
                if key not in seen:
                    seen.add(key)
                    out.append(page)
    return out


def chains(pages: list[dict]) -> dict[str, list[dict]]:
    """The pages of each chain in order, under a name made of its collection and first address."""
    collections: dict[tuple, dict[str, dict]] = {}
    for page in pages:
        collections.setdefault((page["repo_id"], page["kind"], page["thread_id"]), {})[page["url"]] = page
    out = {}
    for (repo, kind, thread), by_url in collections.items():
        reached = set()
        for head in (u for u, p in by_url.items() if p["first"]):
            chain, url = [], head
            while url in by_url:
                if url in reached:
                    raise PageError(f"pages of {repo} {kind} come back to {url}")
                reached.add(url)
                chain.append(by_url[url])
                url = by_url[url]["next"]
            out[json.dumps([repo, kind, thread, head])] = chain
    return out


#: What a page of unknown size counts as in a partition, and how many small pages count as one at most.
PAGE_BYTES, SMALL_PAGES = 1 << 18, 64


@dataclass
class PageRun:
    """Consecutive pages of one chain: (index, address, file, offset, bytes) of each; without an offset a page is its whole file."""

    repo_id: str
    kind: str
    thread_id: int | None
    pages: list[tuple[int, str, str, int | None, int | None]]


@dataclass
class PageRuns(InputPartition):
    """What one task reads: a run of a long chain, or those of several short ones."""

    runs: list[PageRun]


def partitions_of(found: Iterable[list[tuple[int, dict]]], size: int) -> list[PageRuns]:
    """The wanted (index, page) of each chain, dealt in order into partitions of `size` pages, or of more small ones."""
    out, room = [], 0.0
    for chain in found:
        run = None
        for i, p in chain:
            weight = 1.0 if p.get("bytes") is None else max(p["bytes"] / PAGE_BYTES, 1 / SMALL_PAGES)
            if not out or room < weight:
                out.append(PageRuns([]))
                run, room = None, max(float(size), weight)
            if run is None:
                run = PageRun(p["repo_id"], p["kind"], p["thread_id"], [])
                out[-1].runs.append(run)
            run.pages.append((i, p["url"], p["file"], p.get("at"), p.get("bytes")))
            room -= weight
    return out


def items_of(kind: str, body) -> list[dict]:
    """The records of a page's body."""
    if isinstance(body, list):
        return body
    if not isinstance(body, dict):
        raise PageError("a page body is neither a list nor a record")
    if kind not in NESTED:
        return [body]
    if body.get("errors"):
        raise PageError("a GraphQL page has errors")
    for name in NESTED[kind]:
        body = body.get(name) if isinstance(body, dict) else None
    if not isinstance(body, list):
        raise PageError("a GraphQL page has no nodes")
    return body


def micros(text: str | None) -> int | None:
    from datetime import datetime, timedelta, timezone

    if not text:
        return None
    try:
        at = datetime.fromisoformat(text)
    except ValueError:
        return None
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1) if at.tzinfo else None


def read_runs(path: str, part: PageRuns, scope: Scope):
    """The records of a partition's pages; pages of one file that follow each other are read through one opening of it."""
    fs, base = files_of(path)
    name = held = None
    try:
        for run in part.runs:
            for index, url, file, at, size in run.pages:
                if file != name:
                    if held:
                        held.close()
                    name, held = file, fs.open_input_file(f"{base}/{file}")
                try:
                    page = json.loads(held.read() if at is None else held.read_at(size, at))
                except ValueError as e:
                    raise PageError(f"{file} is not JSON") from e
                if at is None:
                    name = None
                for i, item in enumerate(items_of(run.kind, page["body"])):
                    state, when = item.get("state"), micros(item.get("updated_at") or item.get("updatedAt"))
                    if scope.keeps(state, when):
                        yield run.repo_id, run.kind, run.thread_id, url, index, i, state, when, json.dumps(item, ensure_ascii=False, separators=(",", ":"))
    finally:
        if held:
            held.close()


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.scope, self.size = options["path"], scope_of(options), int(options.get("pages_per_partition", 16))

    def partitions(self):
        return partitions_of(([(i, p) for i, p in enumerate(chain) if self.scope.wants(p)] for chain in chains(manifest(self.path, self.scope)).values()), self.size)

    def read(self, partition):
        yield from read_runs(self.path, partition, self.scope) if partition else ()


class PageStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.scope, self.size = options["path"], scope_of(options), int(options.get("pages_per_partition", 16))

    def initialOffset(self):  # noqa: N802
        return {}

    def latestOffset(self):  # noqa: N802
        return {name: len(chain) for name, chain in chains(manifest(self.path)).items()}

    def partitions(self, start, end):
        found = chains(manifest(self.path))
        return partitions_of(([(i, found[name][i]) for i in range(start.get(name, 0), n) if self.scope.wants(found[name][i])] for name, n in end.items()), self.size)

    def read(self, partition):
        yield from read_runs(self.path, partition, self.scope)

    def commit(self, end):
        pass


@dataclass
class Landed(WriterCommitMessage):
    pages: list[dict]


class PageWriter(DataSourceWriter):
    """Consecutive rows of one address become one page; the pages of a task that follow each other in a repository and kind lie in one
    file. A page is seen once the commit has written the manifest."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows):
        fs, base = files_of(self.path)
        done, held, key, name, out = [], [], None, None, None

        def flush():
            nonlocal name, out
            repo, kind, thread, url, following, first = key
            if out is None or not name.startswith(f"{repo}/{kind}/"):
                if out is not None:
                    out.close()
                name = f"{repo}/{kind}/{uuid.uuid4().hex}.json"
                fs.create_dir(f"{base}/{repo}/{kind}", recursive=True)
                out = fs.open_output_stream(f"{base}/{name}")
            body = [json.loads(r["record"]) for r in held]
            for step in reversed(NESTED.get(kind, ())):
                body = {step: body}
            raw, at = json.dumps({"url": url, "next": following, "body": body}, ensure_ascii=False).encode(), out.tell()
            out.write(raw + b"\n")
            times = [r["updated_at_us"] for r in held if r["updated_at_us"] is not None]
            done.append({"repo_id": repo, "kind": kind, "thread_id": thread, "url": url, "next": following, "first": first, "file": name, "at": at, "bytes": len(raw), "items": len(held), "states": sorted({r["state"] for r in held if r["state"]}), "newest_us": max(times, default=None)})

        try:
            for row in rows:
                own = (row["repo_id"], row["kind"], row["thread_id"], row["url"], row["next"], bool(row["first"]))
                if own != key:
                    if held:
                        flush()
                    held, key = [], own
                held.append(row)
            if held:
                flush()
        finally:
            if out is not None:
                out.close()
        return Landed(done)

    def commit(self, messages):
        pages = [p for m in messages if m for p in m.pages]
        if pages:
            write_manifest(self.path, pages)

    def abort(self, messages):
        fs, base = files_of(self.path)
        for name in {p["file"] for m in messages if m for p in m.pages}:
            fs.delete_file(f"{base}/{name}")


def write_manifest(path: str, pages: list[dict]) -> None:
    """One more manifest; names sort in the order of writing."""
    import time

    fs, base = files_of(path)
    fs.create_dir(f"{base}/_manifests", recursive=True)
    name = f"{base}/_manifests/{time.time_ns():020d}-{uuid.uuid4().hex[:8]}.jsonl"
    with fs.open_output_stream(name + ".part") as out:
        out.write("".join(json.dumps(p) + "\n" for p in pages).encode())
    fs.move(name + ".part", name)


class LandedPages(DataSource):
    @classmethod
    def name(cls):
        return "landed_pages"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return PageReader(self.options)

    def streamReader(self, schema: StructType):  # noqa: N802
        return PageStreamReader(self.options)

    def writer(self, schema: StructType, overwrite: bool):
        return PageWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LandedPages)


def read_pages(spark: SparkSession, path: str, kind: str, state: str = "all", since_us: int | None = None, repo_id: str | None = None) -> DataFrame:
    """The records of one kind of page, with state and since applied where pages are chosen."""
    register(spark)
    reader = spark.read.format("landed_pages").option("path", path).option("kind", kind).option("state", state)
    reader = reader if since_us is None else reader.option("since_us", since_us)
    reader = reader if repo_id is None else reader.option("repo_id", repo_id)
    return reader.load()


def stream_pages(spark: SparkSession, path: str, kind: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("landed_pages").option("path", path).option("kind", kind).load()


def land(rows: DataFrame, path: str, order: list, per_page: int = 100, address: str = "https://api.git.example/repos") -> None:
    """Write rows (repo_id, kind, thread_id, state, updated_at_us, record) as pages of per_page records in the order given.

    Pages of a collection (repository, kind, thread) are numbered from 1 and linked by their next addresses. Numbers come from ranges of the
    order, so a large collection is neither sorted nor written by one task.
    """
    from threadloom.operators.ordering import dense_index

    register(rows.sparkSession)
    of = ["repo_id", "kind", "thread_id"]
    rows = dense_index(rows, [*map(F.col, of), *order], "_n")
    span = rows.groupBy(*of).agg(F.min("_n").alias("_first"), F.count("*").alias("_count"))
    same = [rows[c].eqNullSafe(span[c]) for c in of]
    rows = rows.join(span, same[0] & same[1] & same[2]).drop(*[span[c] for c in of])
    page = F.floor((F.col("_n") - F.col("_first")) / per_page) + 1
    last = F.ceil(F.col("_count") / per_page)
    base = F.concat_ws("/", F.lit(address), "repo_id", F.col("thread_id").cast("string"), "kind")
    at = lambda n: F.concat(base, F.lit("?page="), n.cast("string"))
    out = rows.select("repo_id", "kind", "thread_id", at(page).alias("url"), F.when(page < last, at(page + 1)).alias("next"), (page == 1).alias("first"), "state", "updated_at_us", "record", "_n")
    out = out.repartition("repo_id", "kind", "thread_id", "url").sortWithinPartitions("_n").drop("_n")
    out.write.format("landed_pages").option("path", path).mode("append").save()
