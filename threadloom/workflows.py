"""The public requests over an archive; each is a thin composition of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.operators import clustering, decisions, documents, embedding_service, embeddings, ledger, listing, search
from threadloom.operators.search_index import SearchIndex


class NotFound(LookupError):
    """A named repository, thread or run is not in the archive."""


class NoVectors(RuntimeError):
    """No document has a complete set of vectors of the query's size."""


@dataclass(frozen=True)
class Filters:
    repositories: tuple[str, ...] = ()
    kind: str | None = None
    state: str = "all"
    updated_since_us: int | None = None
    sort: str = "updated"
    limit: int = 20
    offset: int = 0


@dataclass
class Archive:
    """Relations of an archive. Only those that a request needs must be there."""

    threads: DataFrame
    coverage: DataFrame | None = None
    comments: DataFrame | None = None
    chunks: DataFrame | None = None
    runs: DataFrame | None = None
    jobs: DataFrame | None = None
    embed: embedding_service.Service | Callable[[list[str]], list] | None = None
    #: A search index of all threads as they are; who changes threads applies the change to it too.
    index: SearchIndex | None = None
    extra: dict[str, DataFrame] = field(default_factory=dict)

    def resolve(self, names: tuple[str, ...]) -> list[tuple[str, str]]:
        """(host, repository id) of each name in the order given, once each; an unknown name is an error."""
        out = []
        for name in names:
            found = listing.find_repository(self.threads, name).limit(2).collect()
            if not found:
                raise NotFound(name)
            pair = (found[0]["host"], found[0]["repo_id"])
            if pair not in out:
                out.append(pair)
        return out

    def _selected(self, f: Filters) -> DataFrame:
        return listing.filtered(self.threads, self.resolve(f.repositories), f.kind, f.state, f.updated_since_us)

    def list_threads(self, f: Filters = Filters()) -> DataFrame:
        return listing.page_with_coverage(self._selected(f), self.coverage, f.sort, f.limit, f.offset)

    def _families(self) -> dict[str, DataFrame]:
        found = {"comments": self.comments, **{n: self.extra.get(n) for n in ("reviews", "review_threads", "pull_request_metadata")}}
        return {n: rows for n, rows in found.items() if rows is not None}

    def show_thread(self, number: int, repository: str) -> DataFrame:
        """A thread of a repository with its coverage, all its child families and its timeline."""
        host, repo_id = self.resolve((repository,))[0]
        found = listing.thread_detail(self.threads, self.coverage, self._families(), host, repo_id, number)
        if found.isEmpty():
            raise NotFound(f"{repository}#{number}")
        return found

    def thread_timeline(self, number: int, repository: str) -> DataFrame:
        """The events of a thread; see listing.timeline."""
        host, repo_id = self.resolve((repository,))[0]
        one = self.threads.where((F.col("host") == host) & (F.col("repo_id") == repo_id) & (F.col("number") == number))
        families = self._families()
        return listing.timeline(one, families["comments"], families.get("reviews"), families.get("review_threads"))

    def archive_status(self) -> tuple[DataFrame, DataFrame]:
        """Counts by kind, and coverage totals by family."""
        return listing.counts_by_kind(self.threads), listing.coverage_totals(self.threads, self.coverage)

    def list_repositories(self) -> DataFrame:
        from threadloom.sources.archive import repositories

        return listing.ordered_repositories(repositories(self.threads)).orderBy("position").drop("position")

    def search_threads(self, query: str, f: Filters = Filters(sort="relevance"), mode: str = "keyword", advanced: bool = False, vector: list[float] | None = None, fallback: bool = False) -> DataFrame:
        """A page of keyword, semantic or hybrid results.

        Blank queries give an empty page. With fallback, missing vectors or a failing embedding service leave the
        keyword results; a query that can't be read is an error in every mode.
        """
        listing.check_page(f.limit, f.offset)
        tree = search.parse_expression(query) if advanced else search.plain_expression(query)
        rows = self._selected(f)
        found = self._matching(tree, f).join(rows.select("thread_id"), "thread_id", "left_semi")
        if mode == "keyword" or tree is None:
            return listing.page(found, listing.sort_order(f.sort, matched=True), f.limit, f.offset)
        k = search.window_size(f.limit, f.offset)
        try:
            whole = search.complete_documents(self.chunks)
            chunks = self.chunks.join(whole, "thread_id", "left_semi")
            size = len(vector) if vector is not None else getattr(self.embed, "dimensions", None)
            # Before the service is asked: are there vectors at all, and of the size that it is known to give?
            if chunks.where(F.size("vector") == size if size else F.lit(True)).isEmpty():
                raise NoVectors("no document has vectors of this size")
            query_vector = vector if vector is not None else self._embedded(query)
            if size is None and chunks.where(F.size("vector") == len(query_vector)).isEmpty():
                raise NoVectors("no document has vectors of this size")
        except (NoVectors, ConnectionError, TimeoutError):
            if not fallback:
                raise
            return listing.page(found, listing.sort_order(f.sort, matched=True), f.limit, f.offset)
        semantic = search.semantic_search(rows, chunks, query_vector, f.sort, k)
        if mode == "semantic":
            return listing.page(semantic, search.semantic_order(f.sort), f.limit, f.offset)
        both = search.fused(search.ranked(found, f.sort, k, "keyword_rank"), semantic, f.sort).limit(k)
        return listing.page(both, search.semantic_order(f.sort), f.limit, f.offset)

    def _matching(self, tree, f: Filters) -> DataFrame:
        """Threads that match, with bm25, from the index if the archive has one, else by reading all texts."""
        scope = listing.in_scope(self.resolve(f.repositories))
        if self.index is None or tree is None:
            return search.keyword_search(self.threads, tree, scope)
        return self.threads.where(scope).join(self.index.find(tree), "thread_id")

    def _embedded(self, query: str) -> list[float]:
        if self.embed is None:
            raise NoVectors("no embedding service")
        service = self.embed if isinstance(self.embed, embedding_service.Service) else embedding_service.Service(self.embed)
        return service.vectors([query])[0]

    def thread_documents(self, recipe: str = "discussion_enriched") -> DataFrame:
        """Documents of all threads: original_body, or discussion_enriched with the child families that are complete and not stale.

        Enriched ones need extra["states"] (coverage with clock_us, item_count and head_sha), and threads with expected_comments; extra["heads"]
        are (thread_id, head_sha) of pull requests. Reviews and review threads come from extra where they are there.
        """
        if recipe == "original_body":
            return documents.render(self.threads)
        if recipe != "discussion_enriched":
            raise ValueError(f"no recipe {recipe!r}")
        context = listing.coverage_context(self.threads, self.extra["states"], self.extra["heads"])
        current = context.where("status = 'complete' AND NOT stale").select("thread_id", "family")
        families, spark = self._families(), self.threads.sparkSession
        none = lambda schema: spark.createDataFrame([], schema)
        reviews = families.get("reviews")
        talk = families.get("review_threads")
        if reviews is None:
            reviews = none("thread_id bigint, provider_id string, reviewer string, state string, is_bot boolean, body string, submitted_at_us bigint")
        if talk is None:
            talk = none("thread_id bigint, provider_id string, path string, line bigint, is_resolved boolean, is_outdated boolean, comments array<struct<provider_id string, author string, is_bot boolean, body string, created_at_us bigint>>")
        return documents.render_enriched(self.threads, documents.child_sections(families["comments"], reviews, talk), current)

    def embed_documents(self, rendered: DataFrame, max_bytes: int, stored: DataFrame | None = None) -> DataFrame:
        """thread_id, chunk_index, chunk_count, chunk_hash, vector of the chunks that stored doesn't hold already.

        The service is called from the tasks, in requests within its budgets; see embedding_service.
        """
        wanted = documents.chunks_of(rendered, max_bytes)
        if stored is not None:
            wanted = documents.pending_chunks(wanted, stored)
        return embedding_service.embedded(wanted, self.embed).withColumn("vector", F.col("vector").cast("array<float>"))

    def build_clusters(self, threshold: float = 0.82, cross_kind: float = 0.93, fanout: int = 16, most: int = 40) -> DataFrame:
        """Members with cluster, representative and score of the open threads that have vectors."""
        if not (0 < threshold <= 1 and 0 < cross_kind <= 1 and 1 <= fanout <= 256 and 1 <= most <= 10_000):
            raise ValueError("a cluster option is out of range")
        rows = self.threads.where("state = 'open'").join(search.complete_documents(self.chunks), "thread_id", "left_semi")
        near = clustering.neighbours(rows, self.chunks, threshold, cross_kind, fanout, clustering.reference_edges(rows))
        return clustering.with_representatives(clustering.bounded_components(rows, clustering.candidate_edges(near), most))

    def list_clusters(self, limit: int = 20, offset: int = 0, retired: bool = False) -> DataFrame:
        """A page of clusters, most active members first; needs extra["clusters"] and extra["members"]."""
        return decisions.list_clusters(self.extra["clusters"], self.extra["members"], limit, offset, retired)

    def show_cluster(self, cluster: int) -> DataFrame:
        """Active and excluded members of one cluster in order."""
        if self.extra["clusters"].where(F.col("cluster") == cluster).isEmpty():
            raise NotFound(f"cluster {cluster}")
        return decisions.cluster_members(self.extra["members"], self.threads, cluster).orderBy("position")

    def decide(self, made: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Judged decisions, and the clusters, members and audit events after those that take effect.

        made is (seq, cluster, action, host, repo_id, number, reason, at_us); actions are dismiss, restore, exclude,
        include and canonical. Nothing is written; the caller stores the next tables.
        """
        clusters, members = self.extra["clusters"], self.extra["members"]
        found = decisions.judged(made, clusters, members, self.threads)
        events = decisions.events_of(found)
        return found, decisions.clusters_after(clusters, events), decisions.members_after(members, events), events

    def materialize_documents(self, stored: DataFrame, built_at_us: int, recipe: str = "discussion_enriched") -> DataFrame:
        """The stored documents after those of all threads are rendered anew; unchanged ones keep id and build time."""
        made = self.thread_documents(recipe).join(self.threads.select("thread_id", F.col("updated_at_us").alias("source_updated_at_us")), "thread_id")
        made = made.select("thread_id", F.lit(recipe).alias("recipe"), F.lit(1).alias("recipe_version"), "content_hash", "title", "source_updated_at_us")
        return embeddings.upsert_documents(stored, made, built_at_us)

    def list_runs(self, limit: int = 20) -> DataFrame:
        listing.check_page(limit, 0)
        return ledger.latest_runs(self.runs, limit)

    def show_run(self, run_id: int) -> DataFrame:
        found = ledger.job_rows(self.runs.where(F.col("run_id") == run_id), self.jobs)
        if self.runs.where(F.col("run_id") == run_id).isEmpty():
            raise NotFound(f"run {run_id}")
        return found

    def plan_run_retry(self, run_id: int, families: list[str] | None = None) -> DataFrame:
        """Scopes to run again, by repository and scope; a run without unresolved failures is an error.

        extra holds failures, and runs what each was asked for; see ledger.retry_scopes.
        """
        one = F.col("run_id") == run_id
        plan = ledger.retry_scopes(self.extra["failures"].where(one), self.jobs.where(one), self.runs.where(one), families).orderBy("repository", "scope")
        if plan.isEmpty():
            raise NotFound(f"run {run_id} has no work to retry")
        return plan

    def run_retry(self, run_id: int, retry_run: int, work: Callable[[list[dict]], list[str]], families: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """Runs the plan again: the failures after it, and the summary of what it came to.

        work is given the scopes (at most a few for each repository that failed) and returns an outcome for each. Failures in the plan's
        scopes count as retried by retry_run; those of scopes that completed are resolved.
        """
        plan = self.plan_run_retry(run_id, families)
        scopes = [r.asDict() for r in plan.collect()]
        outcomes = work(scopes)
        if len(outcomes) != len(scopes):
            raise ValueError("an outcome for each scope")
        failures, spark = self.extra["failures"], self.runs.sparkSession
        ids = spark.createDataFrame([(i, o) for s, o in zip(scopes, outcomes) for i in s["failure_ids"]], "failure_id bigint, outcome string")
        tried = failures.join(ids, "failure_id")
        after = ledger.mark_retried(failures, tried, retry_run)
        after = ledger.resolve(after, tried.where("outcome = 'complete'"), retry_run)
        made = spark.createDataFrame([(retry_run, o) for o in outcomes], "run_id bigint, outcome string")
        return after, ledger.retry_summaries(made, "run_id")

    def recent_failures(self) -> DataFrame:
        return ledger.recent_failures(self.runs)

    def doctor(self) -> DataFrame:
        """Health checks, the last row for the whole archive; an index must hold the threads that there are, and no others."""
        checks = listing.constraint_violations(self.threads, self.comments)
        if self.index is not None:
            ids, held = self.threads.select("thread_id"), self.index.live()[1].select("thread_id")
            apart = ids.join(held, "thread_id", "left_anti").unionByName(held.join(ids, "thread_id", "left_anti"))
            checks = checks.unionByName(apart.agg(F.count("*").alias("violations")).select(F.lit("index_apart_from_threads").alias("check_name"), "violations"))
        return listing.health(checks)
