"""The engine's commands over one corpus: thin methods over the operators.

Every search takes a batch of queries (query_id, query) or one query text, and
returns a DataFrame. ``root`` is a folder for the engine's own tables; a purge
removes only tables that the engine made, told by its marker.
"""

from __future__ import annotations

import copy
import time
import tomllib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import storage
from .functions.ship import ship
from .operators import evidence, governance, graph, index, lexical, lifecycle, stats, syntax, vectors
from .plans import context
from .sources import corpus

VERSION = "1"
LINE_LIMIT = 100
VIEW_KINDS = ("chunk_summary", "symbol_tags", "query_aliases")
POLICY = {
    "index": {"include": [], "exclude": []},
    "remote": {"allow": False, "allow_embedding": False, "allowed_providers": [], "max_data_level": 0},
    "secrets": {"block_on_match": True},
    "retention": {"local_index_ttl_days": 90},
}
PROVIDERS = {
    "mock": {"provider_id": "mock", "model_id": "hash", "dimensions": 32, "locality": "local", "max_data_level": 1},
    "disabled": {"provider_id": "disabled", "model_id": "none", "dimensions": 0, "locality": "disabled", "max_data_level": 0},
}


def load_policy(text: str | None) -> dict:
    """A policy from TOML text over the defaults; missing or bad text: the defaults."""
    policy = copy.deepcopy(POLICY)
    try:
        given = tomllib.loads(text or "")
    except tomllib.TOMLDecodeError:
        return policy
    for part, values in given.items():
        if isinstance(values, dict):
            policy.setdefault(part, {}).update(values)
    return policy


class Engine:
    def __init__(self, spark: SparkSession, files: DataFrame, root: str | None = None, policy: dict | None = None):
        ship(spark)
        self.spark, self.files, self.policy = spark, files, policy or copy.deepcopy(POLICY)
        self._root = root.rstrip("/") if root else None

    @classmethod
    def over_folder(cls, spark: SparkSession, folder: str, root: str | None = None) -> "Engine":
        """The admitted files of a folder, under its ``.spanloom/policy.toml``."""
        policy = load_policy(storage.read_text(spark, f"{folder}/.spanloom/policy.toml"))
        files = corpus.scan_folder(spark, folder, policy["index"]["include"], policy["index"]["exclude"], bool(policy["index"].get("include_gitignored")))
        return cls(spark, files, root or f"{folder}/.spanloom/index", policy)

    @property
    def root(self) -> str:
        if not self._root:
            raise ValueError("this command needs a folder for the engine's tables")
        return self._root

    def _queries(self, query: str | DataFrame) -> DataFrame:
        if isinstance(query, DataFrame):
            return query
        return self.spark.createDataFrame([(1, query)], "query_id long, query string")

    # ------------------------------------------------------------------ reading
    def read(self, spec: str) -> DataFrame:
        return corpus.read_span(self.files, spec)

    def scan(self) -> DataFrame:
        return self.files.select("path", "language", "content_sha", "size").orderBy("path")

    def search(self, kind: str, query: str | DataFrame, k: int = 20, persistent: bool = False) -> DataFrame:
        """``regex`` and ``text`` (one pattern, the first LINE_LIMIT lines),
        ``bm25`` (also from the built index, verified), ``symbol`` (syntax
        first, patterns where it finds none)."""
        if kind in ("regex", "text"):
            if kind == "regex" and not context.is_valid_pattern(query):
                raise ValueError(f"not a pattern: {query!r}")
            match = lexical.regex_lines if kind == "regex" else lexical.text_lines
            return match(corpus.lines_of(self.files), query, LINE_LIMIT)
        if kind == "bm25":
            asked = self._queries(query)
            if persistent:
                return index.open_bm25(self.spark, f"{self.root}/bm25", cached=False).search_verified(asked, self.files, k)[0]
            chunks = corpus.line_chunks(self.files)
            # Hits without a line of the query are dropped, so twice as many are asked for.
            tight = lexical.best_lines(lexical.bm25(chunks, asked, 2 * k), chunks, asked).withColumnRenamed("rank", "was")
            return lexical.ranked(tight, ["was"], ["query_id"], k).drop("was")
        if kind == "symbol":
            named = syntax.symbols(self.files).where(F.contains(F.lower("name"), F.lit(query.lower())))
            found = named.select("path", F.col("start_line").alias("line_no"), "kind", "name")
            if found.limit(1).count():
                return found.orderBy("path", "line_no").limit(k)
            plain = lexical.symbol_lines(corpus.lines_of(self.files), query)
            return plain.select("path", "line_no", "kind", F.lit(query).alias("name")).orderBy("path", "line_no").limit(k)
        raise ValueError(f"unknown search: {kind}")

    def retrieve(self, query: str | DataFrame, channels: tuple[str, ...] = ("regex", "bm25", "symbol"), k: int = 20) -> DataFrame:
        return context.retrieve(self.files, self._queries(query), channels, k)

    def fast_context(self, query: str | DataFrame, k: int = 10, budget: int = 2000) -> DataFrame:
        return context.fast_context(self.files, self._queries(query), graph.build_graph(self.files), k, budget)

    def validate_citations(self, raw: DataFrame, column: str = "value") -> DataFrame:
        """Each citation of JSON texts with its reason."""
        return evidence.checked(corpus.citations(raw, column), self.files, check_excerpt=True)

    # -------------------------------------------------------------------- graph
    def graph_build(self) -> DataFrame:
        edges = graph.build_graph(self.files)
        edges.write.mode("overwrite").parquet(f"{self._own()}/graph")
        return graph.edges_by_kind(self.spark.read.parquet(f"{self.root}/graph"))

    def graph_inspect(self, kind: str | None = None, limit: int = 100) -> DataFrame:
        edges = self.spark.read.parquet(f"{self.root}/graph")
        return (edges.where(F.col("kind") == kind) if kind else edges).orderBy("source_path", "target_path", "kind", "source_line").limit(limit)

    def impact(self, path: str, depth: int = 1) -> DataFrame:
        target = self.spark.createDataFrame([(path,)], "path string")
        return graph.valid_edges(graph.impact(graph.build_graph(self.files), target, depth), self.files)

    def tests(self, path: str | None = None) -> DataFrame:
        return graph.tests_touching(graph.build_graph(self.files), path)

    # -------------------------------------------------------------------- index
    def _own(self) -> str:
        """Marks the folder as the engine's before it writes there."""
        self.spark.range(1).select(F.lit(VERSION).alias("version")).write.mode("overwrite").parquet(f"{self.root}/_spanloom")
        return self.root

    def _purge(self, *tables: str) -> int:
        if not storage.exists(self.spark, f"{self.root}/_spanloom"):
            return 0
        return sum(storage.remove(self.spark, f"{self.root}/{t}") for t in tables)

    def index_build(self) -> DataFrame:
        root = self._own()
        lifecycle.write_index(self.files, f"{root}/chunks")
        index.build_index(self.files, f"{root}/bm25")
        return self.index_status()

    def _manifest(self) -> DataFrame:
        return lifecycle.open_index(self.spark, f"{self.root}/chunks")[1]

    def index_status(self) -> DataFrame:
        return lifecycle.status(self._manifest(), self.files)

    def index_dirty(self) -> DataFrame:
        return lifecycle.dirty_diff(self._manifest(), self.files)

    def index_validate(self) -> DataFrame:
        return lifecycle.validate(self._manifest(), self.files)

    def index_update(self) -> DataFrame:
        """The diff that was applied; postings of changed files come as a segment."""
        diff = lifecycle.update_index(self.spark, f"{self.root}/chunks", self.files)
        index.update_index(self.spark, f"{self.root}/bm25", self.files)
        return diff

    def index_update_path(self, path: str) -> DataFrame:
        """The diff of one path, applied to the postings only."""
        return index.update_index(self.spark, f"{self.root}/bm25", self.files, path)

    def index_compact(self) -> list[int]:
        """The index's segments after small ones were merged."""
        return index.compact(self.spark, f"{self.root}/bm25")

    def index_purge(self) -> int:
        return self._purge("chunks", "bm25")

    def context_lite(self) -> DataFrame:
        """One row: the dirty summary as JSON."""
        return self.index_status().select(F.to_json(F.struct("*")).alias("summary"))

    def bench_warm(self, query: str | DataFrame, repeats: int = 5) -> DataFrame:
        """n, p_floor, p_index, p_linear of the seconds of repeated searches of one opened index."""
        handle, asked, spent = index.open_bm25(self.spark, f"{self.root}/bm25"), self._queries(query), []
        for _ in range(repeats):
            start = time.perf_counter()
            handle.search(asked).write.format("noop").mode("overwrite").save()
            spent.append(("bm25", time.perf_counter() - start))
        handle.postings.unpersist()
        return stats.percentiles(self.spark.createDataFrame(spent, "what string, seconds double"), "seconds", ["what"], 95)

    # -------------------------------------------------------------------- store
    def store_status(self, backend: str = "chunks") -> DataFrame:
        state = {"chunks": "ephemeral", "embedded": "unavailable"}.get(backend, "unknown_backend")
        return self.spark.createDataFrame([(backend, state)], "backend string, state string")

    def store_build(self, name: str = "spanloom_chunks") -> DataFrame:
        corpus.line_chunks(self.files).createOrReplaceTempView(name)
        return self.spark.table(name).agg(F.count("*").alias("n_chunks"), F.countDistinct("path").alias("n_files"))

    def store_purge(self, name: str = "spanloom_chunks") -> bool:
        return self.spark.catalog.dropTempView(name)

    # ------------------------------------------------------------ derived views
    def _views(self, kind: str) -> DataFrame:
        chunks = corpus.line_chunks(self.files)
        if kind != "chunk_summary":
            return governance.derived_views(chunks, kind, {"symbol_tags": 50, "query_aliases": 30}[kind])
        from .functions import text as T

        got = governance.chunk_summaries(chunks)
        vid = T.view_id("path", F.col("start_line"), F.col("end_line"), "content_sha", F.lit(kind), F.lit("static"), F.lit("1"))
        return got.select(vid.alias("view_id"), "path", "start_line", "end_line", "content_sha", F.lit(kind).alias("kind"), F.array("derived_text").alias("tags"))

    def derived_build(self, kinds: tuple[str, ...] = VIEW_KINDS, data_level: int = 1, experimental: bool = False) -> DataFrame:
        """Generates views, checks them, keeps the valid ones; one row: upserted, replaced, invalid."""
        if not experimental or data_level > 1:
            raise ValueError("derived views are experimental and hold data of level 1 at most")
        made = self._views(kinds[0])
        for kind in kinds[1:]:
            made = made.unionByName(self._views(kind))
        fresh = f"{self._own()}/_views"
        governance.validate_views(made, self.files, list(VIEW_KINDS)).write.mode("overwrite").parquet(fresh)
        checked = self.spark.read.parquet(fresh)
        good = checked.where("verdict = 'valid'").drop("verdict")
        known = storage.exists(self.spark, f"{self.root}/views")
        store = self.spark.read.parquet(f"{self.root}/views") if known else good.where("false")
        after, counts = governance.upsert(store, good)
        after.write.mode("overwrite").parquet(f"{self.root}/_views_next")
        found = counts.first()
        invalid = checked.where("verdict <> 'valid'").count()
        self.spark.read.parquet(f"{self.root}/_views_next").write.mode("overwrite").parquet(f"{self.root}/views")
        self._purge("_views", "_views_next")
        return self.spark.createDataFrame([(found["upserted"], found["replaced"], invalid)], "upserted long, replaced long, invalid long")

    def derived_validate(self) -> DataFrame:
        views = self.spark.read.parquet(f"{self.root}/views")
        return governance.validate_views(views, self.files, list(VIEW_KINDS)).groupBy("verdict").count()

    def derived_inspect(self, kind: str | None = None, limit: int = 20) -> DataFrame:
        views = self.spark.read.parquet(f"{self.root}/views")
        return (views.where(F.col("kind") == kind) if kind else views).orderBy("path", "start_line", "kind").limit(limit)

    def derived_purge(self) -> int:
        return self._purge("views")

    # ------------------------------------------------------ vectors and providers
    def dense_build(self, provider: str = "mock", experimental: bool = False) -> DataFrame:
        """Vectors of the chunks' metadata that pass the gate; every decision is
        appended to the audit log. Counts by reason."""
        if not experimental:
            raise ValueError("vectors are experimental")
        at = PROVIDERS[provider]
        chunks = corpus.line_chunks(self.files).select(
            F.xxhash64("path", "start_line", "end_line").alias("vec_id"), "path", "start_line", "end_line", "content_sha",
            F.concat_ws(" ", "path", "language", F.concat_ws("-", "start_line", "end_line")).alias("text"), F.lit(1).alias("data_level"),
        )
        gated = governance.gate(chunks, self._gate_rules(), at)
        root = self._own()
        self._audit(gated, "vec_id", "embed", provider, "path")
        allowed = gated.where("allowed").select("vec_id", "path", "start_line", "end_line", "content_sha", "text")
        made = vectors.mock_embedding(allowed, "vec_id", at["dimensions"])
        space = [F.lit(at[c]).alias(c) for c in vectors.SPACE]
        allowed.join(made, "vec_id").drop("text").select("*", *space).write.mode("overwrite").parquet(f"{root}/vectors")
        return gated.groupBy("reason").count()

    def _gate_rules(self) -> dict:
        rules = {"block_on_match": self.policy["secrets"]["block_on_match"], "allow_remote": self.policy["remote"]["allow"]}
        return rules | {k: self.policy["remote"][k] for k in ("allow_embedding", "allowed_providers", "max_data_level")}

    def _audit(self, gated: DataFrame, key: str, event: str, provider: str, *more: str) -> None:
        """A log entry for each gated row: ``event`` if it is allowed, else ``block``."""
        told = F.when(F.col("allowed"), event).otherwise("block").alias("event")
        log = gated.select(F.current_timestamp().alias("ts"), F.col(key).alias("event_id"), told, F.lit(provider).alias("provider_id"), *more, "secret_scan", "reason")
        log.write.mode("append").json(f"{self._own()}/audit")

    def dense_search(self, query: str | DataFrame, k: int = 10, provider: str = "mock") -> DataFrame:
        """Nearest chunks among the vectors of the provider's model and length,
        verified; the query is given back as hash and length only. Queries pass
        the gate first and are logged (``query_embed`` or ``block``); blocked
        ones have no hits. Without vectors of that space nothing is embedded,
        logged or found."""
        at = PROVIDERS[provider]
        asked = self._queries(query)
        store = vectors.of_space(self.spark.read.parquet(f"{self.root}/vectors"), at)
        gated = governance.gate(asked.select("*", F.coalesce("query", F.lit("")).alias("text"), F.lit(0).alias("data_level")), self._gate_rules(), at)
        if not store.isEmpty():
            self._audit(gated, "query_id", "query_embed", provider)
        q = vectors.mock_embedding(gated.where("allowed"), "query_id", at["dimensions"])
        hits = vectors.cosine_topk(store, q, k).join(store.drop("embedding", *vectors.SPACE), "vec_id")
        told = asked.select("query_id", F.sha2(F.col("query").cast("binary"), 256).alias("query_sha"), F.octet_length("query").alias("query_bytes"))
        return evidence.materialize(hits, self.files).join(told, "query_id").withColumn("channel", F.lit("dense"))

    def dense_purge(self) -> int:
        return self._purge("vectors")

    def provider_status(self) -> DataFrame:
        return self.spark.createDataFrame([(p["provider_id"], p["locality"], p["max_data_level"]) for p in PROVIDERS.values()], "provider_id string, locality string, max_data_level int")

    def provider_audit(self, n: int = 20) -> DataFrame:
        return governance.audit_tail(self.spark.read.json(f"{self.root}/audit"), n)

    @staticmethod
    def version() -> str:
        return VERSION
