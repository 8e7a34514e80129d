"""Retrieval queries: chunks, search, fusion, evidence, index life, graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.storage import scratch
from ..operators import evidence, fusion, graph, index, lexical, lifecycle, manypatterns, syntax
from ..sources import corpus
from ..sources.corpus import table
from . import context
from .registry import BM25, CHUNKS, FILES, LINES, TOPICS, files, query, topics, words_sql

BEST_LINES = """toks2 AS (SELECT query_id, list_distinct(list_filter(string_split_regex(lower(query), '[\\s:/"()]+'), lambda w: strlen(w) >= 2 AND NOT starts_with(w, '_'))) AS q FROM topics),
h AS (SELECT b.query_id, b.rank, b.path, b.start_line, c.total_lines, unnest(range(0, len(string_split(c.content, chr(10))))) AS i, unnest(string_split(c.content, chr(10))) AS line, q
      FROM bm25 b JOIN chunks c USING (path, start_line) JOIN toks2 USING (query_id)),
s AS (SELECT *, len(list_filter(q, lambda t: contains(lower(line), t))) AS n FROM h),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, rank ORDER BY n DESC, i) AS r FROM s) WHERE r = 1 AND n > 0)"""
ABSORBED = """inside AS (SELECT a.query_id, a.path, a.start_line AS ws, a.end_line AS we, b.start_line AS ns, b.end_line AS ne FROM fused a JOIN fused b ON a.query_id = b.query_id AND a.path = b.path
  AND a.start_line <= b.start_line AND a.end_line >= b.end_line AND (a.start_line < b.start_line OR a.end_line > b.end_line)),
gone AS (SELECT DISTINCT query_id, path, ws, we FROM inside),
live AS (SELECT f.* FROM fused f LEFT JOIN gone g ON f.query_id = g.query_id AND f.path = g.path AND f.start_line = g.ws AND f.end_line = g.we WHERE g.ws IS NULL),
cand AS (SELECT i.*, row_number() OVER (PARTITION BY i.query_id, i.path, ws, we ORDER BY ne - ns, ns, ne) AS r FROM inside i JOIN live l ON i.query_id = l.query_id AND i.path = l.path AND ns = l.start_line AND ne = l.end_line),
given AS (SELECT c.query_id, c.path, c.ns AS start_line, c.ne AS end_line, f.score, f.channels FROM cand c JOIN fused f ON f.query_id = c.query_id AND f.path = c.path AND f.start_line = ws AND f.end_line = we WHERE r = 1)"""


@query(f"WITH {FILES}, {LINES}, {CHUNKS} SELECT path, language, start_line, end_line, sha256(content) AS chunk_sha FROM chunks")
def line_window_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.line_chunks(files(spark, sf_dir))
    return chunks.select("path", "language", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.sha2(F.col("content").cast("binary"), 256).alias("chunk_sha"))


@query(f"WITH {FILES}, {LINES}, {CHUNKS}, {TOPICS}, {BM25} SELECT query_id, path, start_line, end_line, score, rank FROM bm25")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = corpus.line_chunks(files(spark, sf_dir))
    got = lexical.bm25(chunks, topics(spark, sf_dir), 20)
    return got.select("query_id", "path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {FILES}, {LINES}, {CHUNKS}, {TOPICS}, {BM25},
{BEST_LINES}
SELECT query_id, rank, path, start_line + i AS best_line, n AS n_tokens, greatest(1, start_line + i - 2) AS span_start, least(total_lines, start_line + i + 2) AS span_end FROM b""")
def bm25_evidence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks, q = corpus.line_chunks(files(spark, sf_dir)), topics(spark, sf_dir)
    got = lexical.best_lines(lexical.bm25(chunks, q, 20), chunks, q)
    return got.select("query_id", F.col("rank").cast("long").alias("rank"), "path", *[F.col(c).cast("long").alias(c) for c in ("best_line", "n_tokens", "span_start", "span_end")])


@query(f"WITH {FILES}, {LINES} SELECT path, line_no, sha256(line) AS line_sha FROM lines WHERE regexp_matches(line, '[A-Z][a-z]+ (the|of|and) [a-z]+')")
def regex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lexical.regex_lines(corpus.lines_of(files(spark, sf_dir)), "[A-Z][a-z]+ (the|of|and) [a-z]+")
    return got.select("path", F.col("line_no").cast("long").alias("line_no"), F.sha2(F.col("line").cast("binary"), 256).alias("line_sha"))


@query(f"WITH {FILES}, {LINES} SELECT path, line_no FROM lines WHERE contains(line, 'the of')")
def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.text_lines(corpus.lines_of(files(spark, sf_dir)), "the of").select("path", F.col("line_no").cast("long").alias("line_no"))


@query(f"WITH {FILES}, {LINES} SELECT path, min(line_no) AS line_no FROM lines WHERE regexp_matches(line, '(?i)token.*=') GROUP BY path")
def first_matching_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lexical.first_hits(corpus.lines_of(files(spark, sf_dir)), lexical.query_pattern("token =", "tokenized"))
    return got.select("path", F.col("line_no").cast("long").alias("line_no"))


@query("""WITH p AS (SELECT repo || '/' || CASE k WHEN 0 THEN 'src/a.py' WHEN 1 THEN 'node_modules/x.js' WHEN 2 THEN 'docs/readme.md' WHEN 3 THEN '.env.local' WHEN 4 THEN 'key.pem' ELSE 'lib/b.rs' END AS path
 FROM (SELECT 'r' || doc_id AS repo, doc_id % 6 AS k FROM documents))
SELECT path, CASE regexp_extract(path, '[^/]\\.([^./]+)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'md' THEN 'markdown' WHEN 'js' THEN 'javascript' ELSE 'unknown' END AS language
FROM p WHERE NOT contains(path, 'node_modules/') AND NOT ends_with(path, '.pem') AND NOT regexp_matches(path, '/\\.env[^/]*$')""")
def scan_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 6
    name = F.element_at(F.array(*map(F.lit, ("src/a.py", "node_modules/x.js", "docs/readme.md", ".env.local", "key.pem", "lib/b.rs"))), (kind + 1).cast("int"))
    paths = table(spark, sf_dir, "documents").select(F.concat(F.lit("r"), "doc_id", F.lit("/"), name).alias("path"))
    return paths.where(T.admitted(F.col("path"), [], ["**/*.pem", ".env*"])).select("path", T.language_of(F.col("path")).alias("language"))


@query(f"""WITH {FILES}, {TOPICS},
q AS (SELECT query_id, query, list_distinct({"list_filter(string_split_regex(lower(query), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"}) AS qw FROM topics),
bw AS (SELECT query_id, unnest(qw) AS term FROM q),
fw AS (SELECT path, unnest(list_distinct({"list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"})) AS term FROM files),
h AS (SELECT query_id, path, count(*) AS n FROM fw JOIN bw USING (term) GROUP BY ALL),
s AS (SELECT query_id, path, sum(n) AS score FROM (SELECT * FROM h UNION ALL SELECT query_id, path, 3 FROM files JOIN q ON contains(content, query)) GROUP BY ALL)
SELECT query_id, path, score::DOUBLE AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path) AS rank FROM s) WHERE rank <= 10""")
def symbol_overlap_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = lexical.symbol_overlap(files(spark, sf_dir), topics(spark, sf_dir), 10)
    return got.select("query_id", "path", "score", F.col("rank").cast("long").alias("rank"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four channels' spans: every document asks for a few spans near it."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    spread = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")).select("doc_id", "s", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    start = (F.col("doc_id") * 3 + F.col("rank") * F.col("s")) % 11 + 1
    return spread.select(
        (F.expr("doc_id div 4")).alias("query_id"), F.element_at(F.array(*map(F.lit, ("bm25", "regex", "symbol", "graph"))), F.col("s") + 1).alias("channel"),
        ((F.col("rank") - 1) * 4 + F.col("doc_id") % 4 + 1).alias("rank"), F.concat(F.lit("f"), (F.col("doc_id") + F.col("rank") * F.col("s")) % 7).alias("path"),
        start.alias("start_line"), (start + F.col("rank") * 3 % 8).alias("end_line"),
    )


SPANS = """sp AS (SELECT doc_id // 4 AS query_id, ['bm25','regex','symbol','graph'][s + 1] AS channel, (r - 1) * 4 + doc_id % 4 + 1 AS rank, 'f' || ((doc_id + r * s) % 7) AS path,
 (doc_id * 3 + r * s) % 11 + 1 AS start_line, (doc_id * 3 + r * s) % 11 + 1 + r * 3 % 8 AS end_line FROM documents, range(0, 4) a(s), range(1, 6) b(r))"""
FUSED = "fused AS (SELECT query_id, path, start_line, end_line, sum(1.0 / (60 + rank)) AS score, list_sort(list_distinct(list(channel))) AS channels, count(*) AS n_hits FROM sp GROUP BY ALL)"


@query(f"WITH {SPANS}, {FUSED} SELECT query_id, path, start_line, end_line, round(score, 6) AS score, array_to_string(channels, ',') AS channels, n_hits FROM fused")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fusion.rrf(_spans(spark, sf_dir))
    return got.select("query_id", "path", "start_line", "end_line", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"), "n_hits")


@query(f"""WITH {SPANS}, {FUSED},
{ABSORBED}
SELECT query_id, path, start_line, end_line, round(sum(score), 6) AS score, array_to_string(list_sort(list_distinct(flatten(list(channels)))), ',') AS channels
FROM (SELECT query_id, path, start_line, end_line, score, channels FROM live UNION ALL SELECT * FROM given) GROUP BY query_id, path, start_line, end_line""")
def rrf_overlap_absorb(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fusion.absorb_wider(fusion.rrf(_spans(spark, sf_dir)))
    return got.select("query_id", "path", "start_line", "end_line", F.round("score", 6).alias("score"), F.array_join("channels", ",").alias("channels"))


@query(f"WITH {SPANS} SELECT * EXCLUDE r FROM (SELECT *, row_number() OVER (PARTITION BY query_id, path ORDER BY rank, channel, start_line) AS r FROM sp) WHERE r = 1")
def dedupe_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _spans(spark, sf_dir).withColumn("old", F.col("rank")).withColumn("rank", F.struct("old", "channel", "start_line"))
    return fusion.dedupe_first(items, ["query_id", "path"]).withColumn("rank", F.col("old")).drop("old")


@query(f"""WITH {SPANS}, c AS (SELECT query_id, path, count(*) AS n_hits, max(rank) AS best FROM sp GROUP BY ALL)
SELECT query_id, path, n_hits, best, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n_hits DESC, best DESC, path) AS place FROM c) WHERE place <= 5""")
def top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = fusion.top_paths(_spans(spark, sf_dir).withColumn("score", F.col("rank")), 5)
    return got.withColumn("place", F.col("place").cast("long"))


@query("""WITH r AS (SELECT source AS query_id, doc_id, (strlen(text) + 3) // 4 AS tokens, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rank FROM documents),
u AS (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM r)
SELECT query_id, doc_id, rank, tokens::BIGINT AS tokens, used::BIGINT AS used FROM u WHERE used <= 5000""")
def token_budget_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), "doc_id", F.col("text").alias("excerpt"))
    got = fusion.budget_prefix(docs, 5000, "query_id", [F.col("doc_id")])
    return got.select("query_id", "doc_id", "rank", "tokens", "used")


def _citations(f: DataFrame) -> DataFrame:
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    return f.select(
        F.when(n % 11 == 3, F.concat(F.lit("gone/"), n)).when(n % 13 == 5, F.concat(F.lit("/"), "path")).otherwise(F.col("path")).alias("path"),
        (n % 4 + F.when(n % 17 == 2, -5).otherwise(0)).alias("start_line"), (n % 9 + 1).alias("end_line"),
        F.when(n % 7 == 1, "stale").when(n % 19 == 4, "").otherwise(F.col("content_sha")).alias("content_sha"), n.alias("n"),
    )


CITES = """cites AS (SELECT CASE WHEN n % 11 = 3 THEN 'gone/' || n WHEN n % 13 = 5 THEN '/' || path ELSE path END AS path, n % 4 + CASE WHEN n % 17 = 2 THEN -5 ELSE 0 END AS start_line, n % 9 + 1 AS end_line,
 CASE WHEN n % 7 = 1 THEN 'stale' WHEN n % 19 = 4 THEN '' ELSE content_sha END AS content_sha, n FROM (SELECT *, regexp_extract(path, '(\\d+)$', 1)::BIGINT AS n FROM files)),
verdicts AS (SELECT c.*, l.ls, CASE WHEN c.content_sha = '' THEN 'empty_sha' WHEN starts_with(c.path, '/') OR list_contains(string_split(c.path, '/'), '..') THEN 'path_unsafe' WHEN l.path IS NULL THEN 'file_missing'
 WHEN c.content_sha <> l.content_sha THEN 'stale_content' WHEN start_line < 1 OR start_line > end_line OR end_line > len(ls) THEN 'bad_range' ELSE 'ok' END AS reason FROM cites c LEFT JOIN lists l USING (path))"""


@query(f"WITH {FILES}, {LINES}, {CITES} SELECT n, path, start_line, end_line, reason FROM verdicts")
def citation_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return evidence.checked(_citations(f), f).select("n", "path", "start_line", "end_line", "reason")


@query(f"WITH {FILES}, {LINES}, {CITES} SELECT n, path, start_line, end_line, sha256(array_to_string(ls[start_line : end_line], chr(10))) AS excerpt_sha FROM verdicts WHERE reason = 'ok'")
def materialized_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return evidence.materialize(_citations(f), f).select("n", "path", "start_line", "end_line", F.sha2(F.col("excerpt").cast("binary"), 256).alias("excerpt_sha"))


def _mutated(f: DataFrame) -> DataFrame:
    """The corpus after changes: some files edited, some gone, some renamed."""
    n = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    text = F.when(n % 5 == 1, F.concat("content", F.lit("\nedited"))).otherwise(F.col("content"))
    kept = f.where(n % 7 != 2)
    return kept.select(
        F.when(n % 9 == 4, F.concat("path", F.lit(".new"))).otherwise(F.col("path")).alias("path"), "repo_id", "language",
        F.sha2(text.cast("binary"), 256).alias("content_sha"), F.octet_length(text).cast("long").alias("size"), text.alias("content"),
    )


MUTATED = """mutated AS (SELECT CASE WHEN n % 9 = 4 THEN path || '.new' ELSE path END AS path, CASE WHEN n % 5 = 1 THEN content || chr(10) || 'edited' ELSE content END AS content FROM
 (SELECT *, regexp_extract(path, '(\\d+)$', 1)::BIGINT AS n FROM files) WHERE n % 7 <> 2), fresh AS (SELECT path, sha256(content) AS content_sha FROM mutated),
diff AS (SELECT coalesce(f.path, m.path) AS path, CASE WHEN f.path IS NULL THEN 'added' WHEN m.path IS NULL THEN 'deleted' WHEN f.content_sha <> m.content_sha THEN 'modified' ELSE 'clean' END AS state FROM files f FULL JOIN fresh m ON f.path = m.path)"""


@query(f"WITH {FILES}, {MUTATED} SELECT path, state FROM diff")
def index_dirty_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return lifecycle.dirty_diff(lifecycle.manifest_of(f), _mutated(f)).select("path", "state")


@query(f"WITH {FILES}, {MUTATED} SELECT count(*) FILTER (state = 'added') AS n_added, count(*) FILTER (state = 'modified') AS n_modified, count(*) FILTER (state = 'deleted') AS n_deleted, count(*) FILTER (state = 'clean') AS n_clean, count(*) FILTER (state <> 'clean') > 0 AS is_dirty FROM diff")
def index_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return lifecycle.status(lifecycle.manifest_of(f), _mutated(f))


@query(f"WITH {FILES}, {MUTATED} SELECT path, CASE state WHEN 'deleted' THEN 'deleted' ELSE 'stale' END AS problem FROM diff WHERE state IN ('deleted', 'modified')")
def index_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return lifecycle.validate(lifecycle.manifest_of(f), _mutated(f))


@query(f"WITH {FILES}, {MUTATED}, m2 AS (SELECT path, {'CASE WHEN content = chr(0) THEN NULL ELSE content END'} AS content FROM mutated), files2 AS (SELECT path, NULL AS language, sha256(content) AS content_sha, content FROM m2), {LINES.replace('FROM files)', 'FROM files2)')}, {CHUNKS} SELECT path, start_line, end_line, content_sha, sha256(content) AS chunk_sha FROM chunks")
def index_update_equals_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    new = _mutated(f)
    diff = lifecycle.dirty_diff(lifecycle.manifest_of(f), new)
    got = lifecycle.update_chunks(corpus.line_chunks(f), diff, new)
    return got.select("path", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), "content_sha", F.sha2(F.col("content").cast("binary"), 256).alias("chunk_sha"))


MUTATED_CHUNKS = f"m2 AS (SELECT path, CASE WHEN content = chr(0) THEN NULL ELSE content END AS content FROM mutated), files2 AS (SELECT path, NULL AS language, sha256(content) AS content_sha, content FROM m2), {LINES.replace('FROM files)', 'FROM files2)')}, {CHUNKS}"


@query(f"""WITH {FILES}, {MUTATED}, {MUTATED_CHUNKS},
tf AS (SELECT path, start_line, end_line, dl, term, count(*) AS tf FROM (SELECT path, start_line, end_line, len(w) AS dl, unnest(w) AS term FROM (SELECT *, {words_sql('content')} AS w FROM chunks)) GROUP BY ALL)
SELECT path, start_line, end_line, dl AS len, count(*) AS n_terms, sha256(string_agg(term || ':' || tf, ',' ORDER BY term || ':' || tf)) AS terms_sha FROM tf GROUP BY ALL""")
def index_segments_equal_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index is built, brought up to date by segments and compacted; its
    postings are those of an index of the new files."""
    old, root = files(spark, sf_dir), scratch(spark, "index")
    new = _mutated(old)
    index.build_index(old, root)
    half = F.col("path").rlike("[02468](\\.new)?$")
    # First the even paths change, then all.
    index.update_index(spark, root, old.where(~half).unionByName(new.where(half)))
    index.update_index(spark, root, new)
    index.compact(spark, root)
    got = index.open_bm25(spark, root, cached=False).chunks
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return got.select(
        "path", *long("start_line", "end_line", "len"), F.size("terms").cast("long").alias("n_terms"), F.sha2(F.array_join("terms", ",").cast("binary"), 256).alias("terms_sha"))


HREFS = "edges AS (SELECT 'page/' || page_id AS source_path, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target_path FROM pages)"


@query(f"WITH {HREFS} SELECT source_path, target_path, count(*) AS n_links FROM edges GROUP BY ALL")
def link_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.link_edges(table(spark, sf_dir, "pages"))


@query(f"WITH {HREFS}, e AS (SELECT source_path, target_path, count(*) AS n_links FROM edges GROUP BY ALL), t AS (SELECT DISTINCT '/' || regexp_extract(text, '^[^ ]+') AS path FROM benchmark) SELECT e.* FROM e SEMI JOIN t ON e.target_path = t.path")
def link_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("/"), F.regexp_extract("text", "^[^ ]+", 0)).alias("path")).distinct()
    return graph.impact(graph.link_edges(table(spark, sf_dir, "pages")), targets).select("source_path", "target_path", "n_links")


@query(f"WITH {HREFS} SELECT CASE WHEN starts_with(target_path, '/') THEN 'site' WHEN starts_with(target_path, 'http') THEN 'external' ELSE 'other' END AS kind, count(DISTINCT (source_path, target_path)) AS n_edges FROM edges GROUP BY 1")
def edges_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = graph.link_edges(table(spark, sf_dir, "pages"))
    kind = F.when(F.col("target_path").startswith("/"), "site").when(F.col("target_path").startswith("http"), "external").otherwise("other")
    return graph.edges_by_kind(e.withColumn("kind", kind))


@query(f"""WITH {FILES}, {LINES}, {CHUNKS}, {TOPICS}, {BM25}, {BEST_LINES},
m AS (SELECT query_id, path, line_no, row_number() OVER (PARTITION BY query_id ORDER BY path, line_no) AS rank FROM topics JOIN lines ON regexp_matches(line, query)),
t AS (SELECT query_id, path, greatest(1, start_line + i - 2) AS start_line, least(total_lines, start_line + i + 2) AS end_line, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM b),
sp AS (SELECT query_id, path, line_no AS start_line, line_no AS end_line, rank, 'regex' AS channel FROM m WHERE rank <= 10 UNION ALL SELECT query_id, path, start_line, end_line, rank, 'bm25' FROM t WHERE rank <= 10),
fused AS (SELECT query_id, path, start_line, end_line, sum(1.0 / (60 + rank)) AS score, list_sort(list_distinct(list(channel))) AS channels, count(*) AS n_hits FROM sp GROUP BY ALL), {ABSORBED},
f AS (SELECT query_id, path, start_line, end_line, round(sum(score), 9) AS score, array_to_string(list_sort(list_distinct(flatten(list(channels)))), ',') AS channels
FROM (SELECT query_id, path, start_line, end_line, score, channels FROM live UNION ALL SELECT * FROM given) GROUP BY query_id, path, start_line, end_line)
SELECT query_id, rank, path, start_line, end_line, score, channels FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line, end_line) AS rank FROM f) WHERE rank <= 10""")
def retrieve_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are in no programming language, so no line of theirs
    defines a name and the SQL has no symbol list."""
    got = context.retrieve(files(spark, sf_dir), topics(spark, sf_dir), k=10)
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return got.select("query_id", *long("rank"), "path", *long("start_line", "end_line"), "score", F.array_join("channels", ",").alias("channels"))


LIBRARY = "corpus AS (SELECT 'r' || doc_id % 3 AS repo_id, 'notes/' || doc_id || '.txt' AS path, text AS content FROM documents UNION ALL SELECT 'r' || item_id % 3, 'lib/' || string_split(text, ' ')[1] || '.py', '' FROM benchmark)"


@query(f"""WITH {LIBRARY}, tests AS (SELECT * FROM corpus WHERE contains(lower(path), 'test') OR contains(content, 'assert') OR contains(content, 'test')),
targets AS (SELECT DISTINCT repo_id, path, regexp_extract(path, '([^/]*)[.][^.]*$', 1) AS stem FROM corpus WHERE NOT contains(lower(path), 'test') AND starts_with(path, 'lib/'))
SELECT DISTINCT t.path AS source_path, g.path AS target_path, 'tests' AS kind FROM tests t JOIN targets g ON t.repo_id = g.repo_id AND contains(t.content, g.stem)""")
def stem_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts about tests, and the modules whose stem stands in them; modules are
    named after the first words of benchmark items."""
    repo = lambda c: F.concat(F.lit("r"), F.col(c) % 3).alias("repo_id")
    notes = table(spark, sf_dir, "documents").select(repo("doc_id"), F.concat(F.lit("notes/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content"))
    modules = table(spark, sf_dir, "benchmark").select(
        repo("item_id"), F.concat(F.lit("lib/"), F.get(F.split("text", " ", -1), 0), F.lit(".py")).alias("path"), F.lit("").alias("content"))
    is_test = "contains(lower(path), 'test') OR contains(content, 'assert') OR contains(content, 'test')"
    return manypatterns.stem_tests(notes.unionByName(modules), is_test, "startswith(path, 'lib/')")


@query()
def fast_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return context.fast_context(f, topics(spark, sf_dir), graph.build_graph(f))


@query("""WITH p AS (SELECT page_id, len(string_split(regexp_extract(html, '(?s)<script>(.*?)</script>', 1), chr(10))) - 1 AS nl FROM pages),
s AS (SELECT 'page' || page_id || '.ts' AS path, unnest([{'name': 'Page' || page_id, 'kind': 'class', 'a': 1, 'b': nl + 9}, {'name': 'run', 'kind': 'method', 'a': 3, 'b': nl + 8}, {'name': 'limit' || page_id, 'kind': 'const', 'a': nl + 10, 'b': nl + 10}, {'name': 'after' || page_id, 'kind': 'function', 'a': nl + 11, 'b': nl + 12}]) AS d FROM p)
SELECT path, d.name AS name, d.kind AS kind, d.a AS start_line, least(d.b, d.a + 9) AS end_line, d.b AS block_end FROM s""")
def syntax_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions of modules around each page's script, with braces in
    comments, strings, patterns and template strings."""
    pages, script = table(spark, sf_dir, "pages"), F.regexp_extract("html", r"(?s)<script>(.*?)</script>", 1)
    number = F.col("page_id").cast("string")
    text = F.concat(
        F.lit("export class Page"), number, F.lit(" {\n  // opens { here, and \" too\n  run({a, b}) {\n    "), script,
        F.lit("\n    const s = \"}\" + /[}/]{2}/.source; /* } */\n    return `a ${ {k: '}'}.k + `n${1 / 2}` } }`;\n\n  }\n}\nconst limit"), number,
        F.lit(" = 4 / 2 / 1\nfunction after"), number, F.lit("() {\n  return '{' }\n\n"))
    made = pages.select(F.concat(F.lit("page"), number, F.lit(".ts")).alias("path"), F.lit("typescript").alias("language"), text.alias("content"))
    long = lambda *names: [F.col(c).cast("long").alias(c) for c in names]
    return syntax.symbols(made).select("path", "name", "kind", *long("start_line", "end_line", "block_end"))
