"""Queries over sources and column functions: spans, citations, ranges, paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import governance, vectors
from ..sources import corpus, ignore
from ..sources.corpus import table
from .registry import FILES, files, query


def _doc() -> Column:
    return F.col("doc_id")


@query(f"WITH {FILES}, s AS (SELECT path, content_sha, string_split(regexp_replace(content, '\\n\\z', ''), chr(10)) AS ls FROM files WHERE path = 'doc/7') SELECT path, 1 AS start_line, least(len(ls), 9)::INTEGER AS end_line, content_sha, array_to_string(list_transform(ls[1:9], lambda x: regexp_replace(x, '\\r\\z', '')), chr(10)) AS excerpt FROM s")
def read_span_rows(spark, sf_dir):
    return corpus.read_span(files(spark, sf_dir), "doc/7:1-9").drop("score")


@query("""SELECT 'doc/' || doc_id AS path, k AS start_line, k + doc_id % 5 AS end_line FROM documents, range(1, 3) r(k) WHERE k = 1 OR doc_id % 3 = 1""")
def citation_inputs(spark, sf_dir):
    one = lambda k: F.struct(F.concat(F.lit("doc/"), _doc()).alias("path"), F.lit(k).alias("start_line"), (F.lit(k) + _doc() % 5).alias("end_line"))
    raw = table(spark, sf_dir, "documents").select(
        F.when(_doc() % 3 == 0, F.to_json(one(1))).when(_doc() % 3 == 1, F.to_json(F.array(one(1), one(2))))
        .otherwise(F.to_json(F.struct(F.array(one(1)).alias("evidence")))).alias("body")
    )
    return corpus.citations(raw, "body").select("path", "start_line", "end_line")


@query("""SELECT doc_id, CASE WHEN doc_id % 6 IN (4, 5) THEN NULL ELSE doc_id + 1 END AS start_line,
CASE doc_id % 6 WHEN 0 THEN doc_id + 1 WHEN 1 THEN doc_id + 4 WHEN 2 THEN doc_id + 9 WHEN 3 THEN doc_id + 2 END AS end_line FROM documents""")
def line_ranges(spark, sf_dir):
    a, kind = _doc() + 1, _doc() % 6
    value = (
        F.when(kind == 0, a.cast("string")).when(kind == 1, F.concat(a, F.lit("-"), _doc() + 4)).when(kind == 2, F.concat(F.lit("["), a, F.lit(", "), _doc() + 9, F.lit("]")))
        .when(kind == 3, F.concat(F.lit("L"), a, F.lit("-L"), _doc() + 2)).when(kind == 4, F.concat(a, F.lit("-"), _doc())).otherwise("none")
    )
    found = table(spark, sf_dir, "documents").select("doc_id", corpus.line_range(value).alias("r"))
    return found.select("doc_id", "r.start_line", "r.end_line")


@query(f"""WITH {FILES}, g AS (SELECT left(sha256(path), 3) AS g, sha256(string_agg(path || ':' || content_sha, chr(10) ORDER BY path || ':' || content_sha)) AS h FROM files GROUP BY 1)
SELECT sha256(string_agg(g || ':' || h, chr(10) ORDER BY g || ':' || h)) AS manifest_sha FROM g""")
def manifest_hash(spark, sf_dir):
    return corpus.manifest_sha(files(spark, sf_dir))


PATHS = ("src/main.rs", "/abs/x.py", "../up.ts", ".git/config", "docs/x/../y.md", "a.tar.json", "node_modules/q.js", ".env.local", "Makefile", "src/./deep//z.go", "keys/id.pem")
LANGS = " ".join(f"WHEN '{e}' THEN '{v}'" for e, v in T.LANGUAGES.items())


@query(f"""WITH p AS (SELECT doc_id, [{', '.join(f"'{x}'" for x in PATHS)}][doc_id % {len(PATHS)} + 1] AS path FROM documents)
SELECT doc_id, path, CASE regexp_extract(path, '[^/]\\.([^./]+)$', 1) {LANGS} ELSE 'unknown' END AS language, NOT starts_with(path, '/') AND NOT list_contains(string_split(path, '/'), '..') AS safe,
NOT list_has_any(string_split(path, '/'), ['.git', 'target', 'node_modules', 'dist', '.spanloom']) AND NOT ends_with(path, '.pem') AND NOT starts_with(string_split(path, '/')[-1], '.env') AS admitted,
CASE path WHEN 'docs/x/../y.md' THEN 'docs/y.md' WHEN '../up.ts' THEN 'up.ts' WHEN '/abs/x.py' THEN 'abs/x.py' WHEN 'src/./deep//z.go' THEN 'src/deep/z.go' ELSE path END AS normalized FROM p""")
def path_rules(spark, sf_dir):
    path = F.element_at(F.array(*map(F.lit, PATHS)), (_doc() % len(PATHS) + 1).cast("int"))
    p = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"))
    return p.select(
        "*", T.language_of(F.col("path")).alias("language"), T.is_safe_path(F.col("path")).alias("safe"),
        T.admitted(F.col("path"), [], ["**/*.pem", ".env*"]).alias("admitted"), T.normalized_path(F.col("path")).alias("normalized"),
    )


@query("""WITH q AS (SELECT item_id, 'loadUser_name ' || text AS q FROM benchmark), t AS (SELECT item_id, q, list_filter(string_split_regex(lower(q), '[\\s:/"()]+'), lambda w: strlen(w) >= 2 AND NOT starts_with(w, '_')) AS all_toks,
list_filter(string_split_regex(lower(replace(regexp_replace(q, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '_', ' ')), '[^a-z0-9]+'), lambda w: length(w) >= 3) AS parts FROM q)
SELECT item_id, len(list_distinct(all_toks)) AS n_tokens, all_toks[1] AS first_token, array_to_string(parts[1:12], ' ') AS normalized FROM t""")
def query_functions(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.lit("loadUser_name "), "text").alias("q"))
    toks = T.query_tokens(F.col("q"))
    return q.select("item_id", F.size(toks).cast("long").alias("n_tokens"), F.get(toks, 0).alias("first_token"), T.normalized_query(F.col("q")).alias("normalized"))


@query("""WITH k AS (SELECT unnest(regexp_extract_all(props, '"([^"]+)"\\s*:', 1)) AS field FROM events) SELECT field, count(*) AS n FROM k WHERE field IN ('k', 'gold_spans', 'label_quality', 'page', 'ref') GROUP BY ALL""")
def private_fields(spark, sf_dir):
    return governance.private_fields(table(spark, sf_dir, "events"), "props", ["k", "gold_spans", "label_quality", "page", "ref"])


@query("""WITH h AS (SELECT doc_id, unnest(range(0, 32)) AS dim, sha256(coalesce(text, '')) AS t FROM documents), x AS (SELECT doc_id, dim, ('0x' || substr(sha256(t || ':' || dim), 1, 8))::BIGINT - 2147483648 AS x FROM h)
SELECT doc_id, dim::INTEGER AS dim, round(x / sqrt(sum(x::DOUBLE * x) OVER (PARTITION BY doc_id)), 6) AS x FROM x""")
def mock_embedding(spark, sf_dir):
    got = vectors.mock_embedding(table(spark, sf_dir, "documents"), "doc_id")
    return got.select("doc_id", F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.round("x", 6))


IGNORE_FILES = [
    (".gitignore", "# logs\n*.log\n!keep*.log\n/build/\nsrc/**/tmp\ndoc?.md\n"), (".git/info/exclude", "*.txt\nkeep7.log\n"),
    ("src/en/.gitignore", "!*.log\n[0-4]*.py\n"), ("src/fr/.ignore", "*\n!*.py\n"), ("src/en/b/.gitignore", "\\#x\n*.py\n!/9*.py\n"),
]


@query("""WITH p AS (SELECT path, regexp_extract(path, '[^/]*$') AS name FROM (SELECT CASE doc_id % 4 WHEN 0 THEN 'src/' || lang || '/' || ['a', 'b', 'tmp'][doc_id % 3 + 1] || '/' WHEN 1 THEN ['build/', 'lib/build/', ''][doc_id % 3 + 1] WHEN 2 THEN 'src/' || lang || '/' ELSE '' END ||
 CASE doc_id % 5 WHEN 0 THEN doc_id || '.py' WHEN 1 THEN 'keep' || doc_id || '.log' WHEN 2 THEN doc_id || '.log' WHEN 3 THEN doc_id || '.txt' ELSE 'doc' || doc_id % 20 || '.md' END AS path FROM documents))
SELECT DISTINCT path FROM p WHERE NOT starts_with(path, 'build/') AND NOT regexp_matches(path, '^src/(.*/)?tmp/') AND NOT CASE
 WHEN starts_with(path, 'src/en/b/') AND ends_with(name, '.py') THEN NOT starts_with(name, '9')
 WHEN starts_with(path, 'src/en/') AND regexp_matches(name, '^[0-4].*[.]py$') THEN true WHEN starts_with(path, 'src/en/') AND ends_with(name, '.log') THEN false
 WHEN starts_with(path, 'src/fr/') THEN regexp_matches(path, '^src/fr/[^/]*/') OR NOT ends_with(name, '.py')
 WHEN regexp_matches(name, '^doc.[.]md$') THEN true WHEN regexp_matches(name, '^keep.*[.]log$') THEN false WHEN ends_with(name, '.log') THEN true ELSE ends_with(name, '.txt') END""")
def gitignore_scan(spark, sf_dir):
    """Paths made from the documents that a tree's ignore files leave in."""
    d = _doc()
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    folder = (
        F.when(d % 4 == 0, F.concat(F.lit("src/"), "lang", F.lit("/"), pick(("a", "b", "tmp"), d % 3), F.lit("/")))
        .when(d % 4 == 1, pick(("build/", "lib/build/", ""), d % 3)).when(d % 4 == 2, F.concat(F.lit("src/"), "lang", F.lit("/"))).otherwise("")
    )
    name = (
        F.when(d % 5 == 0, F.concat(d, F.lit(".py"))).when(d % 5 == 1, F.concat(F.lit("keep"), d, F.lit(".log"))).when(d % 5 == 2, F.concat(d, F.lit(".log")))
        .when(d % 5 == 3, F.concat(d, F.lit(".txt"))).otherwise(F.concat(F.lit("doc"), d % 20, F.lit(".md")))
    )
    paths = table(spark, sf_dir, "documents").select(F.concat(folder, name).alias("path")).distinct()
    return ignore.not_ignored(paths, ignore.rules_of(spark.createDataFrame(IGNORE_FILES, "path string, content string")))


@query("""WITH k AS (SELECT (doc_id % 3 = 0)::INT AS gold, (doc_id % 4 = 1)::INT AS tags, 1 + doc_id % 2 AS more FROM documents)
SELECT depth, field, sum(n)::BIGINT AS n FROM (
 SELECT 1 AS depth, 'task' AS field, 1 AS n FROM k UNION ALL SELECT 1, 'list', 1 FROM k UNION ALL SELECT 2, 'note', 1 FROM k UNION ALL SELECT 2, 'gold_spans', gold FROM k
 UNION ALL SELECT 4, 'path', gold * more FROM k UNION ALL SELECT 4, 'caveat', 1 FROM k UNION ALL SELECT 5, 'risk_tags', tags FROM k) GROUP BY ALL HAVING sum(n) > 0""")
def nested_json_fields(spark, sf_dir):
    """Keys of nested artifacts by depth (list elements count as a level); notes
    hold what looks like keys."""
    d = _doc()
    span = '{"path":"a"}'
    body = F.concat(
        F.lit('{"task":{"note":"\\"risk_tags\\": 1, {"'), F.when(d % 3 == 0, F.concat(F.lit(',"gold_spans":['), F.when(d % 2 == 1, f"{span},").otherwise(""), F.lit(span + "]"))).otherwise(""),
        F.lit('},"list":[[{"caveat":'), F.when(d % 4 == 1, '{"risk_tags":null}').otherwise("1"), F.lit("}]]}"))
    made = table(spark, sf_dir, "documents").select("doc_id", body.alias("body"))
    return governance.json_fields(made, "doc_id", "body").groupBy("depth", "field").agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT DISTINCT string_split(text, ' ')[1] AS token FROM benchmark) SELECT page_id, token FROM pages JOIN t ON contains(html, token)""")
def canary_hits(spark, sf_dir):
    """Pages that hold the first word of a benchmark item, taken as a canary."""
    tokens = table(spark, sf_dir, "benchmark").select(F.get(F.split("text", " ", -1), 0).alias("token"))
    return governance.canary_hits(table(spark, sf_dir, "pages"), "page_id", "html", tokens)
