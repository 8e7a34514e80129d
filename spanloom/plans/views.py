"""Queries over embedding views of modules that are made from each page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import views
from ..sources.corpus import table
from .registry import lines_sql, query

#: By page_id % 3: path, language, text; {n} is the page, {h} its heading, {s} its script.
MODULES = (
    ("src/page{n}.ts", "typescript", "// {h}\n\n/* kept */\nexport class Page{n} {\n  run(a) {\n    {s}\n  }\n}\n\nexport async function load{n}(a) {\n  return router.get('/{n}', a)\n}\n"),
    ("tests/page{n}_spec.py", "python", "# {h}\n# of page {n}\n\n\nclass Test{n}:\n    x = 1\n    def check(self):\n        assert title == '{n}'\n"),
    ("conf/page{n}.toml", "config", "title = '{h}'\n  limit.low: {n}\n# {h}\nroute = http.local\n"),
)
HEADING, SCRIPT = r"(?s)<h1>(.*?)</h1>", r"(?s)<script>(.*?)</script>"


def _modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    html, page = F.coalesce("html", F.lit("")), F.col("page_id")
    parts = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(html, HEADING, 1).alias("h"), F.regexp_extract(html, SCRIPT, 1).alias("s"))

    def filled(which: int, marks: str):
        out = F
        for k, forms in enumerate(MODULES):
            made = F.lit(forms[which])
            for mark in marks:
                value = page.cast("string") if mark == "n" else F.col(mark)
                made = F.replace(made, F.lit("{" + mark + "}"), value)
            out = out.when(page % 3 == k, made)
        return out

    rows = parts.select(F.concat(F.lit("repo"), page % 2).alias("repo_id"), filled(0, "n").alias("path"), filled(1, "").alias("language"), filled(2, "hsn").alias("content"))
    return rows.withColumn("content_sha", F.sha2(F.col("content").cast("binary"), 256))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.concat(F.lit("repo"), F.col("item_id") % 2).alias("repo_id"), F.col("text").alias("query"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled_sql(which: int) -> str:
    cases = " ".join(
        f"WHEN {k} THEN replace(replace(replace({_quoted(forms[which])}, '{{h}}', regexp_extract(coalesce(html, ''), {_quoted(HEADING)}, 1)), '{{s}}', regexp_extract(coalesce(html, ''), {_quoted(SCRIPT)}, 1)), '{{n}}', page_id::VARCHAR)"
        for k, forms in enumerate(MODULES))
    return f"CASE page_id % 3 {cases} END"


def _symbols_sql() -> str:
    families = {"python": views.SYMBOL_LINES["python"], "typescript": views.SYMBOL_LINES["javascript"] + views.SYMBOL_LINES["typescript"]}
    return " UNION ALL ".join(
        f"SELECT path, i, {order} AS o, '{kind}' AS kind, unnest(regexp_extract_all(x, {_quoted(p)}, 1)) AS name FROM ln WHERE language = '{language}'"
        for language, patterns in families.items() for order, (p, kind) in enumerate(patterns))


LIST = ", ".join(f"'{v}'" for v in views.VIEWS)
RECORDS = f"""f AS (SELECT 'repo' || page_id % 2 AS repo_id, {_filled_sql(0)} AS path, {_filled_sql(1)} AS language, {_filled_sql(2)} AS content FROM pages),
ls AS (SELECT *, {lines_sql('content')} AS ls FROM f),
lt AS (SELECT *, list_transform(ls, lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')) AS ts, len(ls) AS n FROM ls WHERE len(ls) > 0),
ln AS (SELECT repo_id, path, language, n, unnest(range(1, n + 1)) AS i, unnest(ls) AS x, unnest(ts) AS t FROM lt),
kinds AS (SELECT path, list(CASE WHEN t = '' THEN 'b' WHEN regexp_matches(t, {_quoted(views.COMMENT)}) THEN 'c' ELSE 'x' END ORDER BY i) AS kk FROM ln GROUP BY path),
sym AS (SELECT * FROM (SELECT path, i, name, kind, row_number() OVER (PARTITION BY path ORDER BY i, name, o) AS s FROM ({_symbols_sql()})) WHERE s <= 80),
whole AS (SELECT * FROM lt JOIN kinds USING (path)),
near AS (SELECT *, coalesce(list_max(list_filter(range(1, i), lambda q: kk[q] <> 'b')), 0) AS j FROM sym JOIN whole USING (path)),
docs AS (SELECT *, CASE WHEN j < 1 OR kk[j] <> 'c' THEN [] WHEN j < 2 OR kk[j - 1] <> 'c' THEN ts[j:j] WHEN j < 3 OR kk[j - 2] <> 'c' THEN ts[j - 1:j] ELSE ts[j - 2:j] END AS above FROM near),
cm AS (SELECT path, i, t, row_number() OVER (PARTITION BY path ORDER BY i) AS k, count(*) OVER (PARTITION BY path) AS m FROM ln WHERE regexp_matches(t, {_quoted(views.COMMENT)})),
asr AS (SELECT path, n, t, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM ln WHERE regexp_matches(t, {_quoted(views.ASSERT)}) AND regexp_matches(path, '(?i)(test|spec)')),
rt AS (SELECT path, n, i, t, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM ln WHERE regexp_matches(t, {_quoted(views.ROUTE)})),
ky AS (SELECT path, n, key, row_number() OVER (PARTITION BY path ORDER BY i) AS k FROM (SELECT path, n, i, regexp_extract(t, {_quoted(views.SETTING)}, 1) AS key FROM ln WHERE language = 'config' OR ends_with(path, '.toml')) WHERE key <> ''),
one AS (SELECT path, 'path_plus_symbol' AS view, s AS ordinal, i AS start_line, i AS end_line, 'path ' || path || ' language ' || language || ' symbol ' || name || ' kind ' || kind AS text, 0 AS data_level FROM near
UNION ALL SELECT path, 'path_plus_symbol', 1, 1, least(3, n), 'path ' || path || ' language ' || language || ' basename ' || regexp_replace(string_split(path, '/')[-1], '\\.[^.]*$', ''), 0 FROM lt WHERE path NOT IN (SELECT path FROM sym)
UNION ALL SELECT path, 'signature_only', s, i, i, kind || ' ' || name || ' ' || ts[i], 1 FROM near
UNION ALL SELECT path, 'signature_plus_doc', s, greatest(1, i - 3), i, regexp_replace(array_to_string(above, chr(10)) || chr(10) || ls[i], '^\\s+|\\s+$', '', 'g'), 1 FROM docs
UNION ALL SELECT path, 'ast_header', s, i, least(n, i + 2), array_to_string(ls[i:i + 2], chr(10)), 1 FROM near
UNION ALL SELECT path, 'raw_code_trimmed', 1, 1, least(60, n), raw, 1 FROM (SELECT path, n, left(array_to_string(list_filter(ls[1:60], lambda x: regexp_matches(x, '\\S')), chr(10)), 3000) AS raw FROM lt) WHERE raw <> ''
UNION ALL SELECT path, 'comment_docstring', 1, min(i), max(CASE WHEN k <= 12 THEN i END), left(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE k <= 24), 2400), 1 FROM cm GROUP BY path
UNION ALL SELECT path, 'test_name_plus_assert_terms', 1, 1, max(n), 'test file ' || path || chr(10) || string_agg(t, chr(10) ORDER BY k) FILTER (WHERE k <= 30), 1 FROM asr GROUP BY path
UNION ALL SELECT path, 'config_key_plus_context', 1, 1, least(80, max(n)), 'config path ' || path || ' keys ' || string_agg(key, ' ' ORDER BY k) FILTER (WHERE k <= 80), 1 FROM ky GROUP BY path
UNION ALL SELECT path, 'route_plus_handler_signature', 1, min(i), least(max(n), min(i) + 8), 'route handler path ' || path || chr(10) || string_agg(t, chr(10) ORDER BY k) FILTER (WHERE k <= 24), 1 FROM rt GROUP BY path),
mx AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY list_position([{LIST}], view), ordinal) AS k FROM one WHERE ordinal <= 2 AND view IN ({', '.join(f"'{v}'" for v in views.MIXED)})),
rec AS (SELECT * FROM one UNION ALL SELECT path, 'mixed_all_views', k, start_line, end_line, view || chr(10) || text, data_level FROM mx WHERE k <= 5)"""
VECTOR = "('0x' || substr(sha256(w), 1, 2))::INTEGER AS d, CASE WHEN ('0x' || substr(sha256(w), 9, 2))::INTEGER % 2 = 0 THEN 1 ELSE -1 END AS s"
WORDS = f"regexp_extract_all(lower({{}}), {_quoted(views.WORD)})"
RANKS = f"""rv AS (SELECT path, view, ordinal, d, sum(s)::DOUBLE AS x FROM (SELECT path, view, ordinal, {VECTOR} FROM (SELECT path, view, ordinal, unnest({WORDS.format('text')}) AS w FROM rec)) GROUP BY ALL),
rn AS (SELECT path, view, ordinal, sqrt(sum(x * x)) AS norm FROM rv GROUP BY ALL),
qv AS (SELECT task_id, repo_id, d, sum(s)::DOUBLE AS y FROM (SELECT task_id, repo_id, {VECTOR} FROM (SELECT item_id AS task_id, 'repo' || item_id % 2 AS repo_id, unnest({WORDS.format("'query ' || text")}) AS w FROM benchmark WHERE text <> '')) GROUP BY ALL),
qn AS (SELECT task_id, sqrt(sum(y * y)) AS qnorm FROM qv GROUP BY ALL),
dots AS (SELECT task_id, path, view, ordinal, sum(x * y) AS dot FROM rv JOIN f USING (path) JOIN qv USING (repo_id, d) GROUP BY ALL),
sc AS (SELECT task_id, path, view, ordinal, round(dot / (qnorm * norm), 6) AS score FROM dots JOIN rn USING (path, view, ordinal) JOIN qn USING (task_id) WHERE norm > 0 AND qnorm > 0),
vr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY task_id, view ORDER BY score DESC, path, ordinal) AS rank FROM sc WHERE score > 0) WHERE rank <= 5)"""


@query(f"WITH {RECORDS} SELECT path, view, ordinal::BIGINT AS ordinal, start_line::BIGINT AS start_line, end_line::BIGINT AS end_line, sha256(text) AS text_sha, data_level::BIGINT AS data_level FROM rec")
def embedding_views(spark, sf_dir):
    long = lambda c: F.col(c).cast("long").alias(c)
    return views.file_views(_modules(spark, sf_dir)).select(
        "path", "view", long("ordinal"), long("start_line"), long("end_line"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha"), long("data_level"))


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.rank_views(views.file_views(_modules(spark, sf_dir)), _tasks(spark, sf_dir), 5)


@query(f"WITH {RECORDS}, {RANKS} SELECT task_id, view, rank, path, ordinal::BIGINT AS ordinal, score FROM vr")
def view_ranks(spark, sf_dir):
    long = lambda c: F.col(c).cast("long").alias(c)
    return _ranks(spark, sf_dir).select("task_id", "view", long("rank"), "path", long("ordinal"), "score")


@query(f"""WITH {RECORDS}, {RANKS}, best AS (SELECT task_id, path, max(score) AS score FROM vr GROUP BY ALL), v AS (SELECT b.*, min(vr.view) AS view FROM best b JOIN vr USING (task_id, path) WHERE vr.score = b.score GROUP BY ALL)
SELECT * FROM (SELECT task_id, path, score, view, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, path) AS rank FROM v) WHERE rank <= 5""")
def view_file_ranks(spark, sf_dir):
    return views.rank_files(_ranks(spark, sf_dir), 5).withColumn("rank", F.col("rank").cast("long"))
