"""Queries that join vector lists to lexical anchors, choose packs by how lists
differ, and score strategies side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import hybrids, metrics, mining, packing, policies
from ..sources.corpus import table
from . import evaluation as E
from .evaluation import EVAL, FEATURES, FILE_METRICS, FLAGS, SPAN_METRICS, WASTE
from .registry import query

# ------------------------------------------------------------ paths and queries
PATH_FORMS = ("src/a.rs", "{repo}/src/a.rs", "{repo}/{repo}/src/a.rs", "tests/b.py", "other/src/a.rs", "Cargo.toml")
PREDICTED = """pr AS (SELECT doc_id AS task_id, source AS repo_id, replace(['src/a.rs', '{repo}/src/a.rs', '{repo}/{repo}/src/a.rs', 'tests/b.py', 'other/src/a.rs', 'Cargo.toml'][doc_id % 6 + 1], '{repo}', source) AS path FROM documents),
lb AS (SELECT doc_id AS task_id, CASE WHEN doc_id % 5 = 0 THEN 'tests/b.py' WHEN doc_id % 5 = 1 THEN source || '/src/a.rs' ELSE 'src/a.rs' END AS path FROM documents)"""


def _predicted(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    form = F.element_at(F.array(*map(F.lit, PATH_FORMS)), (F.col("doc_id") % 6 + 1).cast("int"))
    return d.select(F.col("doc_id").alias("task_id"), F.col("source").alias("repo_id"), F.replace(form, F.lit("{repo}"), F.col("source")).alias("path"))


@query(f"WITH {PREDICTED} SELECT pr.task_id, pr.path, pr.path = lb.path OR (repo_id <> '' AND pr.path = repo_id || '/' || lb.path) AS matched FROM pr JOIN lb USING (task_id)")
def repo_path_match(spark, sf_dir):
    five = F.col("doc_id") % 5
    label = F.when(five == 0, "tests/b.py").when(five == 1, F.concat("source", F.lit("/src/a.rs"))).otherwise("src/a.rs")
    labels = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("task_id"), label.alias("path"))
    return hybrids.path_matches(_predicted(spark, sf_dir), labels).select("task_id", "path", "matched")


@query(f"WITH {PREDICTED} SELECT task_id, CASE WHEN path IN ('tests/b.py', 'Cargo.toml') THEN 'risk_penalty' ELSE 'normal' END AS bucket FROM pr")
def risk_buckets(spark, sf_dir):
    return _predicted(spark, sf_dir).select("task_id", hybrids.risk_bucket(F.col("path")).alias("bucket"))


@query("""SELECT doc_id, trim(translate(text, ':/()"', '     ')) AS query, list_has_any(string_split(text, ' '), ['for', 'use', 'type', 'from']) AS has_keyword,
contains(text, '="') OR contains(text, '= ''') OR contains(text, '= "') AS assigns FROM documents""")
def query_repair(spark, sf_dir):
    text = F.col("text")
    wanted = F.exists(F.split(text, " "), lambda w: T.is_keyword(w) & w.isin("for", "use", "type", "from"))
    return table(spark, sf_dir, "documents").select("doc_id", T.sanitized_query(text).alias("query"), wanted.alias("has_keyword"), T.is_string_assignment(text).alias("assigns"))


# ------------------------------------------------------------ filters before vectors
ASKED = ("pytest fixture", "cargo build", "yaml keys", "plain words", "Parser of it")
CANDIDATES = """q AS (SELECT DISTINCT doc_id % 5 AS query_id, ['pytest fixture','cargo build','yaml keys','plain words','Parser of it'][doc_id % 5 + 1] AS query FROM documents),
cand AS (SELECT q.query_id, query, doc_id, ['src/a.py','tests/Test_b.py','src/c.rs','dist/d.js','e.toml','parser/f.go'][doc_id % 6 + 1] AS path, ['python','python','rust','javascript','other','go'][doc_id % 6 + 1] AS language, text
 FROM q JOIN documents ON doc_id % 5 = q.query_id)"""


def _candidates(spark, sf_dir) -> DataFrame:
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    return table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 5).alias("query_id"), pick(ASKED, 5).alias("query"), "doc_id",
        pick(("src/a.py", "tests/Test_b.py", "src/c.rs", "dist/d.js", "e.toml", "parser/f.go"), 6).alias("path"),
        pick(("python", "python", "rust", "javascript", "other", "go"), 6).alias("language"), "text",
    )


@query(f"""WITH {CANDIDATES}, w AS (SELECT *, CASE WHEN contains(lower(query), 'python') OR contains(lower(query), 'pytest') THEN 'python' WHEN contains(lower(query), 'rust') OR contains(lower(query), 'cargo') THEN 'rust'
 WHEN contains(query, 'config') OR contains(query, 'yaml') OR contains(query, 'toml') THEN 'config' END AS wanted, regexp_matches(lower(query), '\\b(test|spec|assert|pytest)\\b') AS wants_test FROM cand),
k AS (SELECT *, coalesce(language = wanted, true) AS in_language, contains(lower(path), 'test') = wants_test AS in_split FROM w),
a AS (SELECT *, bool_or(in_language) OVER (PARTITION BY query_id) AS any_language, bool_or(in_split) OVER (PARTITION BY query_id) AS any_split FROM k)
SELECT 'per_language' AS layout, query_id, doc_id FROM a WHERE in_language OR NOT any_language UNION ALL SELECT 'source_vs_test_split', query_id, doc_id FROM a WHERE in_split OR NOT any_split
UNION ALL SELECT 'generated_excluded', query_id, doc_id FROM a WHERE NOT contains(path, 'dist/') UNION ALL SELECT 'global_mixed_all', query_id, doc_id FROM a""")
def layout_filters(spark, sf_dir):
    pairs, out = _candidates(spark, sf_dir), None
    for layout in ("per_language", "source_vs_test_split", "generated_excluded", "global_mixed_all"):
        rows = hybrids.layout_filter(pairs, layout).select(F.lit(layout).alias("layout"), "query_id", "doc_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(f"""WITH {CANDIDATES} SELECT query_id, doc_id FROM cand WHERE len(list_filter(regexp_extract_all(lower(query), '[a-z_][a-z0-9_][a-z0-9_]+'), lambda t: contains(lower(path) || ' ' || lower(coalesce(text, '')), t))) > 0""")
def anchor_filtered(spark, sf_dir):
    return hybrids.anchor_filter(_candidates(spark, sf_dir)).select("query_id", "doc_id")


HYBRID = """noisy AS (SELECT task_id FROM fl WHERE marker OR common OR uuid OR vague OR fabricated),
af AS (SELECT task_id, path, kind FROM (SELECT task_id, path, kind, row_number() OVER (PARTITION BY task_id, kind ORDER BY min(turn * 100 + rank), path) AS n
 FROM (SELECT *, CASE strategy WHEN 'rrf' THEN 'fused' ELSE 'names' END AS kind, CASE strategy WHEN 'regex' THEN 1 ELSE 0 END AS turn FROM preds WHERE strategy <> 'bm25') GROUP BY task_id, path, kind) WHERE n <= 3),
dense AS (SELECT task_id, rank, path, start_line, end_line FROM preds WHERE strategy = 'bm25'), fused AS (SELECT task_id, rank, path, start_line, end_line FROM preds WHERE strategy = 'rrf'),
in_fused AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS rank, path, start_line, end_line FROM dense SEMI JOIN (FROM af WHERE kind = 'fused') USING (task_id, path)),
in_names AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS rank, path, start_line, end_line FROM dense SEMI JOIN (FROM af WHERE kind = 'names') USING (task_id, path)),
in_any AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY rank) AS rank, path, start_line, end_line FROM dense SEMI JOIN af USING (task_id, path)),
both_lists AS (SELECT 0 AS turn, * FROM fused UNION ALL SELECT 1, * FROM in_any),
sup AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY min(turn * 100 + rank), path, start_line, end_line) AS rank, path, start_line, end_line FROM both_lists SEMI JOIN (SELECT DISTINCT task_id FROM fused) USING (task_id) GROUP BY task_id, path, start_line, end_line),
late AS (SELECT task_id, row_number() OVER (PARTITION BY task_id ORDER BY round(sum(1.0::DOUBLE / (60 + rank)), 12) DESC, path, start_line, end_line) AS rank, path, start_line, end_line FROM both_lists GROUP BY task_id, path, start_line, end_line)"""


@query(f"""WITH {EVAL}, {FLAGS}, {HYBRID} SELECT 'only' AS strategy, * FROM dense UNION ALL SELECT 'in_fused_files', * FROM in_fused UNION ALL SELECT 'in_symbol_regex_files', * FROM in_names
UNION ALL SELECT 'supporting', * FROM sup WHERE rank <= 8 UNION ALL SELECT 'late_fusion', * FROM late WHERE rank <= 8 UNION ALL SELECT 'guarded', * FROM late ANTI JOIN noisy USING (task_id) WHERE rank <= 8""")
def hybrid_strategies(spark, sf_dir):
    q = F.col("query")
    noisy = E.tasks(spark, sf_dir).where(policies.is_negative_noise(q) | policies.is_vague(q) | policies.is_fabricated(q)).select("task_id")
    return hybrids.hybrid_strategies(E.predictions(spark, sf_dir), noisy, "bm25", top_k=8, files=3).withColumn("rank", F.col("rank").cast("long"))


# ------------------------------------------------------------ routes
@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, f AS (SELECT task_id, n_symbol AS s, n_regex AS r, CASE WHEN task_id % 3 = 0 THEN 2 ELSE 0 END AS g, density / 2.0 AS d, CASE WHEN task_id % 7 = 3 THEN 1.0 ELSE 0.0 END AS p, CASE WHEN task_id % 11 = 0 THEN 1.0 ELSE 0.0 END AS a FROM ft)
SELECT task_id, CASE WHEN s > 0 AND r > 0 THEN 'admit_primary' WHEN s > 0 THEN 'fallback_symbol_regex' WHEN r > 0 AND g > 0 AND d > 0.4 THEN 'admit_supporting' WHEN g > 0 AND r = 0 THEN 'weak_candidate_only' WHEN p > 0.5 OR a > 0 THEN 'abstain' WHEN r > 0 THEN 'weak_candidate_only' ELSE 'abstain' END AS action,
CASE WHEN s > 0 AND r > 0 THEN 'regex_symbol_agreement' WHEN s > 0 THEN 'symbol_anchor' WHEN r > 0 AND g > 0 AND d > 0.4 THEN 'regex_graph_identifier_support' WHEN g > 0 AND r = 0 THEN 'graph_only_supporting_not_primary' WHEN p > 0.5 OR a > 0 THEN 'proper_name_or_api_config_requires_anchor' WHEN r > 0 THEN 'regex_only_weak' ELSE 'no_anchor' END AS reason FROM f""")
def graph_admission(spark, sf_dir):
    c = F.col
    made = policies.task_features(E.tasks(spark, sf_dir), E.predictions(spark, sf_dir)).select(
        "task_id", c("n_symbol").alias("symbol_hits"), c("n_regex").alias("regex_hits"), F.when(c("task_id") % 3 == 0, 2).otherwise(0).alias("graph_hits"),
        (c("density") / 2).alias("identifier_density"), F.when(c("task_id") % 7 == 3, 1.0).otherwise(0.0).alias("proper_names"), F.when(c("task_id") % 11 == 0, 1.0).otherwise(0.0).alias("api_config"),
    )
    return policies.graph_admission(made)


TAGS = ("exact_symbol", "unique", "config", "hard_distractor", "ambiguous", "negative", "other")
BUCKETED = """bk AS (SELECT doc_id, [['exact_symbol','unique','config','hard_distractor','ambiguous','negative','other'][doc_id % 7 + 1], ['exact_symbol','unique','config','hard_distractor','ambiguous','negative','other'][(doc_id // 7) % 7 + 1]] AS t, n_chars >= 800 AS has FROM documents)"""


def _tagged(spark, sf_dir) -> DataFrame:
    names, d = F.array(*map(F.lit, TAGS)), table(spark, sf_dir, "documents")
    at = lambda n: F.element_at(names, (n % 7 + 1).cast("int"))
    return d.withColumn("tags", F.array(at(F.col("doc_id")), at(F.floor(F.col("doc_id") / 7))))


@query(f"""WITH {BUCKETED} SELECT doc_id AS task_id, CASE WHEN list_contains(t, 'exact_symbol') AND list_contains(t, 'unique') THEN 'candidate_baseline' WHEN list_has_any(t, ['exact_symbol', 'config']) AND has THEN 'llm_span_narrow'
 WHEN list_contains(t, 'ambiguous') THEN 'llm_filter' WHEN list_has_any(t, ['negative', 'hard_distractor']) THEN 'llm_abstain_filter' ELSE 'candidate_baseline' END AS route FROM bk""")
def bucket_routes(spark, sf_dir):
    rows = _tagged(spark, sf_dir).select(F.col("doc_id").alias("task_id"), "tags", (F.col("n_chars") >= 800).alias("has_candidates"))
    return policies.route_by_bucket(rows)


@query(f"""WITH {EVAL}, {BUCKETED}, c AS (SELECT strategy, task_id, rank, t, task_id % 4 AS m, has FROM preds JOIN bk ON doc_id = task_id), r AS (SELECT *, CASE WHEN rank > 3 THEN 'rank_above_5' WHEN task_id % 13 = 0 THEN 'negative_or_no_gold_bucket'
 WHEN list_has_any(t, ['negative', 'hard_distractor', 'ambiguous']) THEN 'dangerous_risk_tag' WHEN m = 0 THEN 'dangerous_subtype_regex_only' WHEN m = 1 AND NOT has THEN 'dangerous_subtype_agreement' WHEN m = 2 AND has THEN 'favorable_subtype'
 WHEN list_contains(t, 'unique') THEN 'symbol_anchor_support' WHEN list_contains(t, 'exact_symbol') THEN 'span_agreement_signal' ELSE 'conservative_fallback' END AS reason FROM c)
SELECT strategy, task_id, rank, reason IN ('favorable_subtype', 'symbol_anchor_support', 'span_agreement_signal') AS allowed, reason FROM r""")
def context_requests(spark, sf_dir):
    c, m = F.col, F.col("task_id") % 4
    tags = _tagged(spark, sf_dir).select(F.col("doc_id").alias("task_id"), "tags", (F.col("n_chars") >= 800).alias("has"))
    rows = E.predictions(spark, sf_dir).join(tags, "task_id").select(
        "strategy", "task_id", F.when(c("rank") > 3, c("rank") + 2).otherwise(c("rank")).alias("rank"), F.when(c("task_id") % 13 == 0, "no_gold").otherwise("positive").alias("bucket"), F.transform("tags", F.upper).alias("tags"),
        F.when(m == 0, "regex_only").when(m == 2, "symbol_regex_fusion").alias("source_class"),
        F.when((m == 1) & ~c("has"), "disagree").when((m == 2) & c("has"), "span_overlap").alias("agreement_class"), F.lit("rrf_yes").alias("rrf_backing"),
        F.array_contains("tags", "unique").alias("unique_symbol"), F.array_contains("tags", "exact_symbol").alias("agree_span"),
    )
    return policies.more_context(rows).select("strategy", "task_id", F.when(c("rank") > 5, c("rank") - 2).otherwise(c("rank")).alias("rank"), "allowed", "reason")


# ------------------------------------------------------------ packs and scores
@query(f"""WITH {EVAL}, it AS (SELECT 'pool' AS strategy, task_id, row_number() OVER (PARTITION BY task_id ORDER BY rank, strategy) AS rank, path FROM preds), od AS (SELECT DISTINCT task_id, path FROM preds WHERE strategy = 'bm25' AND rank <= 2),
m AS (SELECT it.*, od.path IS NULL AS novel, row_number() OVER (PARTITION BY it.task_id, it.path ORDER BY rank) = 1 AND od.path IS NULL AND rank > 5 AS fresh FROM it LEFT JOIN od USING (task_id, path)),
o AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY novel DESC, rank) AS nth, sum(fresh::INT) OVER (PARTITION BY task_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS added FROM m),
k AS (SELECT *, CASE WHEN nth <= 10 THEN nth ELSE 10 + rank END AS f, CASE WHEN rank <= 5 THEN rank WHEN fresh AND added <= 5 THEN 5 + added ELSE 10 + rank END AS g FROM o),
x AS (SELECT *, row_number() OVER (PARTITION BY task_id, f <= 8 ORDER BY g) AS pg, row_number() OVER (PARTITION BY task_id, g <= 3 ORDER BY f) AS pf FROM k),
s AS (SELECT task_id, count(*) FILTER (rank <= 5) - count(DISTINCT path) FILTER (rank <= 5) AS dup, count(*) FILTER (rank <= 5 AND novel) AS n5, count(*) FILTER (rank <= 5 AND NOT novel) AS o5, count(*) FILTER (rank <= 10 AND novel) AS n10, count(*) FILTER (novel) AS n FROM m GROUP BY task_id),
y AS (SELECT *, CASE WHEN f <= 8 THEN f WHEN pg <= 2 THEN 8 + pg ELSE 10 + rank END AS f8, CASE WHEN g <= 3 THEN g WHEN pf <= 7 THEN 3 + pf ELSE 10 + rank END AS g3, s.n > 10 AND n10 >= 8 AS deep FROM x JOIN s USING (task_id)),
z AS (SELECT strategy, task_id, rank, unnest(['full8_guard2','guard3_full7','dup_guard','novel_top5_guard','keep_top5_guard','deep_full8','deep_full','dup_or_few_novel_guard']) AS rule,
 unnest([f8, g3, CASE WHEN dup > 0 THEN g ELSE f END, CASE WHEN n5 >= 4 THEN g ELSE f END, CASE WHEN dup > 0 OR o5 > 0 THEN g ELSE f END, CASE WHEN deep THEN f8 ELSE g END, CASE WHEN deep THEN f ELSE g END, CASE WHEN dup > 0 OR n5 <= 2 THEN g ELSE f END]) AS place FROM y)
SELECT rule, strategy, task_id, rank, row_number() OVER (PARTITION BY task_id, rule ORDER BY place, rank) AS new_rank FROM z""")
def difference_packs(spark, sf_dir):
    p = E.predictions(spark, sf_dir)
    pool = p.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy("rank", "strategy")).cast("long")).withColumn("strategy", F.lit("pool"))
    old = p.where("strategy = 'bm25' AND rank <= 2").withColumn("strategy", F.lit("pool"))
    return packing.difference_aware(pool, old).withColumn("new_rank", F.col("new_rank").cast("long"))


@query(f"""WITH {EVAL}, jd AS (SELECT doc_id AS task_id FROM documents WHERE doc_id % 3 > 0), pl AS (SELECT DISTINCT strategy, task_id, path, unnest(range(start_line, end_line + 1)) AS l FROM preds SEMI JOIN jd USING (task_id) WHERE rank <= 4),
gl AS (SELECT DISTINCT task_id, path, unnest(range(start_line, end_line + 1)) AS l FROM gold), np AS (SELECT strategy, task_id, count(*) AS np, count(gl.l) AS nb FROM pl LEFT JOIN gl USING (task_id, path, l) GROUP BY ALL), ng AS (SELECT task_id, count(*) AS ng FROM gl GROUP BY ALL)
SELECT strategy, round(avg(coalesce(nb / np, 0)), 6) AS line_precision, round(avg(CASE WHEN ng IS NULL THEN 1 ELSE coalesce(nb, 0) / ng END), 6) AS line_recall
FROM (SELECT DISTINCT strategy, task_id FROM preds SEMI JOIN jd USING (task_id)) LEFT JOIN np USING (strategy, task_id) LEFT JOIN ng USING (task_id) GROUP BY strategy""")
def first_line_scores(spark, sf_dir):
    judged = table(spark, sf_dir, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("task_id"))
    got = metrics.line_scores(E.predictions(spark, sf_dir), E.gold(spark, sf_dir), judged, 4)
    return E._r(got, "line_precision", "line_recall")


@query(f"""WITH {EVAL}, pl AS (SELECT DISTINCT strategy, task_id, path, unnest(range(start_line, end_line + 1)) AS l FROM preds SEMI JOIN gt USING (task_id)), ad AS (FROM pl SELECT * WHERE strategy <> 'rrf' AND (task_id, path, l) NOT IN (SELECT (task_id, path, l) FROM pl WHERE strategy = 'rrf')),
gl AS (SELECT DISTINCT task_id, path, unnest(range(start_line, end_line + 1)) AS l FROM gold), pt AS (SELECT strategy, task_id, count(gl.l) AS good, count(*) - count(gl.l) AS bad FROM ad LEFT JOIN gl USING (task_id, path, l) GROUP BY ALL)
SELECT strategy, sum(good)::BIGINT AS added_gold, sum(bad)::BIGINT AS added_false, count(*) AS n_tasks, count(*) FILTER (bad > good) AS n_blocked, sum(bad) > sum(good) AS blocked FROM pt GROUP BY strategy""")
def span_contribution(spark, sf_dir):
    return metrics.span_contribution(E.predictions(spark, sf_dir), E.gold(spark, sf_dir), "rrf")


@query(f"""WITH {EVAL} SELECT strategy, round(avg((task_id % 4 IN (1, 3))::INT), 6) AS pollution FROM preds GROUP BY strategy""")
def path_pollution(spark, sf_dir):
    kind = F.col("task_id") % 4
    path = F.when(kind == 1, "docs/a.md").when(kind == 3, F.lit("x\\target\\b.rs")).when(kind == 2, "src/docs.rs").otherwise("src/c.rs")
    return E._r(metrics.path_pollution(E.predictions(spark, sf_dir).withColumn("path", path), ["docs/", "target/", "fixtures/"]), "pollution")


_RECALLS = ", ".join(f"max(CASE WHEN file_hit AND rank <= {k} THEN 1 ELSE 0 END) AS h{k}" for k in (1, 3, 5))


@query(f"""WITH {EVAL}, {FILE_METRICS}, {SPAN_METRICS}, {WASTE}, hk AS (SELECT strategy, task_id, {_RECALLS} FROM hits GROUP BY ALL), rc AS (SELECT strategy, avg(coalesce(h1, 0)) AS recall_1, avg(coalesce(h3, 0)) AS recall_3, avg(coalesce(h5, 0)) AS recall_5 FROM gt CROSS JOIN strategies LEFT JOIN hk USING (strategy, task_id) GROUP BY strategy),
e AS (SELECT strategy, coalesce(n, 0) AS n, task_id IN (SELECT task_id FROM gt) AS has FROM tasks CROSS JOIN strategies LEFT JOIN (SELECT strategy, task_id, count(*) AS n FROM preds GROUP BY ALL) USING (strategy, task_id)),
ne AS (SELECT strategy, avg(CASE WHEN NOT has THEN (n > 0)::INT END) AS no_gold_nonempty, avg((n = 0)::INT) AS abstain_rate, avg(n) AS avg_candidates FROM e GROUP BY strategy),
al AS (SELECT *, token_waste - (SELECT token_waste FROM tw WHERE strategy = 'rrf') AS waste_delta FROM rc JOIN fm USING (strategy) JOIN sf USING (strategy) JOIN tw USING (strategy) JOIN ne USING (strategy))
SELECT strategy, {E._rs('recall_1', 'recall_3', 'recall_5', 'mrr', 'span_precision', 'span_recall', 'span_f', 'token_waste', 'no_gold_nonempty', 'abstain_rate', 'avg_candidates', 'waste_delta')} FROM al""")
def score_matrix(spark, sf_dir):
    got = metrics.score_matrix(E.predictions(spark, sf_dir), E.gold(spark, sf_dir), E.tasks(spark, sf_dir), "rrf")
    return E._r(got, *[c for c in got.columns if c != "strategy"])


# ------------------------------------------------------------ mined features
LINKS = """links AS (SELECT page_id, i, 'page/' || page_id AS path, substring(h, 2) AS name, page_id * 1000000 + i AS place FROM (SELECT page_id, unnest(hs) AS h, unnest(range(1, len(hs) + 1)) AS i FROM
 (SELECT page_id, regexp_extract_all(html, 'href="(/[^"]*)"', 1) AS hs FROM pages)) WHERE len(h) > 4)"""


def _links(spark, sf_dir) -> DataFrame:
    """The link targets of pages in order: place, path, name."""
    hrefs = table(spark, sf_dir, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("i", "h"))
    return hrefs.where(F.length("h") > 4).select((F.col("page_id") * 1000000 + F.col("i") + 1).alias("place"), F.concat(F.lit("page/"), "page_id").alias("path"), F.expr("substring(h, 2)").alias("name"))


@query(f"""WITH {LINKS}, names AS (SELECT DISTINCT lower(name) AS low FROM links), alike AS (SELECT a.low AS a, b.low AS b FROM names a JOIN names b ON contains(a.low, b.low) OR contains(b.low, a.low)),
c AS (SELECT s.place, t.place AS negative, 'same_file' AS kind FROM links s JOIN links t ON s.path = t.path AND s.name <> t.name
 UNION ALL SELECT s.place, t.place, 'similar_name' FROM links s JOIN alike ON lower(s.name) = a JOIN links t ON lower(t.name) = b AND s.path <> t.path)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY kind, negative) AS rank FROM c) WHERE rank <= 8""")
def hard_negatives(spark, sf_dir):
    """Eight hard negatives of each link target, taken as a symbol of its page."""
    return mining.hard_negatives(_links(spark, sf_dir), 8).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH {LINKS}, tasks AS (SELECT item_id AS task_id, text AS query FROM benchmark), toks AS (SELECT DISTINCT task_id, lower(unnest(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]{{2,}}'))) AS token FROM tasks),
g AS (SELECT DISTINCT task_id, path, place FROM links JOIN toks ON contains(path || chr(10) || lower(name), token)),
gs AS (SELECT task_id, count(*) AS n FROM g GROUP BY task_id), gp AS (SELECT task_id, string_agg(path, ',' ORDER BY path) AS paths FROM (SELECT DISTINCT task_id, path FROM g QUALIFY dense_rank() OVER (PARTITION BY task_id ORDER BY path) <= 5) GROUP BY task_id),
r AS (SELECT task_id, count(DISTINCT page_id) AS n FROM pages JOIN toks ON contains(lower('page/' || page_id || chr(10) || html), token) GROUP BY task_id),
ph AS (SELECT task_id, count(DISTINCT page_id) AS n FROM pages JOIN toks ON contains('page/' || page_id, token) GROUP BY task_id),
sy AS (SELECT task_id, count(DISTINCT place) AS n FROM links JOIN toks ON contains(lower(name), token) OR contains(token, lower(name)) GROUP BY task_id),
f AS (SELECT task_id, coalesce(gs.n, 0) AS graph_hits, coalesce(paths, '') AS support_paths, coalesce(r.n, 0) AS regex_hits, least(1.0, coalesce(ph.n, 0) / 3.0)::DOUBLE AS path_score, coalesce(sy.n, 0) AS symbol_hits, 1.0::DOUBLE AS d,
 len(list_filter(regexp_extract_all(query, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: regexp_matches(t, '^[A-Z]'))) / (SELECT greatest(1, count(*)) FROM toks WHERE toks.task_id = tasks.task_id)::DOUBLE AS p, regexp_matches(query, '(?i)\b(api|config|key|route|handler|timeout)\b') AS a
 FROM tasks LEFT JOIN gs USING (task_id) LEFT JOIN gp USING (task_id) LEFT JOIN r USING (task_id) LEFT JOIN ph USING (task_id) LEFT JOIN sy USING (task_id))
SELECT task_id, graph_hits, support_paths, regex_hits, path_score, symbol_hits, CASE WHEN symbol_hits > 0 AND regex_hits > 0 THEN 'admit_primary' WHEN symbol_hits > 0 THEN 'fallback_symbol_regex' WHEN regex_hits > 0 AND graph_hits > 0 AND d > 0.4 THEN 'admit_supporting' WHEN graph_hits > 0 AND regex_hits = 0 THEN 'weak_candidate_only' WHEN p > 0.5 OR a THEN 'abstain' WHEN regex_hits > 0 THEN 'weak_candidate_only' ELSE 'abstain' END AS action FROM f""")
def mined_admission(spark, sf_dir):
    """Graph-aware admission on features mined from pages and their links."""
    tasks = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("task_id"), F.col("text").alias("query"))
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), "page_id").alias("path"), F.col("html").alias("content"))
    links = _links(spark, sf_dir)
    graph = mining.graph_support(tasks, links.select(F.lit("LINKS").alias("edge"), F.col("path").alias("src"), F.col("name").alias("dst")))
    features = mining.lexical_features(tasks, pages, links).join(graph, "task_id").withColumn("graph_hits", F.col("support_count"))
    action = policies.graph_admission(features).select("task_id", "action")
    return features.join(action, "task_id").select("task_id", "graph_hits", F.array_join("support_paths", ",").alias("support_paths"), "regex_hits", "path_score", "symbol_hits", "action")
