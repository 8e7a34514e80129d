"""Evaluation queries: metrics, reach, guards, packing and statistics.

Tasks, predictions and gold spans are derived from the documents and labels by
arithmetic, the same in Spark and in SQL, over all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metrics, packing, policies, stats
from ..sources.corpus import table
from .registry import query

STRATEGIES = ("bm25", "regex", "symbol", "rrf")


def _pick(values: tuple, index) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """task_id, repo_id, bucket, query, task_type."""
    d = table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 7
    text = (
        F.when(kind == 0, F.concat(F.lit("fake thing "), "doc_id")).when(kind == 1, "error handler")
        .when(kind == 2, F.concat(F.lit("quantum_state_"), "source")).when(kind == 3, F.concat(F.lit("Parser"), "doc_id"))
        .when(kind == 4, F.concat(F.lit("load_"), "source")).when(kind == 5, F.concat(F.lit("data "), "source", F.lit(" x"))).otherwise("where is the long description of this")
    )
    types = ("exact_symbol", "config_import", "stress", "negative", "provider_ish", "implementation_search", "other")
    return d.select(F.col("doc_id").alias("task_id"), F.col("source").alias("repo_id"), F.col("lang").alias("bucket"), text.alias("query"), _pick(types, kind).alias("task_type"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = d.agg(F.count("*").alias("n"))
    s, r, doc = F.col("s"), F.col("rank"), F.col("doc_id")
    spread = d.select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("s")).select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("rank"))
    found = spread.where(((s != 1) | (F.col("n_chars") >= 800)) & ((s != 2) | (F.col("n_chars") >= 1600))).crossJoin(F.broadcast(n))
    c = (doc + r * _pick((2, 3, 4, 1), s) + doc % _pick((1, 3, 5, 2), s)) % F.col("n")
    score = F.when(s == 3, 1.0 / (60 + r)).otherwise(10.0 / (r + s))
    return found.select(
        _pick(STRATEGIES, s).alias("strategy"), doc.alias("task_id"), r.cast("long").alias("rank"), F.concat(F.lit("doc/"), c).alias("path"),
        (c % 17 + 1).alias("start_line"), (c % 17 + 1 + (doc + r) % 9).alias("end_line"), score.alias("score"),
    )


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    n = d.agg(F.count("*").alias("n"))
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    g, doc = F.col("g"), F.col("doc_id")
    return d.join(good, "doc_id").crossJoin(F.broadcast(n)).withColumn("g", (doc + 4) % F.col("n")).select(
        doc.alias("task_id"), F.concat(F.lit("doc/"), g).alias("path"), (g % 17 + 1 + doc % 3).alias("start_line"), (g % 17 + 6 + doc % 3).alias("end_line")
    )


EVAL = """n AS (SELECT count(*) AS n FROM documents),
tasks AS (SELECT doc_id AS task_id, source AS repo_id, lang AS bucket, CASE doc_id % 7 WHEN 0 THEN 'fake thing ' || doc_id WHEN 1 THEN 'error handler' WHEN 2 THEN 'quantum_state_' || source WHEN 3 THEN 'Parser' || doc_id
 WHEN 4 THEN 'load_' || source WHEN 5 THEN 'data ' || source || ' x' ELSE 'where is the long description of this' END AS query,
 ['exact_symbol','config_import','stress','negative','provider_ish','implementation_search','other'][doc_id % 7 + 1] AS task_type FROM documents),
preds AS (SELECT ['bm25','regex','symbol','rrf'][s + 1] AS strategy, doc_id AS task_id, r AS rank, 'doc/' || c AS path, c % 17 + 1 AS start_line, c % 17 + 1 + (doc_id + r) % 9 AS end_line,
 CASE WHEN s = 3 THEN 1.0::DOUBLE / (60 + r) ELSE 10.0::DOUBLE / (r + s) END AS score
 FROM (SELECT doc_id, s, r, n_chars, (doc_id + r * [2,3,4,1][s + 1] + doc_id % [1,3,5,2][s + 1]) % n AS c FROM documents, n, range(0, 4) a(s), range(1, 6) b(r))
 WHERE (s <> 1 OR n_chars >= 800) AND (s <> 2 OR n_chars >= 1600)),
gold AS (SELECT doc_id AS task_id, 'doc/' || g AS path, g % 17 + 1 + doc_id % 3 AS start_line, g % 17 + 6 + doc_id % 3 AS end_line FROM (SELECT doc_id, (doc_id + 4) % n AS g FROM documents, n)
 WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
strategies AS (SELECT DISTINCT strategy FROM preds), gt AS (SELECT DISTINCT task_id FROM gold),
hits AS (SELECT p.strategy, p.task_id, p.rank, p.path, p.start_line, p.end_line, bool_or(g.path IS NOT NULL) AS file_hit, bool_or(coalesce(p.start_line <= g.end_line AND g.start_line <= p.end_line, false)) AS span_hit
 FROM preds p LEFT JOIN gold g ON p.task_id = g.task_id AND p.path = g.path GROUP BY ALL)"""
FILE_METRICS = """per AS (SELECT strategy, task_id, max(CASE WHEN file_hit AND rank <= 10 THEN 1 ELSE 0 END) AS hit, count(DISTINCT CASE WHEN file_hit AND rank <= 10 THEN path END) / count(DISTINCT CASE WHEN rank <= 10 THEN path END) AS prec,
 min(CASE WHEN file_hit THEN rank END) AS first FROM hits GROUP BY ALL),
fm AS (SELECT strategy, avg(coalesce(hit, 0)) AS file_recall, avg(coalesce(prec, 0)) AS file_precision, avg(coalesce(1.0 / first, 0)) AS mrr FROM gt CROSS JOIN strategies LEFT JOIN per USING (strategy, task_id) GROUP BY strategy)"""
SPAN_METRICS = """pl AS (SELECT DISTINCT strategy, task_id, path, unnest(range(start_line, end_line + 1)) AS l FROM preds WHERE rank <= 10), gl AS (SELECT DISTINCT task_id, path, unnest(range(start_line, end_line + 1)) AS l FROM gold),
sm AS (SELECT strategy, avg(coalesce(nb / np, 0)) AS span_precision, avg(coalesce(nb, 0) / ng) AS span_recall FROM gt CROSS JOIN strategies LEFT JOIN (SELECT strategy, task_id, count(*) AS np FROM pl GROUP BY ALL) USING (strategy, task_id)
 LEFT JOIN (SELECT strategy, pl.task_id, count(*) AS nb FROM pl JOIN gl USING (task_id, path, l) GROUP BY ALL) USING (strategy, task_id) JOIN (SELECT task_id, count(*) AS ng FROM gl GROUP BY ALL) USING (task_id) GROUP BY strategy),
sf AS (SELECT *, CASE WHEN span_precision + span_recall = 0 THEN 0 ELSE 1.25 * span_precision * span_recall / (0.25 * span_precision + span_recall) END AS span_f FROM sm)"""
WASTE = """tw AS (SELECT strategy, avg(coalesce(waste, 0)) AS token_waste FROM gt CROSS JOIN strategies LEFT JOIN (SELECT strategy, task_id, sum(CASE WHEN gl.l IS NULL THEN 1 ELSE 0 END) / count(*) AS waste
 FROM (SELECT strategy, task_id, path, unnest(range(start_line, end_line + 1)) AS l FROM preds WHERE rank <= 10) q LEFT JOIN gl USING (task_id, path, l) GROUP BY ALL) USING (strategy, task_id) GROUP BY strategy)"""


def _r(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in columns})


def _rs(*columns: str) -> str:
    return ", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in columns)


def _pg(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return predictions(spark, sf_dir), gold(spark, sf_dir)


@query(f"WITH {EVAL}, {FILE_METRICS} SELECT strategy, {_rs('file_recall', 'file_precision', 'mrr')} FROM fm")
def file_recall_mrr(spark, sf_dir):
    return _r(metrics.file_metrics(*_pg(spark, sf_dir)), "file_recall", "file_precision", "mrr")


@query(f"WITH {EVAL}, {SPAN_METRICS} SELECT strategy, {_rs('span_precision', 'span_recall', 'span_f')} FROM sf")
def span_prf(spark, sf_dir):
    return _r(metrics.span_metrics(*_pg(spark, sf_dir)), "span_precision", "span_recall", "span_f")


@query(f"WITH {EVAL}, {SPAN_METRICS}, {WASTE} SELECT strategy, {_rs('token_waste')} FROM tw")
def token_waste(spark, sf_dir):
    return _r(metrics.token_waste(*_pg(spark, sf_dir)), "token_waste")


@query(f"WITH {EVAL} SELECT strategy, round(avg(CASE WHEN file_hit THEN CASE WHEN span_hit THEN 0.0 ELSE 1.0 END END), 6) AS wrong_span_rate, round(avg(CASE WHEN span_hit THEN 0.0 ELSE 1.0 END), 6) AS zero_overlap_rate FROM hits SEMI JOIN gt USING (task_id) GROUP BY strategy")
def span_errors(spark, sf_dir):
    return _r(metrics.span_errors(*_pg(spark, sf_dir)), "wrong_span_rate", "zero_overlap_rate")


@query(f"""WITH {EVAL}, e AS (SELECT strategy, task_id, coalesce(n, 0) AS n, gt.task_id IS NOT NULL AS has FROM tasks CROSS JOIN strategies LEFT JOIN (SELECT strategy, task_id, count(*) AS n FROM preds GROUP BY ALL) USING (strategy, task_id) LEFT JOIN gt USING (task_id))
SELECT strategy, round(avg(CASE WHEN NOT has THEN (n > 0)::INT END), 6) AS no_gold_nonempty, round(avg((n = 0)::INT), 6) AS abstain_rate, round(avg(n), 6) AS avg_candidates FROM e GROUP BY strategy""".replace("gt.task_id IS NOT NULL AS has", "task_id IN (SELECT task_id FROM gt) AS has").replace(" LEFT JOIN gt USING (task_id))", ")"))
def abstain_false_primary(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    return _r(metrics.negative_rates(p, tasks(spark, sf_dir), g), "no_gold_nonempty", "abstain_rate", "avg_candidates")


@query(f"""WITH {EVAL}, bad AS (SELECT task_id, 'doc/' || ((task_id + 6) % n) AS path, 1 AS gs, 12 AS ge FROM (SELECT doc_id AS task_id FROM labels WHERE toxic = 1), n),
h AS (SELECT p.strategy, p.task_id, p.rank, bool_or(p.start_line <= ge AND gs <= p.end_line) AS hit FROM preds p JOIN bad b ON p.task_id = b.task_id AND p.path = b.path GROUP BY ALL), t AS (SELECT count(DISTINCT task_id) AS total FROM bad)
SELECT strategy, round(sum(CASE WHEN hit THEN 1 ELSE 0 END) / any_value(total), 6) AS per_item, round(count(DISTINCT CASE WHEN hit THEN task_id END) / any_value(total), 6) AS per_task FROM (SELECT s.strategy, h.task_id, coalesce(h.hit, false) AS hit FROM strategies s LEFT JOIN h USING (strategy)), t GROUP BY strategy""")
def hard_distractors(spark, sf_dir):
    n = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    bad = table(spark, sf_dir, "labels").where("toxic = 1").crossJoin(F.broadcast(n)).select(
        F.col("doc_id").alias("task_id"), F.concat(F.lit("doc/"), (F.col("doc_id") + 6) % F.col("n")).alias("path"), F.lit(1).alias("start_line"), F.lit(12).alias("end_line"))
    return _r(metrics.distractor_rate(predictions(spark, sf_dir), bad), "per_item", "per_task")


@query(f"""WITH {EVAL}, k AS (SELECT task_id, bool_or(strategy = 'bm25' AND file_hit) AS b, bool_or(strategy = 'symbol' AND file_hit) AS g FROM hits GROUP BY ALL)
SELECT round(count(*) FILTER (b AND NOT g) / nullif(count(*) FILTER (b), 0), 6) AS kill_rate FROM k""")
def guard_kill_rate(spark, sf_dir):
    return _r(metrics.kill_rate(*_pg(spark, sf_dir), "bm25", "symbol"), "kill_rate")


@query(f"WITH {EVAL}, {FILE_METRICS} SELECT strategy, bucket, count(*) AS n_tasks, round(avg(coalesce(hit, 0)), 6) AS file_recall, round(avg(coalesce(1.0 / first, 0)), 6) AS mrr FROM gt CROSS JOIN strategies LEFT JOIN per USING (strategy, task_id) JOIN tasks USING (task_id) GROUP BY strategy, bucket")
def bucket_metrics(spark, sf_dir):
    return _r(metrics.bucket_metrics(*_pg(spark, sf_dir), tasks(spark, sf_dir), "bucket"), "file_recall", "mrr")


def _scores(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    return metrics.file_metrics(p, g).join(metrics.span_metrics(p, g), "strategy").join(metrics.token_waste(p, g), "strategy")


@query(f"WITH {EVAL}, {FILE_METRICS}, {SPAN_METRICS} SELECT strategy, round(file_recall + 0.25 * mrr + 0.5 * span_f - CASE WHEN file_recall = 0 THEN 0.25 ELSE 0 END, 6) AS utility FROM fm JOIN sf USING (strategy)")
def utility_proxy(spark, sf_dir):
    return _r(metrics.utility(_scores(spark, sf_dir)), "utility").select("strategy", "utility")


@query(f"WITH {EVAL}, {FILE_METRICS} SELECT strategy, round(mrr - (SELECT mrr FROM fm WHERE strategy = 'rrf'), 6) AS delta_mrr, round(file_recall - (SELECT file_recall FROM fm WHERE strategy = 'rrf'), 6) AS delta_file_recall FROM fm")
def delta_vs_baseline(spark, sf_dir):
    return _r(metrics.deltas(metrics.file_metrics(*_pg(spark, sf_dir)), "rrf", ["mrr", "file_recall"]), "delta_mrr", "delta_file_recall")


@query(f"""WITH {EVAL}, {FILE_METRICS}, {SPAN_METRICS}, {WASTE}, pts AS (SELECT strategy, round(mrr, 6) AS mrr, round(token_waste, 6) AS token_waste FROM fm JOIN tw USING (strategy))
SELECT strategy FROM pts a WHERE NOT EXISTS (SELECT 1 FROM pts b WHERE b.mrr >= a.mrr AND b.token_waste <= a.token_waste AND (b.mrr > a.mrr OR b.token_waste < a.token_waste))""")
def pareto_frontier(spark, sf_dir):
    return metrics.pareto(_r(_scores(spark, sf_dir), "mrr", "token_waste"), ["mrr"], ["token_waste"]).select("strategy")


@query(f"""WITH {EVAL}, {FILE_METRICS}, {SPAN_METRICS}, {WASTE} SELECT strategy, token_waste <= 0.97 AS eligible FROM fm JOIN tw USING (strategy) ORDER BY eligible DESC, round(mrr, 6) DESC, round(token_waste, 6), strategy LIMIT 1""")
def select_candidate(spark, sf_dir):
    got = policies.select_candidate(_r(_scores(spark, sf_dir), "mrr", "token_waste"), {"token_waste": 0.97})
    return got.select("strategy", "eligible")


REACH = "rc AS (SELECT strategy, task_id, coalesce(bool_or(file_hit), false) AS fr, coalesce(bool_or(span_hit), false) AS sr FROM gt CROSS JOIN strategies LEFT JOIN hits USING (strategy, task_id) GROUP BY ALL)"


@query(f"WITH {EVAL}, {REACH} SELECT strategy, count(*) FILTER (fr) AS n_reached, count(*) FILTER (fr AND k = 1) AS n_unique FROM (SELECT *, sum(fr::INT) OVER (PARTITION BY task_id) AS k FROM rc) GROUP BY strategy")
def reach_unique(spark, sf_dir):
    return metrics.unique_reach(metrics.reach(*_pg(spark, sf_dir)))


@query(f"""WITH {EVAL}, {REACH}, y AS (SELECT task_id, strategy FROM rc WHERE fr), c AS (SELECT strategy, count(*) AS n FROM y GROUP BY ALL),
b AS (SELECT p.strategy AS a, q.strategy AS b, count(*) AS n_both FROM y p JOIN y q ON p.task_id = q.task_id AND p.strategy < q.strategy GROUP BY ALL)
SELECT a, b, n_both, ca.n + cb.n - n_both AS n_any, round(n_both / (ca.n + cb.n - n_both), 6) AS jaccard FROM b JOIN c ca ON ca.strategy = a JOIN c cb ON cb.strategy = b""")
def reach_pairwise(spark, sf_dir):
    return _r(metrics.pairwise_overlap(metrics.reach(*_pg(spark, sf_dir))), "jaccard")


@query(f"""WITH {EVAL}, {REACH}, o AS (SELECT * FROM (VALUES ('rrf', 1), ('bm25', 2), ('symbol', 3), ('regex', 4)) t(strategy, place)), f AS (SELECT task_id, min(place) AS place FROM rc JOIN o USING (strategy) WHERE fr GROUP BY ALL)
SELECT strategy, place::BIGINT AS place, count(f.task_id) AS gain FROM o LEFT JOIN f USING (place) GROUP BY ALL""")
def reach_marginal(spark, sf_dir):
    return metrics.marginal_gain(metrics.reach(*_pg(spark, sf_dir)), ["rrf", "bm25", "symbol", "regex"])


@query(f"""WITH {EVAL}, o AS (SELECT task_id, min(rank) AS r, bool_or(file_hit) AS f, bool_or(span_hit) AS s FROM hits WHERE strategy = 'symbol' GROUP BY ALL)
SELECT CASE WHEN r IS NULL THEN 'no_pool' WHEN r > 5 THEN 'none_shallow' WHEN NOT f THEN 'no_gold_file' WHEN NOT s THEN 'file_without_span' ELSE 'span_reached' END AS bucket, count(*) AS n_tasks FROM gt LEFT JOIN o USING (task_id) GROUP BY 1""")
def failure_funnel(spark, sf_dir):
    return metrics.failure_funnel(*_pg(spark, sf_dir), "symbol")


@query(f"""WITH {EVAL}, t AS (SELECT strategy, k, task_id, bool_or(file_hit) AS f, bool_or(span_hit) AS s, sum(end_line - start_line + 1) AS n FROM hits SEMI JOIN gt USING (task_id), (VALUES (1), (3), (5)) v(k) WHERE rank <= k GROUP BY ALL)
SELECT strategy, k, count(*) FILTER (f) AS file_reach, count(*) FILTER (s) AS span_reach, round(avg(n), 6) AS avg_lines FROM t GROUP BY ALL""")
def reach_cost_map(spark, sf_dir):
    return _r(metrics.reach_cost(*_pg(spark, sf_dir), [1, 3, 5]), "avg_lines")


@query(f"WITH {EVAL} SELECT task_id FROM tasks WHERE task_id NOT IN (SELECT task_id FROM gt) AND task_id IN (SELECT task_id FROM preds WHERE strategy = 'regex') AND task_id IN (SELECT task_id FROM preds WHERE strategy = 'rrf')")
def inherited_false_positives(spark, sf_dir):
    p, g = _pg(spark, sf_dir)
    return metrics.inherited_false_positives(p, tasks(spark, sf_dir), g, "regex", "rrf")


# ----------------------------------------------------------- query text, routes
MARKERS = "(" + " OR ".join(f"contains(lower(trim(query)), '{m.lower()}')" for m in policies.NOISE_MARKERS) + ")"
COMMON = "(" + ", ".join(f"'{w}'" for w in policies.COMMON_WORDS) + ")"
FABRICATED = "(" + ", ".join(f"'{w}'" for w in policies.FABRICATED) + ")"
TOKS = "list_filter(string_split_regex(trim(query), '\\s+'), lambda t: t <> '')"
FLAGS = f"""fl AS (SELECT *, {MARKERS} AS marker, lower(trim(query)) IN {COMMON} AS common, regexp_matches(trim(query), '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS uuid,
 contains(trim(query), ' ') AND len({TOKS}) >= 2 AND len(list_filter({TOKS}, lambda t: lower(t) NOT IN {COMMON})) = 0 AS vague,
 NOT contains(trim(query), ' ') AND contains(query, '_') AND len(list_filter(string_split(trim(query), '_'), lambda p: p <> '')) >= 3 AND len(list_filter(string_split(trim(query), '_'), lambda p: lower(p) IN {FABRICATED})) > 0 AS fabricated,
 length(trim(query)) <= 80 AND NOT contains(trim(query), ' ') AND ((regexp_matches(trim(query), '^[A-Z][a-zA-Z0-9]*$') AND length(trim(query)) > 2) OR (contains(query, '_') AND regexp_matches(trim(query), '^[a-z][a-z0-9_]*$') AND length(trim(query)) > 2) OR contains(query, '::')) AS exact,
 len(list_filter({TOKS}, lambda t: regexp_matches(t, '^[A-Za-z_][A-Za-z0-9_:.]*$') AND lower(t) NOT IN {COMMON})) AS density, len({TOKS}) AS n_toks FROM tasks)"""


@query(f"WITH {EVAL}, {FLAGS} SELECT task_id, (CASE WHEN marker OR common OR uuid THEN 2 ELSE 0 END + CASE WHEN vague THEN 2 ELSE 0 END + CASE WHEN fabricated THEN 1 ELSE 0 END + CASE WHEN marker THEN 1 ELSE 0 END + CASE WHEN n_toks = 1 AND common THEN 1 ELSE 0 END + CASE WHEN uuid THEN 1 ELSE 0 END) AS noise, density, exact FROM fl")
def query_noise(spark, sf_dir):
    q = F.col("query")
    return tasks(spark, sf_dir).select("task_id", policies.noise_score(q).alias("noise"), policies.identifier_density(q).cast("long").alias("density"), policies.is_exact_identifier(q).alias("exact"))


COUNTS = "cn AS (SELECT task_id, count(*) FILTER (strategy = 'regex') AS n_regex, count(*) FILTER (strategy = 'symbol') AS n_symbol, count(*) FILTER (strategy = 'rrf') AS n_rrf FROM preds GROUP BY ALL)"


@query(f"""WITH {EVAL}, {FLAGS}, {COUNTS} SELECT task_id, CASE WHEN marker OR common OR uuid OR fabricated OR vague THEN 'empty' WHEN exact THEN CASE WHEN n_symbol > 0 THEN 'symbol' WHEN n_regex > 0 THEN 'regex' WHEN n_rrf > 0 THEN 'rrf' ELSE 'empty' END
 WHEN density BETWEEN 1 AND 2 AND n_toks <= 3 THEN CASE WHEN n_regex > 0 THEN 'regex' WHEN n_symbol > 0 THEN 'symbol' WHEN n_rrf > 0 THEN 'rrf' ELSE 'empty' END WHEN n_rrf > 0 THEN 'rrf' ELSE 'empty' END AS method,
 CASE WHEN marker OR common OR uuid THEN 'negative_noise_guard' WHEN fabricated THEN 'compound_snake_case_noise_guard' WHEN vague THEN 'vague_multi_word_guard' WHEN exact THEN 'exact_identifier_prefer_symbol' WHEN density BETWEEN 1 AND 2 AND n_toks <= 3 THEN 'identifier_tokens_prefer_regex' ELSE 'default_rrf_recall' END AS decision
 FROM fl LEFT JOIN cn USING (task_id)""")
def route_query_only(spark, sf_dir):
    flags = policies.channel_flags(tasks(spark, sf_dir), predictions(spark, sf_dir), ["regex", "symbol", "rrf"])
    return policies.route_by_query(flags)


@query(f"""WITH {EVAL}, {COUNTS} SELECT task_id, CASE WHEN task_type IN ('negative', 'provider_ish') THEN 'empty' WHEN task_type = 'stress' THEN CASE WHEN n_symbol > 0 THEN 'symbol' WHEN n_regex > 0 THEN 'regex' ELSE 'empty' END
 WHEN task_type IN ('exact_symbol', 'implementation_search') THEN CASE WHEN n_symbol > 0 THEN 'symbol' WHEN n_regex > 0 THEN 'regex' ELSE 'rrf' END WHEN task_type = 'config_import' THEN CASE WHEN n_regex > 0 THEN 'regex' ELSE 'rrf' END ELSE 'rrf' END AS method FROM tasks LEFT JOIN cn USING (task_id)""")
def route_task_type(spark, sf_dir):
    flags = policies.channel_flags(tasks(spark, sf_dir), predictions(spark, sf_dir), ["regex", "symbol", "rrf"])
    return policies.route_by_type(flags).select("task_id", "method")


FEATURES = f"""ft AS (SELECT task_id, CASE WHEN marker OR common OR uuid THEN 2 ELSE 0 END + CASE WHEN vague THEN 2 ELSE 0 END + CASE WHEN fabricated THEN 1 ELSE 0 END + CASE WHEN marker THEN 1 ELSE 0 END + CASE WHEN n_toks = 1 AND common THEN 1 ELSE 0 END + CASE WHEN uuid THEN 1 ELSE 0 END AS noise,
 coalesce(top, 0) AS top_score, coalesce(n_regex, 0) AS n_regex, coalesce(n_symbol, 0) AS n_symbol, coalesce(top, 0) - coalesce(sec, 0) AS gap, density, coalesce(ch, 0) AS channels FROM fl LEFT JOIN (SELECT task_id, max(CASE WHEN strategy = 'rrf' AND rank = 1 THEN score END) AS top,
 max(CASE WHEN strategy = 'rrf' AND rank = 2 THEN score END) AS sec, count(*) FILTER (strategy = 'regex') AS n_regex, count(*) FILTER (strategy = 'symbol') AS n_symbol, count(DISTINCT strategy) AS ch FROM preds GROUP BY ALL) USING (task_id))"""
SETTINGS = "(VALUES (1, 2, 0.0, false, false, false, 0.0, 0, 0), (2, 3, 0.01, true, false, false, 0.0, 0, 0), (3, 1, 0.0, false, true, false, 0.0, 1, 2), (4, 9, 0.0, false, false, true, 0.0001, 0, 3))"


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES} SELECT setting_id, task_id, CASE WHEN noise >= max_noise THEN 'noise' WHEN top_score < min_score THEN 'score' WHEN need_regex AND n_regex = 0 THEN 'regex' WHEN need_symbol AND n_symbol = 0 THEN 'symbol' WHEN need_either AND n_regex = 0 AND n_symbol = 0 THEN 'either'
 WHEN gap < min_gap THEN 'gap' WHEN density < min_density THEN 'density' WHEN channels < min_channels THEN 'channels' END AS fail_reason FROM ft, {SETTINGS} s(setting_id, max_noise, min_score, need_regex, need_symbol, need_either, min_gap, min_density, min_channels)""")
def guard_sweep(spark, sf_dir):
    settings = spark.sql(f"SELECT * FROM {SETTINGS} AS s(setting_id, max_noise, min_score, need_regex, need_symbol, need_either, min_gap, min_density, min_channels)")
    return policies.guard_sweep(policies.task_features(tasks(spark, sf_dir), predictions(spark, sf_dir)), settings)


SCORECARD = """sc AS (SELECT task_id, density = 1 AND n_symbol > 0 AS exact_unique, density = 1 AS uniq, n_symbol > 0 AS symbol, n_regex > 0 AS regex, channels >= 3 AS local_anchor, top_score > 0 AS backed, noise / 6.0 AS nz, gap > 0 AS narrow, n_symbol = 0 AS within,
 task_type = 'negative' AS neg, CASE repo_id WHEN 'src0' THEN 'negative' WHEN 'src1' THEN 'ambiguous' WHEN 'src2' THEN 'hard_distractor' WHEN 'src3' THEN 'other' ELSE 'likely_positive' END AS bucket, channels >= 4 AS dense, task_id % 7 = 0 AS graph,
 n_symbol > 0 AND n_regex > 0 AS af, n_symbol > 1 AND n_regex > 0 AS asp, n_regex > 0 AND top_score > 0 AS rf, n_regex > 1 AND top_score > 0 AS rs FROM ft JOIN (SELECT task_id, repo_id, task_type FROM tasks) USING (task_id)),
 pb AS (SELECT *, exact_unique::INT * 2 + symbol::INT + regex::INT + local_anchor::INT + backed::INT + narrow::INT + within::INT + CASE WHEN nz > 0.5 THEN -2 WHEN nz > 0.25 THEN -1 ELSE 0 END - 3 * neg::INT
 + CASE WHEN bucket IN ('negative', 'ambiguous') THEN -2 WHEN bucket = 'likely_positive' THEN 1 ELSE 0 END AS common FROM sc)"""


SUBTYPES = """st AS (SELECT doc_id AS task_id, k, ['span_overlap', 'same_file_only', 'disagree', 'single_source'][(doc_id + k) % 4 + 1] AS agreement,
 ['symbol_regex_fusion', 'symbol_only', 'regex_only'][(doc_id // 2 + k) % 3 + 1] AS source, (doc_id // 5 + k) % 2 = 0 AS rrf FROM documents, range(3) r(k) WHERE k < doc_id % 4),
ag AS (SELECT task_id, min((CASE agreement WHEN 'span_overlap' THEN 1 WHEN 'same_file_only' THEN 2 WHEN 'disagree' THEN 3 ELSE 4 END) * 2 + (NOT rrf)::INT) AS b, arg_min(source, k) AS ts, arg_min(agreement, k) AS ta, arg_min(rrf, k) AS tr FROM st GROUP BY task_id),
ps AS (SELECT sc.*, b // 2 AS b, b % 2 = 0 AS br, ts, ta, tr, task_id % 9 <> 0 AS handoff, bucket IN ('negative', 'hard_distractor') OR neg AS bad, bucket = 'likely_positive' AND NOT neg AS low,
 symbol::INT + regex::INT + local_anchor::INT + exact_unique::INT + (task_id % 9 <> 0)::INT AS each FROM sc LEFT JOIN ag USING (task_id))"""


def _subtypes(spark, sf_dir):
    """Up to three anchor subtypes of each task."""
    d, k = F.col("doc_id"), F.col("rank") - 1
    rows = table(spark, sf_dir, "documents").where(d % 4 > 0).select("doc_id", F.explode(F.sequence(F.lit(1), d % 4)).alias("rank"))
    return rows.select(
        d.alias("task_id"), "rank", F.col("rank").alias("place"), _pick(policies.AGREEMENTS, (d + k) % 4).alias("agreement_class"),
        _pick(("symbol_regex_fusion", "symbol_only", "regex_only"), (F.floor(d / 2) + k) % 3).alias("source_class"), ((F.floor(d / 5) + k) % 2 == 0).alias("rrf_backing"))


def _scorecard(spark, sf_dir, version):
    t = tasks(spark, sf_dir)
    f = policies.task_features(t, predictions(spark, sf_dir)).join(t.select("task_id", "repo_id", "task_type"), "task_id")
    c = F.col
    buckets = {"src0": "negative", "src1": "ambiguous", "src2": "hard_distractor", "src3": "other"}
    bucket = F.lit("likely_positive")
    for repo, name in buckets.items():
        bucket = F.when(c("repo_id") == repo, name).otherwise(bucket)
    features = {
        "exact_unique": (c("density") == 1) & (c("n_symbol") > 0), "unique": c("density") == 1, "symbol": c("n_symbol") > 0, "regex": c("n_regex") > 0,
        "local": c("channels") >= 3, "rrf_backed": c("top_score") > 0, "noise": c("noise") / 6.0, "span_narrow": c("gap") > 0, "within": c("n_symbol") == 0,
        "tags": F.when(c("task_type") == "negative", F.array(F.lit("negative"))).otherwise(F.array().cast("array<string>")), "bucket": bucket,
        "dense_support": c("channels") >= 4, "graph_support": c("task_id") % 7 == 0,
        "agree_file": (c("n_symbol") > 0) & (c("n_regex") > 0), "agree_span": (c("n_symbol") > 1) & (c("n_regex") > 0),
        "rrf_file": (c("n_regex") > 0) & (c("top_score") > 0), "rrf_span": (c("n_regex") > 1) & (c("top_score") > 0),
    }
    made = f.select("task_id", *[v.alias(k) for k, v in features.items()])
    if version in ("h4", "h4b"):
        made = made.join(policies.anchor_subtypes(_subtypes(spark, sf_dir)), "task_id", "left").withColumn("handoff", c("task_id") % 9 != 0)
    return policies.admission(made, version).select("task_id", "points", "action")


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, {SCORECARD}, p2 AS (SELECT *, common + CASE WHEN uniq AND NOT exact_unique THEN 1 ELSE 0 END AS p FROM pb)
SELECT task_id, p AS points, CASE WHEN bucket IN ('negative', 'hard_distractor') OR p <= -4 THEN CASE WHEN dense OR graph THEN 'supporting' WHEN p <= -5 THEN 'abstain' ELSE 'filter' END WHEN bucket = 'ambiguous' THEN CASE WHEN dense OR graph THEN 'supporting' ELSE 'filter' END
 WHEN exact_unique AND nz <= 0.2 THEN 'union' WHEN (symbol OR regex) AND local_anchor AND nz <= 0.3 THEN 'union' WHEN backed AND local_anchor AND nz <= 0.4 THEN 'rrf' WHEN narrow AND within AND nz <= 0.4 THEN 'narrow' WHEN p <= 0 AND NOT local_anchor THEN 'weak' ELSE 'abstain' END AS action FROM p2""")
def admission_scorecard(spark, sf_dir):
    return _scorecard(spark, sf_dir, "v3")


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, {SCORECARD}, p2 AS (SELECT *, common + af::INT + asp::INT + rf::INT + rs::INT AS p, bucket = 'likely_positive' AND nz <= 0.2 AS clean FROM pb)
SELECT task_id, p AS points, CASE WHEN bucket IN ('negative', 'hard_distractor') OR neg THEN CASE WHEN dense OR graph THEN 'supporting' ELSE 'filter' END
 WHEN bucket = 'ambiguous' THEN CASE WHEN (asp OR rs) AND nz <= 0.2 THEN 'weak' WHEN dense OR graph THEN 'supporting' ELSE 'filter' END
 WHEN exact_unique AND nz <= 0.1 THEN 'union' WHEN asp AND clean THEN 'union' WHEN af AND clean THEN 'weak' WHEN rs AND clean THEN 'rrf' WHEN rf AND clean THEN 'weak' WHEN narrow AND within AND (asp OR rs OR exact_unique) AND clean THEN 'narrow' WHEN local_anchor THEN 'weak' WHEN dense OR graph THEN 'supporting' ELSE 'abstain' END AS action FROM p2""")
def admission_agreement(spark, sf_dir):
    return _scorecard(spark, sf_dir, "h2")


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, {SCORECARD}, {SUBTYPES}, p4 AS (SELECT *, each + CASE b WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN -1 WHEN 4 THEN -2 ELSE -1 END + coalesce(br, false)::INT + CASE WHEN nz > 0.5 THEN -2 WHEN nz > 0.25 THEN -1 ELSE 0 END - 3 * neg::INT
 + CASE WHEN bucket IN ('negative', 'ambiguous') THEN -2 WHEN bucket = 'likely_positive' THEN 1 ELSE 0 END AS p FROM ps)
SELECT task_id, p AS points, CASE WHEN bad OR p <= -5 THEN CASE WHEN dense OR graph THEN 'supporting' ELSE 'filter' END WHEN bucket = 'ambiguous' THEN CASE WHEN b = 1 AND br THEN 'supporting' WHEN b = 1 THEN 'weak' WHEN dense OR graph THEN 'supporting' ELSE 'filter' END
 WHEN exact_unique AND nz <= 0.2 THEN CASE WHEN b = 1 AND br THEN 'supporting' WHEN low THEN 'weak' ELSE 'filter' END WHEN b = 1 THEN CASE WHEN br THEN 'supporting' WHEN low THEN 'weak' ELSE 'filter' END WHEN b = 2 THEN CASE WHEN low THEN 'weak' ELSE 'filter' END
 WHEN b IN (3, 4) THEN CASE WHEN low AND nz <= 0.2 THEN 'weak' ELSE 'filter' END WHEN dense OR graph THEN 'supporting' ELSE 'weak' END AS action FROM p4""")
def admission_budget(spark, sf_dir):
    return _scorecard(spark, sf_dir, "h4")


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, {SCORECARD}, {SUBTYPES}, p4 AS (SELECT *, each + CASE ta WHEN 'span_overlap' THEN 2 WHEN 'same_file_only' THEN 1 WHEN 'disagree' THEN -1 WHEN 'single_source' THEN -2 ELSE -1 END + coalesce(tr, false)::INT
 + CASE WHEN ts IN ('symbol_regex_fusion', 'symbol_only') THEN 1 WHEN ts = 'regex_only' THEN -1 ELSE 0 END + asp::INT + rs::INT + backed::INT - CASE WHEN nz > 0.2 THEN 3 ELSE 0 END AS p,
 bad OR bucket = 'ambiguous' OR nz > 0.2 OR ts IS NULL OR ts = 'regex_only' OR ta <> 'span_overlap' AS guarded, coalesce(ts = 'symbol_regex_fusion' AND ta = 'span_overlap', false) AS fused FROM ps)
SELECT task_id, p AS points, CASE WHEN NOT handoff THEN 'weak' WHEN guarded THEN CASE WHEN bucket IN ('negative', 'hard_distractor', 'ambiguous') OR nz > 0.2 THEN 'filter' WHEN ts IS NULL THEN 'weak' WHEN ts = 'regex_only' THEN 'filter' WHEN ta = 'same_file_only' THEN 'weak' ELSE 'filter' END
 WHEN fused AND tr AND local_anchor AND asp AND nz <= 0.1 AND low AND (exact_unique OR rs) THEN CASE WHEN backed AND rs THEN 'rrf' ELSE 'union' END WHEN fused AND tr THEN 'supporting' WHEN fused AND low THEN 'weak' WHEN fused THEN 'filter' ELSE 'weak' END AS action FROM p4""")
def admission_readmission(spark, sf_dir):
    return _scorecard(spark, sf_dir, "h4b")


# ---------------------------------------------------------------------- packing
@query(f"""WITH {EVAL}, m AS (SELECT *, row_number() OVER (PARTITION BY strategy, task_id, fkey ORDER BY rank) <= 1 AS ok FROM (SELECT *, path AS fkey FROM preds)), p AS (SELECT *, sum(ok::INT) OVER (PARTITION BY strategy, task_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM m)
SELECT strategy, task_id, rank, row_number() OVER (PARTITION BY strategy, task_id ORDER BY CASE WHEN ok AND c <= 3 THEN 0 ELSE 1 END, rank) AS new_rank FROM p""")
def distinct_file_pack(spark, sf_dir):
    return packing.distinct_file_pack(predictions(spark, sf_dir), 3).select("strategy", "task_id", "rank", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"""WITH {EVAL}, m AS (SELECT *, rank > 2 AND row_number() OVER (PARTITION BY strategy, task_id, path ORDER BY rank) = 1 AS fresh FROM preds), p AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY strategy, task_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM m)
SELECT strategy, task_id, rank, row_number() OVER (PARTITION BY strategy, task_id ORDER BY CASE WHEN rank <= 2 THEN 0 WHEN fresh AND c <= 2 THEN 1 ELSE 2 END, rank) AS new_rank FROM p""")
def prefix_pack(spark, sf_dir):
    return packing.prefix_pack(predictions(spark, sf_dir), 2, 4).select("strategy", "task_id", "rank", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"""WITH {EVAL}, o AS (SELECT DISTINCT task_id, path FROM preds WHERE strategy = 'bm25') SELECT strategy, task_id, rank, row_number() OVER (PARTITION BY strategy, task_id ORDER BY CASE WHEN o.path IS NULL THEN 0 ELSE 1 END, rank) AS new_rank FROM preds LEFT JOIN o USING (task_id, path) WHERE strategy = 'rrf'""")
def novel_first(spark, sf_dir):
    p = predictions(spark, sf_dir)
    old = p.where("strategy = 'bm25'").withColumn("strategy", F.lit("rrf"))
    return packing.novel_first(p.where("strategy = 'rrf'"), old).select("strategy", "task_id", "rank", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"WITH {EVAL} SELECT strategy, task_id, rank, row_number() OVER (PARTITION BY strategy, task_id ORDER BY CASE WHEN rank > 3 THEN 0 ELSE 1 END, rank) AS new_rank FROM preds")
def deep_first(spark, sf_dir):
    return packing.deep_first(predictions(spark, sf_dir), 3).select("strategy", "task_id", "rank", F.col("new_rank").cast("long").alias("new_rank"))


@query(f"WITH {EVAL} SELECT strategy, task_id, rank, greatest(1, start_line - CASE WHEN rank <= 2 THEN 200 WHEN end_line - start_line + 1 <= 10 THEN 75 ELSE 0 END) AS new_start, end_line + CASE WHEN rank <= 2 THEN 200 WHEN end_line - start_line + 1 <= 10 THEN 225 ELSE 0 END AS new_end FROM preds")
def span_window_expand(spark, sf_dir):
    return packing.expand_spans(predictions(spark, sf_dir), top=2).select("strategy", "task_id", "rank", "new_start", "new_end")


@query()
def budgeted_acquisition(spark, sf_dir):
    return packing.budgeted_acquisition(packing.agreed_candidates(predictions(spark, sf_dir)), 5)


@query()
def greedy_diversity(spark, sf_dir):
    return packing.greedy_diversity(packing.agreed_candidates(predictions(spark, sf_dir)), 5, tasks(spark, sf_dir))


@query()
def anchored_policy(spark, sf_dir):
    return packing.anchored(packing.agreed_candidates(predictions(spark, sf_dir)), 5)


@query()
def contrast_pack(spark, sf_dir):
    return packing.contrast_pack(packing.agreed_candidates(predictions(spark, sf_dir)))


# ------------------------------------------------------------------- statistics
@query("""WITH p AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(CASE WHEN i = 95 * (n - 1) // 100 THEN value END) AS p_floor, max(CASE WHEN i = least(n * 95 // 100, n - 1) THEN value END) AS p_index, round(quantile_cont(value, 0.95), 6) AS p_linear, count(*) AS n FROM p GROUP BY event_type""")
def latency_percentiles(spark, sf_dir):
    return _r(stats.percentiles(table(spark, sf_dir, "events"), "value", ["event_type"], 95), "p_linear")


@query("""WITH g AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, greatest(1, round_even(0.1 * count(*) OVER (PARTITION BY event_type), 0)) AS k FROM events)
SELECT event_type, round(avg(value), 6) AS cvar, count(*) AS n_worst FROM g WHERE i <= k GROUP BY event_type""")
def cvar_tail(spark, sf_dir):
    return _r(stats.cvar(table(spark, sf_dir, "events"), "value", ["event_type"], 0.1), "cvar")


@query("SELECT event_type, true AS within FROM events WHERE value IS NOT NULL GROUP BY event_type")
def percentile_sketch(spark, sf_dir):
    """The sketch's place keeps to its bound in every group; the exact places
    come from range partitions."""
    return stats.sketch_errors(table(spark, sf_dir, "events"), "value", ["event_type"], 95).select("event_type", "within")


@query("""WITH m AS (SELECT event_type, user_id, round(avg(value), 9) AS m FROM events GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY m, user_id) AS r FROM m)
SELECT event_type, max(CASE WHEN r = 1 THEN user_id END) AS worst_group, round(min(m), 6) AS worst_mean, round(max(m) - min(m), 6) AS spread, round(avg(m), 6) AS mean_of_groups FROM w GROUP BY event_type""")
def worst_group(spark, sf_dir):
    return _r(stats.worst_group(table(spark, sf_dir, "events"), "value", "user_id", ["event_type"]), "worst_mean", "spread", "mean_of_groups")


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / nullif(sum(l_quantity), 0), 6) AS weighted_mean FROM lineitem GROUP BY l_returnflag")
def weighted_mean(spark, sf_dir):
    return _r(stats.weighted_mean(table(spark, sf_dir, "lineitem"), "l_discount", "l_quantity", ["l_returnflag"]), "weighted_mean")


@query("SELECT source, CASE WHEN dense_rank() OVER (ORDER BY source) <= 12 THEN 'train' ELSE 'test' END AS split FROM (SELECT DISTINCT source FROM documents)")
def repo_holdout_split(spark, sf_dir):
    return stats.holdout_split(table(spark, sf_dir, "documents"), "source", 12)


@query()
def bootstrap_ci(spark, sf_dir):
    return stats.bootstrap_interval(table(spark, sf_dir, "events"), "value", "event_id", ["event_type"], resamples=10_000)
