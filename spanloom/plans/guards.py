"""Queries over guards, buckets, further packing orders and failure counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fusion, governance, metrics, packing, policies, stats
from ..sources.corpus import table
from . import evaluation as E
from .registry import ORACLES, query

EVAL, FLAGS, FEATURES = E.EVAL, E.FLAGS, E.FEATURES
NOISY = "(marker OR common OR uuid OR vague OR fabricated)"


def _features(spark, sf_dir):
    t, p = E.tasks(spark, sf_dir), E.predictions(spark, sf_dir)
    fused = p.where("strategy = 'rrf'").groupBy("task_id").agg(F.count("*").alias("n_rrf"))
    got = policies.task_features(t, p).join(t.select("task_id", "query", "repo_id"), "task_id").join(fused, "task_id", "left")
    return got.na.fill(0, ["n_rrf"])


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, f AS (SELECT ft.*, {NOISY} AS noisy FROM ft JOIN fl USING (task_id)), g AS (SELECT unnest(['by_symbol', 'by_regex', 'by_either', 'noise_and_agreement']) AS guard)
SELECT task_id, guard, CASE WHEN CASE guard WHEN 'by_symbol' THEN n_symbol > 0 WHEN 'by_regex' THEN n_regex > 0 WHEN 'by_either' THEN n_symbol + n_regex > 0 ELSE NOT noisy AND top_score > 0 AND n_symbol + n_regex > 0 END THEN 'rrf' ELSE 'empty' END AS method FROM f, g""")
def composite_guards(spark, sf_dir):
    return policies.composites(_features(spark, sf_dir))


@query(f"""WITH {EVAL}, c AS (SELECT * FROM (VALUES ('bm25_regex', 'bm25'), ('bm25_regex', 'regex'), ('bm25_symbol', 'bm25'), ('bm25_symbol', 'symbol')) v(pair, strategy))
SELECT pair, task_id, path, start_line, end_line, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, count(*) AS n_hits FROM preds JOIN c USING (strategy) GROUP BY ALL""")
def rrf_channel_pairs(spark, sf_dir):
    p = E.predictions(spark, sf_dir)
    s = F.col("strategy")
    pairs = F.array_compact(F.array(F.when(s.isin("bm25", "regex"), F.lit("bm25_regex")), F.when(s.isin("bm25", "symbol"), F.lit("bm25_symbol"))))
    spread = p.select(F.explode(pairs).alias("pair"), "task_id", "path", "start_line", "end_line", "rank", s.alias("channel"))
    keys = ["pair", "task_id", "path", "start_line", "end_line"]
    return fusion.rrf(spread, keys).select(*keys, F.round("score", 9).alias("score"), "n_hits")


@query(f"""WITH {EVAL}, m AS (SELECT task_id, path, start_line, end_line, strategy, min(rank) AS r FROM preds WHERE strategy <> 'rrf' GROUP BY ALL)
SELECT task_id, path, start_line, end_line, round(sum(1.0::DOUBLE / (60 + r)), 9) AS score, count(*) AS n_methods FROM m GROUP BY ALL""")
def rrf_from_method_ranks(spark, sf_dir):
    keys = ["task_id", "path", "start_line", "end_line"]
    best = E.predictions(spark, sf_dir).where("strategy <> 'rrf'").groupBy(*keys, F.col("strategy").alias("channel")).agg(F.min("rank").alias("rank"))
    return fusion.rrf(best, keys).select(*keys, F.round("score", 9).alias("score"), F.col("n_hits").alias("n_methods"))


@query(f"""WITH {EVAL}, gs AS ({ORACLES['guard_sweep']}), h AS (SELECT task_id, bool_or(file_hit) AS hit FROM hits WHERE strategy = 'rrf' AND rank = 1 GROUP BY ALL),
r AS (SELECT setting_id, (fail_reason IS NULL AND hit IS NOT NULL)::INT AS kept, hit, task_id IN (SELECT task_id FROM gt) AS g FROM gs LEFT JOIN h USING (task_id))
SELECT setting_id, round(avg(1 - kept), 6) AS abstain_rate, round(avg(CASE WHEN NOT g THEN kept END), 6) AS no_gold_nonempty, round(avg(CASE WHEN g THEN kept * hit::INT END), 6) AS file_recall_1 FROM r GROUP BY setting_id""")
def guard_curves(spark, sf_dir):
    p, g = E._pg(spark, sf_dir)
    first = metrics.pairs_with_gold(p.where("strategy = 'rrf' AND rank = 1"), g).groupBy("task_id").agg(F.bool_or(F.col("file_hit").cast("boolean")).alias("hit"))
    return E._r(policies.guard_curves(E.guard_sweep(spark, sf_dir), first, g), "abstain_rate", "no_gold_nonempty", "file_recall_1")


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, x AS (SELECT task_id, CASE WHEN fl.exact THEN 2 WHEN ft.density > 0 THEN 1 ELSE 0 END AS anchor, least(noise, 2) AS risk, channels AS support FROM ft JOIN fl USING (task_id))
SELECT anchor::INTEGER AS anchor, risk::INTEGER AS risk, support::BIGINT AS support, count(*) AS n_tasks, count(gt.task_id) AS n_gold FROM x LEFT JOIN gt USING (task_id) GROUP BY CUBE (anchor, risk, support)""")
def calibration_cells(spark, sf_dir):
    f = _features(spark, sf_dir)
    anchor = F.when(policies.is_exact_identifier(F.col("query")), 2).when(F.col("density") > 0, 1).otherwise(0)
    rows = f.select("task_id", anchor.alias("anchor"), F.least("noise", F.lit(2)).alias("risk"), F.col("channels").alias("support"))
    return metrics.calibration_cells(rows, E.gold(spark, sf_dir))


@query(f"""WITH {EVAL}, {FLAGS}, {FEATURES}, x AS (SELECT task_id, list_filter([CASE WHEN fl.exact THEN 'exact_identifier' END, CASE WHEN noise > 0 THEN 'noise' END, CASE WHEN n_symbol > 0 THEN 'symbol_anchor' END, CASE WHEN n_regex > 0 THEN 'regex_anchor' END,
 CASE WHEN channels >= 3 THEN 'many_channels' END, CASE WHEN gap >= 0.0001 THEN 'clear_lead' END], lambda b: b IS NOT NULL) AS b FROM ft JOIN fl USING (task_id)), u AS (SELECT task_id, unnest(CASE WHEN len(b) > 0 THEN b ELSE ['no_anchor'] END) AS bucket FROM x)
SELECT bucket, count(*) AS n_tasks, count(gt.task_id) AS n_gold FROM u LEFT JOIN gt USING (task_id) GROUP BY bucket""")
def anchor_buckets(spark, sf_dir):
    golden = E.gold(spark, sf_dir).select("task_id").distinct().withColumn("g", F.lit(1))
    got = policies.anchor_buckets(_features(spark, sf_dir)).join(golden, "task_id", "left")
    return got.groupBy("bucket").agg(F.count("*").alias("n_tasks"), F.count("g").alias("n_gold"))


@query(f"""WITH {EVAL}, l AS (SELECT doc_id AS task_id, count(*) AS n_l FROM labels GROUP BY ALL), t AS (SELECT task_id, count(*) AS n_t FROM tasks GROUP BY ALL), b AS (SELECT n_t, n_l FROM t FULL JOIN l ON t.task_id = l.task_id)
SELECT unnest(['duplicate_task', 'duplicate_label', 'missing_label', 'missing_task', 'unknown_repo']) AS "check", unnest([count(*) FILTER (n_t > 1), count(*) FILTER (n_l > 1), count(*) FILTER (n_l IS NULL), count(*) FILTER (n_t IS NULL),
 (SELECT count(*) FROM (SELECT DISTINCT repo_id FROM tasks) WHERE repo_id NOT IN ('src0', 'src1', 'src2') OR repo_id IS NULL)]) AS n FROM b""")
def task_label_consistency(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("task_id"))
    repos = spark.sql("SELECT explode(array('src0', 'src1', 'src2')) AS repo_id")
    return metrics.label_consistency(E.tasks(spark, sf_dir), labels, repos)


@query(f"""WITH s AS ({ORACLES['bucket_metrics']}), d AS (SELECT s.strategy, s.bucket, s.mrr - b.mrr AS gain FROM s JOIN s b ON b.bucket = s.bucket AND b.strategy = 'rrf')
SELECT strategy, round(max(gain) - min(gain), 5) AS spread, count(DISTINCT bucket) AS n_groups FROM d GROUP BY strategy""")
def gain_spread(spark, sf_dir):
    got = metrics.delta_spread(E.bucket_metrics(spark, sf_dir), "mrr", "rrf")
    return got.withColumn("spread", F.round("spread", 5))


@query(f"""WITH {EVAL}, w AS (SELECT gt.task_id, coalesce(bool_or(file_hit) FILTER (strategy = 'rrf'), false) AS f, coalesce(bool_or(file_hit) FILTER (strategy = 'symbol'), false) AS s, coalesce(bool_or(file_hit) FILTER (strategy = 'regex'), false) AS r,
 coalesce(bool_or(file_hit) FILTER (strategy = 'bm25'), false) AS b FROM gt LEFT JOIN hits USING (task_id) GROUP BY ALL),
u AS (SELECT unnest([CASE WHEN f AND NOT s THEN 'symbol_miss' END, CASE WHEN f AND NOT r THEN 'regex_miss' END, CASE WHEN f AND NOT b THEN 'bm25_miss' END, CASE WHEN NOT f AND (s OR r OR b) THEN 'fusion_lost' END, CASE WHEN NOT (f OR s OR r OR b) THEN 'no_channel' END]) AS cluster FROM w)
SELECT cluster, count(*) AS n_tasks FROM u WHERE cluster IS NOT NULL GROUP BY cluster""")
def failure_clusters(spark, sf_dir):
    return metrics.failure_clusters(*E._pg(spark, sf_dir))


@query(f"WITH {EVAL} SELECT strategy, count(*) AS n_bad, count(DISTINCT task_id) AS n_tasks FROM preds WHERE starts_with(path, 'doc/1') OR starts_with(path, 'doc/9') GROUP BY strategy")
def forbidden_paths(spark, sf_dir):
    return governance.forbidden_predictions(E.predictions(spark, sf_dir), ["doc/1", "doc/9"])


@query("""WITH s AS (SELECT source, doc_id * 37 % 5000 AS start_line, doc_id * 37 % 5000 + doc_id % 5 AS end_line FROM documents),
f AS (SELECT *, max(end_line) OVER (PARTITION BY source ORDER BY start_line, end_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS far FROM s)
SELECT source, far + 1 AS gap_start, start_line - 1 AS gap_end FROM f WHERE start_line > far + 1""")
def span_gaps(spark, sf_dir):
    start = F.col("doc_id") * 37 % 5000
    spans = table(spark, sf_dir, "documents").select("source", start.alias("start_line"), (start + F.col("doc_id") % 5).alias("end_line"))
    return metrics.span_gaps(spans, ["source"])


# ---------------------------------------------------------------------- packing
LONG = "lg AS (SELECT 'all' AS strategy, task_id, path, row_number() OVER (PARTITION BY task_id ORDER BY strategy, rank) AS rank FROM preds)"


def _long(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("strategy", "rank"))
    p = E.predictions(spark, sf_dir).withColumn("rank", place.cast("long"))
    return p.select(F.lit("all").alias("strategy"), "task_id", "path", "rank")


def _order(items):
    return items.select("task_id", F.col("rank").cast("long").alias("rank"), F.col("new_rank").cast("long").alias("new_rank"))


def _deep_sql(key: str) -> str:
    return f"WITH {EVAL}, {LONG} SELECT task_id, rank, row_number() OVER (PARTITION BY task_id ORDER BY coalesce({key}, rank + 1000), rank) AS new_rank FROM lg"


@query(_deep_sql("CASE WHEN rank <= 5 THEN rank WHEN rank BETWEEN 11 AND 20 THEN rank - 5 WHEN rank BETWEEN 6 AND 10 THEN rank + 10 END"))
def deep_swap(spark, sf_dir):
    return _order(packing.deep_promotion(_long(spark, sf_dir), "swap"))


@query(_deep_sql("CASE WHEN rank <= 5 THEN rank WHEN rank <= 10 THEN 2 * rank - 5 WHEN rank <= 15 THEN 2 * rank - 14 WHEN rank <= 20 THEN rank + 2 END"))
def deep_interleave(spark, sf_dir):
    return _order(packing.deep_promotion(_long(spark, sf_dir), "interleave"))


@query(_deep_sql("CASE WHEN rank <= 7 THEN rank WHEN rank BETWEEN 11 AND 13 THEN rank - 3 WHEN rank BETWEEN 8 AND 10 THEN rank + 3 END"))
def deep_after_seven(spark, sf_dir):
    return _order(packing.deep_promotion(_long(spark, sf_dir), "top7"))


GUARDED = f"""o AS (SELECT DISTINCT task_id, path FROM preds WHERE strategy = 'bm25'), gm AS (SELECT lg.*, o.path IS NULL AND rank > 5 AND row_number() OVER (PARTITION BY lg.task_id, lg.path ORDER BY rank) = 1 AS ok FROM lg LEFT JOIN o USING (task_id, path)),
gc AS (SELECT *, sum(ok::INT) OVER (PARTITION BY task_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS c FROM gm),
gn AS (SELECT task_id, rank, path, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN rank <= 5 THEN 0 WHEN ok AND c <= 5 THEN 1 ELSE 2 END, rank) AS new_rank FROM gc)"""


def _old(spark, sf_dir):
    return E.predictions(spark, sf_dir).where("strategy = 'bm25'").select(F.lit("all").alias("strategy"), "task_id", "path")


@query(f"WITH {EVAL}, {LONG}, {GUARDED} SELECT task_id, rank, new_rank FROM gn")
def guarded_novel(spark, sf_dir):
    return _order(packing.guarded_novel(_long(spark, sf_dir), _old(spark, sf_dir)))


@query(f"""WITH {EVAL}, {LONG}, {GUARDED}, nf AS (SELECT task_id, rank, row_number() OVER (PARTITION BY task_id ORDER BY CASE WHEN o.path IS NULL THEN 0 ELSE 1 END, rank) AS b FROM lg LEFT JOIN o USING (task_id, path))
SELECT task_id, rank, row_number() OVER (PARTITION BY task_id ORDER BY least(2 * new_rank, 2 * b + 1), rank) AS new_rank FROM gn JOIN nf USING (task_id, rank)""")
def alternate_packs(spark, sf_dir):
    items, old = _long(spark, sf_dir), _old(spark, sf_dir)
    return _order(packing.alternate(packing.guarded_novel(items, old), packing.novel_first(items, old)))


@query()
def random_arm(spark, sf_dir):
    return packing.random_arm(_long(spark, sf_dir), 5)


# ------------------------------------------------------------------- statistics
@query()
def paired_bootstrap(spark, sf_dir):
    """Interval and sign shares of each strategy's gain in reciprocal rank over the fused list."""
    p, g = E._pg(spark, sf_dir)
    hit = metrics.pairs_with_gold(p, g).where("file_hit").groupBy("strategy", "task_id").agg((1.0 / F.min("rank")).alias("rr"))
    every = g.select("task_id").distinct().withColumn("strategy", F.explode(F.array(*map(F.lit, E.STRATEGIES))))
    rr = every.join(hit, ["strategy", "task_id"], "left").na.fill(0.0, ["rr"])
    base = rr.where("strategy = 'rrf'").select("task_id", F.col("rr").alias("base"))
    gains = rr.where("strategy <> 'rrf'").join(base, "task_id").select("strategy", "task_id", (F.col("rr") - F.col("base")).alias("gain"))
    return stats.bootstrap_interval(gains, "gain", "task_id", ["strategy"], resamples=1000)
