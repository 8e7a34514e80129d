"""Retrieval metrics over predictions, gold spans and labels.

predictions: strategy, task_id, rank, path, start_line, end_line, score
gold:        task_id, path, start_line, end_line
tasks:       task_id and label columns

Metrics of files and spans are averages over tasks that have gold; a task
without predictions counts as zero. All are ordinary aggregations: spans are
measured by their intervals, never line by line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pairs_with_gold(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """Each prediction with whether its path is gold and whether a gold span of
    its path overlaps it."""
    g = gold.select("task_id", "path", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))
    hit = (F.col("start_line") <= F.col("ge")) & (F.col("gs") <= F.col("end_line"))
    keys = ["strategy", "task_id", "rank", "path", "start_line", "end_line"]
    return predictions.select(*keys).join(g, ["task_id", "path"], "left").groupBy(*keys).agg(
        F.max(F.col("gs").isNotNull()).alias("file_hit"), F.max(F.coalesce(hit, F.lit(False))).alias("span_hit")
    )


def by_gold_task(values: DataFrame, strategies: DataFrame, gold: DataFrame) -> DataFrame:
    """Every strategy with every task that has gold, with ``values`` joined.
    Strategies are a handful of names, so this only repeats the tasks."""
    tasks = gold.select("task_id").distinct()
    return tasks.crossJoin(F.broadcast(strategies)).join(values, ["strategy", "task_id"], "left")


def file_metrics(predictions: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """strategy, file_recall, file_precision, mrr."""
    hits = pairs_with_gold(predictions, gold)
    within = F.col("rank") <= k
    one = hits.groupBy("strategy", "task_id").agg(
        F.max((F.col("file_hit") & within).cast("int")).alias("hit"),
        (F.countDistinct(F.when(F.col("file_hit") & within, F.col("path"))) / F.countDistinct(F.when(within, F.col("path")))).alias("precision"),
        F.min(F.when(F.col("file_hit"), F.col("rank"))).alias("first"),
    )
    every = by_gold_task(one, predictions.select("strategy").distinct(), gold)
    zero = lambda c: F.avg(F.coalesce(c, F.lit(0.0)))
    return every.groupBy("strategy").agg(
        zero(F.col("hit").cast("double")).alias("file_recall"), zero(F.col("precision")).alias("file_precision"),
        zero(1.0 / F.col("first")).alias("mrr"),
    )


def merged_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The union of spans as disjoint intervals for each key."""
    order = Window.partitionBy(*keys).orderBy("start_line", "end_line")
    before = F.max("end_line").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", (before.isNull() | (F.col("start_line") > before + 1)).cast("int"))
    grouped = marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(*keys, "island").agg(F.min("start_line").alias("start_line"), F.max("end_line").alias("end_line")).drop("island")


def _length(spans: DataFrame, keys: list[str], name: str) -> DataFrame:
    return spans.groupBy(*keys).agg(F.sum(F.col("end_line") - F.col("start_line") + 1).alias(name))


def span_metrics(predictions: DataFrame, gold: DataFrame, k: int = 10, beta: float = 0.5) -> DataFrame:
    """strategy, span_precision, span_recall (macro averages over distinct
    lines) and span_f, the F measure of those two averages."""
    top = predictions.where(F.col("rank") <= k)
    p = merged_spans(top, ["strategy", "task_id", "path"])
    g = merged_spans(gold, ["task_id", "path"])
    gg = g.select("task_id", "path", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))
    shared = p.join(gg, ["task_id", "path"]).select(
        "strategy", "task_id", F.greatest("start_line", "gs").alias("start_line"), F.least("end_line", "ge").alias("end_line")
    ).where("start_line <= end_line")
    per = (
        by_gold_task(_length(p, ["strategy", "task_id"], "n_pred"), predictions.select("strategy").distinct(), gold)
        .join(_length(shared, ["strategy", "task_id"], "n_both"), ["strategy", "task_id"], "left")
        .join(_length(g, ["task_id"], "n_gold"), "task_id")
    )
    both = F.coalesce("n_both", F.lit(0))
    out = per.groupBy("strategy").agg(
        F.avg(F.coalesce(both / F.col("n_pred"), F.lit(0.0))).alias("span_precision"), F.avg(both / F.col("n_gold")).alias("span_recall")
    )
    b2 = beta * beta
    pr, rc = F.col("span_precision"), F.col("span_recall")
    return out.withColumn("span_f", F.when(pr + rc == 0, 0.0).otherwise((1 + b2) * pr * rc / (b2 * pr + rc)))


def token_waste(predictions: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """strategy, token_waste: the share of predicted lines outside gold, lines
    counted as often as they are predicted."""
    g = merged_spans(gold, ["task_id", "path"]).select("task_id", "path", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))
    keys = ["strategy", "task_id", "rank", "path", "start_line", "end_line"]
    # least and greatest skip nulls, so a path without gold is told apart first.
    common = F.when(F.col("gs").isNotNull(), F.greatest(F.lit(0), F.least("end_line", "ge") - F.greatest("start_line", "gs") + 1))
    one = predictions.where(F.col("rank") <= k).select(*keys).join(g, ["task_id", "path"], "left").groupBy(*keys).agg(
        F.sum(F.coalesce(common, F.lit(0))).alias("good")
    )
    n = F.col("end_line") - F.col("start_line") + 1
    task = one.groupBy("strategy", "task_id").agg((F.sum(n - F.col("good")) / F.sum(n)).alias("waste"))
    every = by_gold_task(task, predictions.select("strategy").distinct(), gold)
    return every.groupBy("strategy").agg(F.avg(F.coalesce("waste", F.lit(0.0))).alias("token_waste"))


def span_errors(predictions: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """strategy, wrong_span_rate (gold file, wrong lines, of gold-file hits) and
    zero_overlap_rate (predictions of tasks with gold without any gold line)."""
    hits = pairs_with_gold(predictions.where(F.col("rank") <= k), gold).join(gold.select("task_id").distinct(), "task_id", "left_semi")
    return hits.groupBy("strategy").agg(
        F.avg(F.when(F.col("file_hit"), F.when(F.col("span_hit"), 0.0).otherwise(1.0))).alias("wrong_span_rate"),
        F.avg(F.when(F.col("span_hit"), 0.0).otherwise(1.0)).alias("zero_overlap_rate"),
    )


def negative_rates(predictions: DataFrame, tasks: DataFrame, gold: DataFrame) -> DataFrame:
    """strategy, no_gold_nonempty, abstain_rate, avg_candidates: how lists behave
    where nothing should be found, and in general."""
    size = predictions.groupBy("strategy", "task_id").agg(F.count("*").alias("n"))
    has = gold.select("task_id").distinct().withColumn("has_gold", F.lit(True))
    every = tasks.select("task_id").crossJoin(F.broadcast(predictions.select("strategy").distinct()))
    every = every.join(size, ["strategy", "task_id"], "left").join(has, "task_id", "left")
    n = F.coalesce("n", F.lit(0))
    return every.groupBy("strategy").agg(
        F.avg(F.when(F.col("has_gold").isNull(), (n > 0).cast("double"))).alias("no_gold_nonempty"),
        F.avg((n == 0).cast("double")).alias("abstain_rate"), F.avg(n).alias("avg_candidates"),
    )


def distractor_rate(predictions: DataFrame, distractors: DataFrame, k: int = 10) -> DataFrame:
    """strategy, per_item (each predicted item that overlaps a distractor counts,
    so it can exceed one) and per_task (tasks with any)."""
    hits = pairs_with_gold(predictions.where(F.col("rank") <= k), distractors)
    total = distractors.select(F.countDistinct("task_id").alias("total"))
    got = hits.groupBy("strategy").agg(
        F.count_if("span_hit").alias("items"), F.countDistinct(F.when(F.col("span_hit"), F.col("task_id"))).alias("tasks")
    )
    return got.crossJoin(F.broadcast(total)).select("strategy", (F.col("items") / F.col("total")).alias("per_item"), (F.col("tasks") / F.col("total")).alias("per_task"))


def kill_rate(predictions: DataFrame, gold: DataFrame, baseline: str, guarded: str, k: int = 10) -> DataFrame:
    """One row: of the tasks that the baseline's list reaches, the share that the
    guarded list loses; null without any."""
    hits = pairs_with_gold(predictions.where(F.col("rank") <= k), gold).groupBy("task_id").agg(
        F.max((F.col("strategy") == baseline) & F.col("file_hit")).alias("base"), F.max((F.col("strategy") == guarded) & F.col("file_hit")).alias("kept")
    )
    return hits.agg((F.count_if(F.col("base") & ~F.col("kept")) / F.nullif(F.count_if("base"), F.lit(0))).alias("kill_rate"))


def bucket_metrics(predictions: DataFrame, gold: DataFrame, tasks: DataFrame, bucket: str, k: int = 10) -> DataFrame:
    """strategy, bucket, n_tasks, file_recall, mrr by a label of the tasks."""
    one = pairs_with_gold(predictions, gold).groupBy("strategy", "task_id").agg(
        F.max((F.col("file_hit") & (F.col("rank") <= k)).cast("int")).alias("hit"), F.min(F.when(F.col("file_hit"), F.col("rank"))).alias("first")
    )
    every = by_gold_task(one, predictions.select("strategy").distinct(), gold).join(tasks.select("task_id", F.col(bucket).alias("bucket")), "task_id")
    return every.groupBy("strategy", "bucket").agg(
        F.count("*").alias("n_tasks"), F.avg(F.coalesce("hit", F.lit(0))).alias("file_recall"),
        F.avg(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
    )


def utility(scores: DataFrame) -> DataFrame:
    """Adds utility: file hit + MRR / 4 + span F / 2, less 1/4 without a file."""
    return scores.withColumn(
        "utility", F.col("file_recall") + 0.25 * F.col("mrr") + 0.5 * F.col("span_f") - F.when(F.col("file_recall") == 0, 0.25).otherwise(0.0)
    )


def deltas(scores: DataFrame, baseline: str, measures: list[str]) -> DataFrame:
    """Each strategy's measures less the baseline's."""
    base = scores.where(F.col("strategy") == baseline).select(*[F.col(m).alias(f"_{m}") for m in measures])
    return scores.crossJoin(F.broadcast(base)).select("strategy", *[(F.col(m) - F.col(f"_{m}")).alias(f"delta_{m}") for m in measures])


# ----------------------------------------------------------------------- reach
def reach(predictions: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """strategy, task_id, file_reach, span_reach of tasks with gold."""
    hits = pairs_with_gold(predictions.where(F.col("rank") <= k), gold).groupBy("strategy", "task_id").agg(
        F.max("file_hit").alias("file_reach"), F.max("span_hit").alias("span_reach")
    )
    every = by_gold_task(hits, predictions.select("strategy").distinct(), gold)
    return every.select("strategy", "task_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("file_reach", "span_reach")])


def unique_reach(reached: DataFrame, column: str = "file_reach") -> DataFrame:
    """strategy, n_reached, n_unique (reached by no other strategy)."""
    n = F.sum(F.col(column).cast("int")).over(Window.partitionBy("task_id"))
    return reached.withColumn("n", n).groupBy("strategy").agg(
        F.count_if(F.col(column)).alias("n_reached"), F.count_if(F.col(column) & (F.col("n") == 1)).alias("n_unique")
    )


def pairwise_overlap(reached: DataFrame, column: str = "file_reach") -> DataFrame:
    """a, b, n_both, n_any, jaccard for each two strategies (a < b)."""
    got = reached.where(F.col(column)).select("task_id", "strategy")
    both = got.alias("x").join(got.alias("y"), "task_id").where("x.strategy < y.strategy").groupBy(
        F.col("x.strategy").alias("a"), F.col("y.strategy").alias("b")
    ).agg(F.count("*").alias("n_both"))
    n = got.groupBy("strategy").agg(F.count("*").alias("n"))
    out = both.join(F.broadcast(n.withColumnRenamed("strategy", "a").withColumnRenamed("n", "na")), "a").join(
        F.broadcast(n.withColumnRenamed("strategy", "b").withColumnRenamed("n", "nb")), "b")
    n_any = F.col("na") + F.col("nb") - F.col("n_both")
    return out.select("a", "b", "n_both", n_any.alias("n_any"), (F.col("n_both") / n_any).alias("jaccard"))


def marginal_gain(reached: DataFrame, order: list[str], column: str = "file_reach") -> DataFrame:
    """strategy, place, gain: tasks that each strategy reaches first when they
    are added in a given order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    first = reached.where(F.col(column)).where(place > 0).groupBy("task_id").agg(F.min(place).alias("place"))
    counted = first.groupBy("place").agg(F.count("*").alias("gain"))
    listed = reached.sparkSession.createDataFrame(list(enumerate(order, 1)), "place long, strategy string")
    return listed.join(counted, "place", "left").select("strategy", "place", F.coalesce("gain", F.lit(0)).alias("gain"))


def failure_funnel(predictions: DataFrame, gold: DataFrame, strategy: str, shallow: int = 5) -> DataFrame:
    """bucket, n_tasks: the first stage at which each task with gold fails."""
    own = pairs_with_gold(predictions.where(F.col("strategy") == strategy), gold).groupBy("task_id").agg(
        F.min("rank").alias("best_rank"), F.max("file_hit").alias("file"), F.max("span_hit").alias("span")
    )
    every = gold.select("task_id").distinct().join(own, "task_id", "left")
    stage = F.when(F.col("best_rank").isNull(), "no_pool").when(F.col("best_rank") > shallow, "none_shallow").when(
        ~F.col("file"), "no_gold_file").when(~F.col("span"), "file_without_span").otherwise("span_reached")
    return every.groupBy(stage.alias("bucket")).agg(F.count("*").alias("n_tasks"))


def reach_cost(predictions: DataFrame, gold: DataFrame, cuts: list[int]) -> DataFrame:
    """strategy, k, file_reach, span_reach, avg_lines for each cut, in one pass."""
    hits = pairs_with_gold(predictions, gold).join(gold.select("task_id").distinct(), "task_id", "left_semi")
    spread = hits.select("*", F.explode(F.array(*map(F.lit, cuts))).alias("k")).where("rank <= k")
    lines = F.col("end_line") - F.col("start_line") + 1
    task = spread.groupBy("strategy", "k", "task_id").agg(F.max("file_hit").alias("f"), F.max("span_hit").alias("s"), F.sum(lines).alias("n"))
    return task.groupBy("strategy", "k").agg(F.count_if("f").alias("file_reach"), F.count_if("s").alias("span_reach"), F.avg("n").alias("avg_lines"))


def inherited_false_positives(predictions: DataFrame, tasks: DataFrame, gold: DataFrame, source: str, fused: str) -> DataFrame:
    """task_id of tasks without gold where both lists are non-empty."""
    lists = predictions.where(F.col("strategy").isin(source, fused)).groupBy("task_id").agg(F.countDistinct("strategy").alias("n"))
    return tasks.select("task_id").join(gold, "task_id", "left_anti").join(lists.where("n = 2"), "task_id", "left_semi")


def pareto(points: DataFrame, larger: list[str], smaller: list[str]) -> DataFrame:
    """Points that no other dominates: at least as good in all, better in one."""
    a, b = points.alias("a"), points.alias("b")
    def col(side: str, c: str) -> Column:
        return F.col(f"{side}.{c}")
    as_good, better = F.lit(True), F.lit(False)
    for c in larger:
        as_good, better = as_good & (col("b", c) >= col("a", c)), better | (col("b", c) > col("a", c))
    for c in smaller:
        as_good, better = as_good & (col("b", c) <= col("a", c)), better | (col("b", c) < col("a", c))
    # Points are settings of a sweep, not data rows.
    return a.join(F.broadcast(b), as_good & better, "left_anti")


def calibration_cells(rows: DataFrame, gold: DataFrame) -> DataFrame:
    """anchor, risk, support (null: all), n_tasks, n_gold over all combinations."""
    golden = gold.select("task_id").distinct().withColumn("_g", F.lit(1))
    return rows.join(golden, "task_id", "left").cube("anchor", "risk", "support").agg(
        F.count("*").alias("n_tasks"), F.count("_g").alias("n_gold")
    )


def label_consistency(tasks: DataFrame, labels: DataFrame, repos: DataFrame) -> DataFrame:
    """check, n: ids that repeat, that only one side has, and unknown repositories.
    Both sides are counted by id first, so that the full join has one row an id."""
    t = tasks.groupBy("task_id").agg(F.count("*").alias("n_t"))
    both = t.join(labels.groupBy("task_id").agg(F.count("*").alias("n_l")), "task_id", "full_outer")
    known = repos.select("repo_id").distinct().withColumn("_k", F.lit(1))
    strange = tasks.select("repo_id").distinct().join(known, "repo_id", "left").agg(F.count_if(F.col("_k").isNull()).alias("n"))
    checks = {
        "duplicate_task": F.count_if(F.col("n_t") > 1), "duplicate_label": F.count_if(F.col("n_l") > 1),
        "missing_label": F.count_if(F.col("n_l").isNull()), "missing_task": F.count_if(F.col("n_t").isNull()),
    }
    counted = both.agg(*[c.alias(n) for n, c in checks.items()])
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("n")) for n in checks])).alias("c")
    return counted.select(each).select("c.*").unionByName(strange.select(F.lit("unknown_repo").alias("check"), "n"))


def delta_spread(scores: DataFrame, measure: str, baseline: str, group: str = "bucket") -> DataFrame:
    """strategy, spread: how far the gain over the baseline differs between groups."""
    base = scores.where(F.col("strategy") == baseline).select(group, F.col(measure).alias("_base"))
    gains = scores.join(base, group).withColumn("_gain", F.col(measure) - F.col("_base"))
    return gains.groupBy("strategy").agg((F.max("_gain") - F.min("_gain")).alias("spread"), F.countDistinct(group).alias("n_groups"))


def failure_clusters(predictions: DataFrame, gold: DataFrame, fused: str = "rrf") -> DataFrame:
    """cluster, n_tasks over tasks with gold: what the channels missed that the
    fused list holds, and what no channel holds."""
    found = pairs_with_gold(predictions, gold).groupBy("task_id", "strategy").agg(F.max("file_hit").alias("_h"))
    wide = gold.select("task_id").distinct().join(
        found.groupBy("task_id").agg(*[
            F.coalesce(F.bool_or(F.when(F.col("strategy") == s, F.col("_h").cast("boolean"))), F.lit(False)).alias(s) for s in (fused, "symbol", "regex", "bm25")
        ]), "task_id", "left",
    ).na.fill(False)
    c = F.col
    clusters = {
        "symbol_miss": c(fused) & ~c("symbol"), "regex_miss": c(fused) & ~c("regex"), "bm25_miss": c(fused) & ~c("bm25"),
        "fusion_lost": ~c(fused) & (c("symbol") | c("regex") | c("bm25")), "no_channel": ~c(fused) & ~c("symbol") & ~c("regex") & ~c("bm25"),
    }
    held = F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in clusters.items()])))
    return wide.select("task_id", held.alias("cluster")).groupBy("cluster").agg(F.count("*").alias("n_tasks"))


def span_gaps(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, gap_start, gap_end: lines between spans that no span holds."""
    w = Window.partitionBy(*keys).orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    far = spans.select(*keys, "start_line", "end_line").withColumn("_far", F.max("end_line").over(w))
    return far.where(F.col("start_line") > F.col("_far") + 1).select(
        *keys, (F.col("_far") + 1).alias("gap_start"), (F.col("start_line") - 1).alias("gap_end")
    )


def line_scores(predictions: DataFrame, gold: DataFrame, judged: DataFrame, k: int = 10) -> DataFrame:
    """strategy, line_precision, line_recall of the first-generation scorer: the
    averages over the strategy's own tasks among ``judged`` (task_id), where a
    task without gold lines has recall one and a list without lines precision
    zero. predictions: one row a task at least; a null path means no hit."""
    own = predictions.join(judged.select("task_id").distinct(), "task_id", "left_semi")
    top = own.where((F.col("rank") <= k) & F.col("path").isNotNull() & (F.col("start_line") <= F.col("end_line")))
    p = merged_spans(top, ["strategy", "task_id", "path"])
    g = merged_spans(gold, ["task_id", "path"])
    gg = g.select("task_id", "path", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))
    shared = p.join(gg, ["task_id", "path"]).select(
        "strategy", "task_id", F.greatest("start_line", "gs").alias("start_line"), F.least("end_line", "ge").alias("end_line")
    ).where("start_line <= end_line")
    both = F.coalesce("n_both", F.lit(0))
    per = (
        own.select("strategy", "task_id").distinct().join(_length(p, ["strategy", "task_id"], "n_pred"), ["strategy", "task_id"], "left")
        .join(_length(shared, ["strategy", "task_id"], "n_both"), ["strategy", "task_id"], "left").join(_length(g, ["task_id"], "n_gold"), "task_id", "left")
    )
    return per.groupBy("strategy").agg(
        F.avg(F.coalesce(both / F.col("n_pred"), F.lit(0.0))).alias("line_precision"),
        F.avg(F.when(F.col("n_gold").isNull(), 1.0).otherwise(both / F.col("n_gold"))).alias("line_recall"),
    )


def span_contribution(predictions: DataFrame, gold: DataFrame, baseline: str) -> DataFrame:
    """strategy, added_gold, added_false, n_tasks, n_blocked, blocked: the lines
    that each strategy adds to the baseline's, over tasks with gold; a task is
    blocked if more of them are false than gold, a strategy likewise in all.

    Lines are counted by intervals: what a strategy has beyond the baseline is
    the union of both less the baseline."""
    with_gold = predictions.join(gold.select("task_id").distinct(), "task_id", "left_semi").where("start_line <= end_line")
    base = merged_spans(with_gold.where(F.col("strategy") == baseline), ["task_id", "path"])
    own = with_gold.where(F.col("strategy") != baseline).select("strategy", "task_id", "path", "start_line", "end_line")
    # The baseline's spans come along with every strategy of their task.
    joined = own.select("strategy", "task_id").distinct().join(base, "task_id").select(*own.columns)
    keys = ["strategy", "task_id", "path"]
    g = merged_spans(gold, ["task_id", "path"]).select("task_id", "path", F.col("start_line").alias("gs"), F.col("end_line").alias("ge"))

    def covered(spans: DataFrame, sign: int) -> DataFrame:
        """The lines of the spans' union, and how many of them are gold."""
        n = F.col("end_line") - F.col("start_line") + 1
        common = F.when(F.col("gs").isNotNull(), F.greatest(F.lit(0), F.least("end_line", "ge") - F.greatest("start_line", "gs") + 1)).otherwise(0)
        per = merged_spans(spans, keys).join(g, ["task_id", "path"], "left").groupBy(*keys, "start_line", "end_line").agg(F.sum(common).alias("good"))
        return per.groupBy("strategy", "task_id").agg((sign * F.sum("good")).alias("good"), (sign * F.sum(n)).alias("lines"))

    added = covered(own.unionByName(joined), 1).unionByName(covered(joined, -1)).groupBy("strategy", "task_id").agg(
        F.sum("good").alias("good"), (F.sum("lines") - F.sum("good")).alias("false")
    )
    some = (F.col("good") + F.col("false")) > 0
    return added.groupBy("strategy").agg(
        F.sum("good").alias("added_gold"), F.sum("false").alias("added_false"), F.count_if(some).alias("n_tasks"),
        F.count_if(F.col("false") > F.col("good")).alias("n_blocked"), (F.sum("false") > F.sum("good")).alias("blocked"),
    )


def path_pollution(predictions: DataFrame, folders: list[str]) -> DataFrame:
    """strategy, pollution: the share of a strategy's rows in any of the folders,
    at whatever depth."""
    bad = F.arrays_overlap(F.split(F.regexp_replace("path", r"\\", "/"), "/"), F.array(*[F.lit(f.strip("/")) for f in folders]))
    return predictions.groupBy("strategy").agg(F.avg(F.coalesce(bad, F.lit(False)).cast("int")).alias("pollution"))


def score_matrix(predictions: DataFrame, gold: DataFrame, tasks: DataFrame, baseline: str) -> DataFrame:
    """One row a strategy with its file, span, waste and abstention metrics, and
    its waste less the baseline's."""
    recall = [
        file_metrics(predictions, gold, k).select("strategy", F.col("file_recall").alias(f"recall_{k}")) for k in (1, 3, 5)
    ]
    parts = [*recall, file_metrics(predictions, gold).select("strategy", "mrr"), span_metrics(predictions, gold),
             token_waste(predictions, gold), negative_rates(predictions, tasks, gold)]
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, "strategy", "left")
    own = out.where(F.col("strategy") == baseline).select(F.col("token_waste").alias("_base"))
    return out.join(F.broadcast(own), how="left").withColumn("waste_delta", F.col("token_waste") - F.col("_base")).drop("_base")
