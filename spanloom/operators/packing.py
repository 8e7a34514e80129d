"""Packing: reorderings, span windows, and the sequential budget policies.

Reorderings are sort keys over windows of a task's list. Only the policies
whose every step depends on what is accepted so far run in Python, one task's
candidates (a short list) at a time.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hybrids import RISK_PATH

TASK = ["strategy", "task_id"]


#: Items that a task orders at once, where it holds several orders of them.
ITEMS_A_TASK = 100_000


def dealt(df: DataFrame, rows: int) -> DataFrame:
    """``df`` dealt by task into so many parts that each has about ITEMS_A_TASK
    of its ``rows``. Windows by task then work within the parts; parts made by
    their size in bytes would hold millions of such short rows. By task_id alone:
    Spark drops a constant strategy from the windows, and would deal anew."""
    parts = max(-(-rows // ITEMS_A_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(parts, "task_id")


def reranked(df: DataFrame, *keys, by: list[str] = TASK) -> DataFrame:
    """``df`` with new_rank by sort keys; the old rank breaks ties."""
    return df.withColumn("new_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*keys, "rank")))


def distinct_file_pack(items: DataFrame, prefix: int = 10, per_file: int = 1) -> DataFrame:
    """The first ``prefix`` items with at most ``per_file`` of a file lead."""
    nth = F.row_number().over(Window.partitionBy(*TASK, "path").orderBy("rank"))
    marked = items.withColumn("_ok", nth <= per_file)
    place = F.sum(F.col("_ok").cast("int")).over(Window.partitionBy(*TASK).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    lead = F.when(F.col("_ok") & (place <= prefix), 0).otherwise(1)
    return reranked(marked.withColumn("_lead", lead), "_lead").drop("_ok", "_lead")


def prefix_pack(items: DataFrame, keep: int, size: int = 10) -> DataFrame:
    """Keeps a prefix, then fills up to ``size`` with files not seen before."""
    nth = F.row_number().over(Window.partitionBy(*TASK, "path").orderBy("rank"))
    fresh = items.withColumn("_new", (F.col("rank") > keep) & (nth == 1))
    order = Window.partitionBy(*TASK).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    room = F.sum(F.col("_new").cast("int")).over(order) <= size - keep
    lead = F.when(F.col("rank") <= keep, 0).when(F.col("_new") & room, 1).otherwise(2)
    return reranked(fresh.withColumn("_lead", lead), "_lead").drop("_new", "_lead")


def deep_promotion(items: DataFrame, variant: str) -> DataFrame:
    """Promotes deep ranks: ``swap`` puts 11-20 before 6-10; ``interleave``
    alternates 6-10 with 11-15, then 16-20; ``top7`` puts 11-13 before 8-10;
    ``limited5`` puts 11-15 before 6-10; ``interleave5`` alternates 6-10 with
    11-15 only."""
    r = F.col("rank")
    alternate = F.when(r.between(6, 10), 2 * (r - 5) + 5).when(r.between(11, 15), 2 * (r - 10) + 6)
    key = {
        "swap": F.when(r <= 5, r).when(r.between(11, 20), r - 5).when(r.between(6, 10), r + 10),
        "interleave": F.when(r <= 5, r).when(r <= 15, alternate).when(r <= 20, r + 2),
        "top7": F.when(r <= 7, r).when(r.between(11, 13), r - 3).when(r.between(8, 10), r + 3),
        "limited5": F.when(r <= 5, r).when(r.between(11, 15), r - 5).when(r.between(6, 10), r + 5),
        "interleave5": F.when(r <= 5, r).when(r <= 15, alternate),
    }[variant]
    return reranked(items, F.coalesce(key, r + 1000))


def deep_first(items: DataFrame, after: int = 20) -> DataFrame:
    return reranked(items, F.when(F.col("rank") > after, 0).otherwise(1))


def novel_first(items: DataFrame, old: DataFrame) -> DataFrame:
    """Items of files outside the old pool (strategy, task_id, path) lead."""
    seen = old.select(*TASK, "path").distinct().withColumn("_old", F.lit(1))
    return reranked(items.join(seen, [*TASK, "path"], "left"), F.coalesce("_old", F.lit(0))).drop("_old")


def guarded_novel(items: DataFrame, old: DataFrame, guard: int = 5, size: int = 10) -> DataFrame:
    """The first ``guard`` items stay; then novel items of files not among them
    or each other, up to ``size``; then the rest."""
    seen = old.select(*TASK, "path").distinct().withColumn("_old", F.lit(1))
    nth = F.row_number().over(Window.partitionBy(*TASK, "path").orderBy("rank"))
    marked = items.join(seen, [*TASK, "path"], "left").withColumn(
        "_ok", F.col("_old").isNull() & (F.col("rank") > guard) & (nth == 1)
    )
    order = Window.partitionBy(*TASK).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    lead = F.when(F.col("rank") <= guard, 0).when(F.col("_ok") & (F.sum(F.col("_ok").cast("int")).over(order) <= size - guard), 1).otherwise(2)
    return reranked(marked.withColumn("_lead", lead), "_lead").drop("_old", "_ok", "_lead")


def difference_aware(items: DataFrame, old: DataFrame, size: int = 10, guard: int = 5) -> DataFrame:
    """rule, strategy, task_id, rank, new_rank: eight rules that mix or choose
    between two orders, by how a task's list differs from the old pool.

    *full*: the novel items, then the others, ``size`` in all, then the rest by
    rank; *guarded*: ``guarded_novel``. Two rules mix them: eight of the full
    order, then two of the guarded, and three of the guarded, then seven of the
    full. The others take one order or the other, by repeated files and novel
    items among the first five, or many novel ones (over ten, eight or more
    among the first ten). An item is novel if its path isn't in ``old``
    (strategy, task_id, path). Ranks run from 1 without gaps.
    """
    c, task = F.col, Window.partitionBy(*TASK)
    so_far = task.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    seen = old.select(*TASK, "path").distinct().withColumn("_old", F.lit(1))
    m = dealt(items.join(seen, [*TASK, "path"], "left"), items.count()).withColumn("_novel", c("_old").isNull())
    first = F.row_number().over(Window.partitionBy(*TASK, "path").orderBy("rank")) == 1
    m = m.withColumn("_add", (first & c("_novel") & (c("rank") > guard)).cast("int"))
    nth, added = F.row_number().over(task.orderBy(F.desc("_novel"), "rank")), F.sum("_add").over(so_far)
    count = lambda cond: F.sum(cond.cast("int")).over(task)
    top = c("rank") <= 5
    m = m.withColumns({
        "_full": F.when(nth <= size, nth).otherwise(size + c("rank")),
        "_guard": F.when(c("rank") <= guard, c("rank")).when((c("_add") == 1) & (added <= size - guard), guard + added).otherwise(size + c("rank")),
        "_dup": count(top & c("path").isNotNull()) - F.size(F.collect_set(F.when(top, c("path"))).over(task)),
        "_new5": count(top & c("_novel")), "_old5": count(top & ~c("_novel")),
        "_new10": count((c("rank") <= 10) & c("_novel")), "_new": count(c("_novel")),
    })

    def mixed(lead: str, n: int, then: str) -> Column:
        chosen = c(lead) <= n
        place = F.row_number().over(Window.partitionBy(*TASK, chosen).orderBy(then))
        return F.when(chosen, c(lead)).when(place <= size - n, n + place).otherwise(size + c("rank"))

    m = m.withColumns({"_f8": mixed("_full", 8, "_guard"), "_g3": mixed("_guard", 3, "_full")})
    guarded_if = lambda cond: F.when(cond, c("_guard")).otherwise(c("_full"))
    deep = (c("_new") > 10) & (c("_new10") >= 8)
    rules = {
        "full8_guard2": c("_f8"), "guard3_full7": c("_g3"), "dup_guard": guarded_if(c("_dup") > 0), "novel_top5_guard": guarded_if(c("_new5") >= 4),
        "keep_top5_guard": guarded_if((c("_dup") > 0) | (c("_old5") > 0)), "deep_full8": F.when(deep, c("_f8")).otherwise(c("_guard")),
        "deep_full": guarded_if(~deep), "dup_or_few_novel_guard": guarded_if((c("_dup") > 0) | (c("_new5") <= 2)),
    }
    each = F.array(*[F.struct(F.lit(name).alias("rule"), key.cast("long").alias("_key")) for name, key in rules.items()])
    rows = m.select(*TASK, "rank", F.explode(each).alias("r")).select(*TASK, "rank", "r.*")
    return reranked(rows, "_key", by=[*TASK, "rule"]).drop("_key")


def alternate(first: DataFrame, second: DataFrame, size: int = 10) -> DataFrame:
    """Takes turns between two orders (new_rank) of the same items; the last
    ones keep their rank. An item goes at the first turn that offers it."""
    keys = [*TASK, "rank"]
    a = first.select(*keys, "path", F.col("new_rank").alias("_a"))
    b = second.select(*keys, F.col("new_rank").alias("_b"))
    turn = F.least(2 * F.col("_a"), 2 * F.col("_b") + 1)
    return reranked(a.join(b, keys), turn).drop("_a", "_b")


def length_bucket(start: Column, end: Column) -> Column:
    n = end - start + 1
    return F.when(n <= 10, "short").when(n <= 30, "medium").otherwise("long")


def expand_spans(items: DataFrame, before: int = 75, after: int = 225, buckets: tuple[str, ...] = ("short",), top: int | None = None) -> DataFrame:
    """Widens spans of the given length buckets (``top``: all of the first ranks
    by 200 either way); a start is never under one."""
    bucket = length_bucket(F.col("start_line"), F.col("end_line"))
    fits = bucket.isin(*buckets)
    head = (F.col("rank") <= top) if top else F.lit(False)
    b = F.when(head, 200).when(fits, before).otherwise(0)
    a = F.when(head, 200).when(fits, after).otherwise(0)
    return items.select("*", F.greatest(F.lit(1), F.col("start_line") - b).alias("new_start"), (F.col("end_line") + a).alias("new_end"))


def tightness(start: Column, end: Column) -> Column:
    n = end - start + 1
    return F.when(n <= 0, 0.0).when(n <= 10, 1.0).when(n <= 20, 0.5).when(n <= 50, 0.25).otherwise(0.0)


def random_arm(items: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """A seeded random choice of ``budget`` items, by hash, for each task."""
    draw = F.xxhash64(F.lit(seed), *TASK, "rank")
    return reranked(items, draw).where(F.col("new_rank") <= budget)


# -------------------------------------------------------- sequential policies
CANDIDATES = "task_id long, path string, start_line long, end_line long, agreement long, min_rank long, max_score double"


def agreed_candidates(predictions: DataFrame) -> DataFrame:
    """One row for each task and span: how many methods found it and which, the
    best rank, and the best score relative to its method's best. Rows are dealt
    by task once, which serves the window, the groups and what follows."""
    best = F.max("score").over(Window.partitionBy("task_id", "strategy"))
    dealt = predictions.repartition("task_id")
    return dealt.withColumn("_norm", F.col("score") / F.nullif(best, F.lit(0))).groupBy("task_id", "path", "start_line", "end_line").agg(
        F.min("rank").cast("long").alias("min_rank"), F.max("_norm").alias("max_score"), F.array_sort(F.collect_set("strategy")).alias("methods"),
    ).withColumn("agreement", F.size("methods").cast("long"))


def _each_task(candidates: DataFrame, pick: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """The rows that ``pick`` takes of each task's list, with their place. Spark
    makes and orders the lists, workers get batches of them."""
    given = [c for c in candidates.columns if c != "task_id"]
    falling = lambda c: F.coalesce(-F.col(c), F.lit(float("inf")))
    last = lambda c: F.col(c).isNull()
    key = F.struct(falling("agreement").alias("a"), last("min_rank").alias("b"), F.col("min_rank").alias("c"), falling("max_score").alias("d"),
                   last("path").alias("e"), F.col("path").alias("f"), last("start_line").alias("g"), F.col("start_line").alias("h"), F.col("end_line").alias("i"))
    row = F.struct(key.alias("key"), F.struct(*given).alias("row"))
    lists = candidates.groupBy("task_id").agg(F.sort_array(F.collect_list(row)).alias("rows"))
    lists = lists.select("task_id", F.col("rows.row").alias("rows"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("task_id", "path", "start_line", "end_line", "place")}
            for task_id, rows in zip(batch.column("task_id").to_pylist(), batch.column("rows").to_pylist()):
                for place, row in enumerate(pick(rows), 1):
                    for c, value in (("task_id", task_id), ("path", row["path"]), ("start_line", row["start_line"]), ("end_line", row["end_line"]), ("place", place)):
                        out[c].append(value)
            yield pa.RecordBatch.from_pydict({c: pa.array(v, pa.string() if c == "path" else pa.int64()) for c, v in out.items()})

    return lists.mapInArrow(task, "task_id long, path string, start_line long, end_line long, place long")


def budgeted_acquisition(candidates: DataFrame, budget: int) -> DataFrame:
    """In order of agreement, rank and score: weakly supported candidates are
    skipped, agreed ones of a file already taken wait and fill what is left."""
    def pick(rows: list[dict]) -> list[dict]:
        taken, waiting, files = [], [], set()
        for row in rows:
            if len(taken) >= budget:
                break
            if row["agreement"] == 1 and row["min_rank"] > 5 and row["max_score"] is not None and row["max_score"] < 0.01:
                continue
            if row["agreement"] >= 2 and row["path"] in files:
                waiting.append(row)
                continue
            taken.append(row)
            files.add(row["path"])
        return (taken + waiting)[:budget]

    return _each_task(candidates, pick)


#: What a method's agreement weighs; others weigh a half.
METHOD_WEIGHTS = {"bm25": 1.0, "regex": 0.6, "symbol": 0.8, "rrf": 0.9}
#: File extensions, which tell nothing about a path's subject.
PLAIN_EXTENSIONS = {
    "py", "rs", "ts", "js", "go", "java", "c", "cpp", "h", "hpp", "md", "txt", "json", "toml", "yaml", "yml", "sh", "rb", "php", "kt", "swift",
}
_RISKY = re.compile(RISK_PATH)


def greedy_diversity(candidates: DataFrame, budget: int, queries: DataFrame | None = None) -> DataFrame:
    """Scores the remaining candidates again after each choice. For one count
    its methods by weight (of those of the whole task; without ``methods``, by
    number), its score, a new file and folder, and the words that its path
    shares with the query (``queries``: task_id, query); against it a risky path
    and a file taken already."""
    told = candidates if "methods" in candidates.columns else candidates.withColumn("methods", F.lit(None).cast("array<string>"))
    told = told.join(queries.select("task_id", "query"), "task_id", "left") if queries is not None else told.withColumn("query", F.lit(None).cast("string"))

    def pick(rows: list[dict]) -> list[dict]:
        methods = [list(r["methods"]) if r["methods"] is not None else [f"any{i}" for i in range(r["agreement"])] for r in rows]
        weigh = lambda names: sum(METHOD_WEIGHTS.get(m, 0.5) for m in names)
        every = weigh(set().union(*methods)) or 1.0
        asked = set(re.findall("[a-z0-9_]+", (rows[0]["query"] or "").lower()))
        fixed, folders = [], []
        for row, names in zip(rows, methods, strict=True):
            path = row["path"] or ""
            words = set(re.findall("[a-z0-9]+", path.lower())) - PLAIN_EXTENSIONS
            shared = len(asked & words) / len(asked | words) if asked and words else 0.0
            fixed.append(0.30 * weigh(names) / every + 0.20 * (row["max_score"] or 0.0) + 0.15 * shared - 0.25 * bool(_RISKY.search(path)))
            folders.append(path.rpartition("/")[0])
        left, taken, files, seen = list(range(len(rows))), [], set(), set()

        def priority(i: int) -> float:
            new_file, new_folder = rows[i]["path"] not in files, folders[i] != "" and folders[i] not in seen
            diversity = (0.5 if new_file else 0.0) + (0.5 if new_file and new_folder else 0.25 if new_folder else 0.0)
            return round(fixed[i] + 0.20 * diversity - (0.0 if new_file else 0.15), 6)

        while left and len(taken) < budget:
            best = max(left, key=lambda i: (priority(i), -i))
            left.remove(best)
            taken.append(rows[best])
            files.add(rows[best]["path"])
            seen.add(folders[best])
        return taken

    return _each_task(told, pick)


def anchored(candidates: DataFrame, budget: int, anchors: int = 3, least: float = 0.2) -> DataFrame:
    """Anchors (two methods or a first rank) fill the first slots; then tight
    spans near them; stops when nothing good is left."""
    def pick(rows: list[dict]) -> list[dict]:
        taken: list[dict] = []
        rest = list(rows)
        while rest and len(taken) < budget:
            files = {t["path"] for t in taken}
            def priority(row: dict) -> float:
                n = row["end_line"] - row["start_line"] + 1
                tight = 1.0 if n <= 10 else 0.5 if n <= 20 else 0.25 if n <= 50 else 0.0
                anchor = row["agreement"] >= 2 or row["min_rank"] == 1
                boost = 0.4 if anchor and len(taken) < anchors else 0.0
                near = 0.15 if row["path"] in files else 0.0
                return 0.3 * min(row["agreement"], 3) / 3 + 0.2 * (row["max_score"] or 0.0) + 0.15 * tight + boost + near - (0.2 if row["agreement"] == 1 and row["min_rank"] > 5 else 0.0)
            scores = [priority(r) for r in rest]
            best = max(range(len(rest)), key=lambda i: (scores[i], -i))
            if len(taken) >= anchors and scores[best] < least:
                break
            taken.append(rest.pop(best))
        return taken

    return _each_task(candidates, pick)


def contrast_pack(candidates: DataFrame, size: int = 6) -> DataFrame:
    """Slots: an anchor, its overlapping neighbour in the file, another part of
    the file, an anchor of another file, a weak candidate; then by order."""
    def pick(rows: list[dict]) -> list[dict]:
        if not rows:
            return []
        anchor = rows[0]
        overlaps = lambda r: r["start_line"] <= anchor["end_line"] and anchor["start_line"] <= r["end_line"]
        slots = [
            lambda r: r is anchor,
            lambda r: r["path"] == anchor["path"] and overlaps(r),
            lambda r: r["path"] == anchor["path"] and not overlaps(r),
            lambda r: r["path"] != anchor["path"] and r["agreement"] >= 2,
            lambda r: r["agreement"] == 1,
        ]
        taken: list[dict] = []
        for fits in [*slots, *[lambda r: True] * size]:
            found = next((r for r in rows if fits(r) and not any(r is t for t in taken)), None)
            if found is not None and len(taken) < size:
                taken.append(found)
        return taken

    return _each_task(candidates, pick)
