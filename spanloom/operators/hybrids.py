"""Vector lists under the anchors of lexical ones, and the filters before a vector search.

predictions: strategy, task_id, rank, path, start_line, end_line. One strategy
is the vector list, ``rrf``, ``symbol`` and ``regex`` are the anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import fusion

SPAN = ["path", "start_line", "end_line"]
TOKEN = r"([A-Za-z_][A-Za-z0-9_]{2,})"
#: Parts of a path that lower its priority.
RISK_PATH = (
    r"(?i)(^|/)(tests?|docs?|documentation|generated|vendor|node_modules|__pycache__|\.git|dist|build|target|out"
    r"|.*\.lock|.*\.config\.|.*\.toml|.*\.yaml|.*\.yml|.*\.json|.*\.md|.*\.txt|.*\.cfg|.*\.ini)(/|$)"
)
#: Words of a query that ask for a language, in order.
LANGUAGE_WORDS = {"python": ("python", "pytest"), "rust": ("rust", "cargo"), "config": ("config", "yaml", "toml")}


def unprefixed(path: Column, repo: Column) -> Column:
    """``path`` without one leading ``repo/``: the form in which a predicted
    path, written with or without its repository, equals a label's."""
    lead = F.concat(repo, F.lit("/"))
    return F.when((repo != "") & path.startswith(lead), F.substring(path, F.length(lead) + 1, F.length(path))).otherwise(path)


def path_matches(predicted: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``predicted`` (task_id, path, repo_id) with matched: whether a
    label (task_id, path) names that path, as it is or behind one ``repo_id/``.

    Both forms are looked up by equality, so a label that itself starts with
    the repository's name is met too."""
    forms = F.array_distinct(F.array("path", unprefixed(F.col("path"), F.coalesce("repo_id", F.lit("")))))
    known = labels.select("task_id", F.col("path").alias("_form")).distinct().withColumn("_hit", F.lit(True))
    found = predicted.select("task_id", "repo_id", "path").distinct().withColumn("_form", F.explode(forms)).join(known, ["task_id", "_form"], "left")
    told = found.groupBy("task_id", "repo_id", "path").agg(F.max(F.coalesce("_hit", F.lit(False))).alias("matched"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("task_id", "repo_id", "path")]
    return predicted.alias("p").join(told.alias("t"), same[0] & same[1] & same[2]).select("p.*", "t.matched")


def risk_bucket(path: Column) -> Column:
    """``unknown`` without a path, ``risk_penalty`` for tests, documents, built
    or configuration files, else ``normal``."""
    return F.when(F.coalesce(path, F.lit("")) == "", "unknown").when(path.rlike(RISK_PATH), "risk_penalty").otherwise("normal")


def _or_all(rows: DataFrame, kept: Column, key: str) -> DataFrame:
    """The kept rows, or every row of a key of which none is kept. One flag a
    key is looked up, so that a key's rows never meet in one task."""
    marked = rows.withColumn("_kept", kept)
    flags = marked.groupBy(key).agg(F.max("_kept").alias("_any"))
    return marked.join(flags, key).where(F.col("_kept") | ~F.col("_any")).drop("_kept", "_any")


def layout_filter(pairs: DataFrame, layout: str, key: str = "query_id") -> DataFrame:
    """Candidates (``key``, query, path, language) that a layout admits.

    ``per_language``: those of the language that the query names, if any are;
    ``source_vs_test_split``: tests for queries on tests, else the others, or
    all if none are left; ``generated_excluded``: no built or foreign files;
    any other layout: all."""
    query, path = F.lower("query"), F.lower("path")
    if layout == "generated_excluded":
        return pairs.where(~path.rlike("generated|vendor|node_modules|dist|build"))
    if layout == "source_vs_test_split":
        kept = path.contains("test") == query.rlike(r"\b(test|spec|assert|pytest)\b")
    elif layout == "per_language":
        wanted = F.lit(None).cast("string")
        for language, marks in reversed(LANGUAGE_WORDS.items()):
            wanted = F.when(query.rlike("|".join(marks)), language).otherwise(wanted)
        kept = wanted.isNull() | (F.col("language") == wanted)
    else:
        return pairs
    return _or_all(pairs, F.coalesce(kept, F.lit(False)), key)


def anchor_filter(pairs: DataFrame) -> DataFrame:
    """Candidates (query, path, text) whose path or text holds a name of the
    query, in either case; all for a query without names."""
    names = F.regexp_extract_all(F.lower("query"), F.lit(TOKEN), F.lit(1))
    hay = F.concat_ws(" ", F.lower("path"), F.lower("text"))
    return pairs.where((F.size(names) == 0) | F.exists(names, lambda t: F.contains(hay, t)))


def anchor_files(predictions: DataFrame, order: tuple[str, ...], n: int) -> DataFrame:
    """task_id, path: each task's first ``n`` files of the given lists, one list
    after the other."""
    turn = F.array_position(F.array(*map(F.lit, order)), F.col("strategy"))
    first = predictions.where(F.col("strategy").isin(*order) & (F.coalesce("path", F.lit("")) != "")).groupBy("task_id", "path").agg(F.min(F.struct(turn, "rank")).alias("_at"))
    place = F.row_number().over(Window.partitionBy("task_id").orderBy("_at", "path"))
    return first.withColumn("_n", place).where(F.col("_n") <= n).select("task_id", "path")


def _closed_up(items: DataFrame, *order: str, top: int | None = None) -> DataFrame:
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("task_id").orderBy(*(order or ("rank",)))))
    return ranked.where(F.col("rank") <= top) if top else ranked


def hybrid_strategies(predictions: DataFrame, noisy: DataFrame, dense: str, top_k: int = 10, files: int = 5) -> DataFrame:
    """strategy, task_id, rank, path, start_line, end_line of six ways to use a
    vector list:

    ``only``; ``in_fused_files`` and ``in_symbol_regex_files``: what lies in the
    anchors' first files; ``supporting``: the fused list, then what lies in any
    anchor file, for tasks with a fused list; ``late_fusion``: both fused by
    rank (ties by span); ``guarded``: that, but nothing for ``noisy`` tasks
    (task_id).
    """
    cols = ["task_id", "rank", *SPAN]
    vector, fused = (predictions.where(F.col("strategy") == s).select(*cols) for s in (dense, "rrf"))
    of_fused, of_names = anchor_files(predictions, ("rrf",), files), anchor_files(predictions, ("symbol", "regex"), files)
    held = lambda paths: _closed_up(vector.join(paths, ["task_id", "path"], "left_semi").select(*cols))
    in_any = held(of_fused.union(of_names))
    lists = fused.withColumn("_turn", F.lit(0)).unionByName(in_any.withColumn("_turn", F.lit(1)))
    behind = lists.join(fused.select("task_id").distinct(), "task_id", "left_semi")
    once = behind.groupBy("task_id", *SPAN).agg(F.min(F.struct("_turn", "rank")).alias("_at"))
    score = fusion.rrf(lists.withColumn("channel", F.col("_turn").cast("string")), ["task_id", *SPAN]).withColumn("_down", -F.round("score", 12))
    late = _closed_up(score, "_down", *SPAN, top=top_k)
    made = {
        "only": _closed_up(vector, top=top_k), "in_fused_files": held(of_fused).where(F.col("rank") <= top_k),
        "in_symbol_regex_files": held(of_names).where(F.col("rank") <= top_k), "supporting": _closed_up(once, "_at", *SPAN, top=top_k),
        "late_fusion": late, "guarded": late.join(noisy, "task_id", "left_anti"),
    }
    out = None
    for name, rows in made.items():
        rows = rows.select(F.lit(name).alias("strategy"), *cols)
        out = rows if out is None else out.unionByName(rows)
    return out
