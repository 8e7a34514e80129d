"""Derived views, embedding gates, audit and trace logs, leakage checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.size import bounded
from ..functions.storage import scratch
from .manypatterns import containing

#: Markers and prefixes that block an embedding input.
SECRET_MARKERS = ("SECRET", "TOKEN", "PASSWORD", "API_KEY", "PRIVATE_KEY")
SECRET_PREFIXES = ("sk_", "ghp_", "AKIA")
#: Parts and prefixes of names that are not given out.
SECRET_NAMES = (
    "SECRET", "TOKEN", "PASSWORD", "PASSWD", "API_KEY", "APIKEY", "PRIVATE_KEY", "PRIVATEKEY", "AUTH_KEY", "ACCESS_KEY", "SECRET_KEY",
)
SECRET_NAME_PREFIXES = ("sk_", "ghp_", "gho_", "xox", "AKIA")


def _one(c: Column) -> Column:
    return F.when(c, 1).otherwise(0)


def secret_scan(text: Column) -> Column:
    """``clean`` or ``blocked:`` with the first reason in fixed order."""
    out = F.lit(None).cast("string")
    mixed = lambda t: (
        _one(t.rlike("[a-z]")) + _one(t.rlike("[A-Z]")) + _one(t.rlike("[0-9]")) + _one(t.rlike(r"[^\p{L}\p{N}]")) >= 3
    )
    dense = F.exists(F.split(text, r"\s+", -1), lambda t: (F.octet_length(t) >= 32) & mixed(t))
    out = F.when(dense, "blocked:high_entropy_string").otherwise("clean")
    for p in reversed(SECRET_PREFIXES):
        out = F.when(text.contains(p), "blocked:prefix_" + p.replace("_", "")).otherwise(out)
    for m in reversed(SECRET_MARKERS):
        out = F.when(F.upper(text).contains(m), "blocked:contains_" + m.lower()).otherwise(out)
    return out


def is_secret_name(name: Column) -> Column:
    out = F.lit(False)
    for part in SECRET_NAMES:
        out = out | F.upper(name).contains(part)
    for prefix in SECRET_NAME_PREFIXES:
        out = out | name.startswith(prefix)
    classes = _one(name.rlike(r"\p{Lu}")) + _one(name.rlike(r"\p{Ll}")) + _one(name.rlike("[0-9]"))
    return out | ((F.octet_length(name) >= 24) & name.rlike(r"^[\p{L}\p{N}_]+$") & (classes >= 2))


def gate(inputs: DataFrame, policy: dict, provider: dict) -> DataFrame:
    """``inputs`` (text, data_level) with secret_scan, allowed and reason: the
    first refusal in fixed order."""
    level, scan = F.col("data_level"), secret_scan(F.col("text"))
    remote = provider["locality"] == "remote"
    says = lambda what, most: F.concat(F.lit("data_level_"), level, F.lit(f"_exceeds_{what}_{most}"))
    reason = F.lit(None).cast("string")
    reason = F.when(level > provider["max_data_level"], says("provider_max", provider["max_data_level"])).otherwise(F.lit("allowed"))
    if remote:
        reason = F.when(level > policy["max_data_level"], says("remote_max", policy["max_data_level"])).otherwise(reason)
        if provider["provider_id"] not in policy["allowed_providers"]:
            reason = F.lit(f"provider_{provider['provider_id']}_not_in_allowed_list")
        if not policy["allow_embedding"]:
            reason = F.lit("remote_embedding_not_allowed_by_policy")
        if not policy["allow_remote"]:
            reason = F.lit("remote_not_allowed_by_policy")
    else:
        reason = F.when(level > 1, says("local_max", 1)).otherwise(reason)
    if policy["block_on_match"]:
        reason = F.when(F.col("secret_scan") != "clean", F.concat(F.lit("secret_blocked:"), "secret_scan")).otherwise(reason)
    if provider["locality"] == "disabled":
        scan, reason = F.lit("skipped"), F.lit("provider_disabled")
    return inputs.withColumn("secret_scan", scan).withColumn("reason", reason).withColumn("allowed", F.col("reason") == "allowed")


# --------------------------------------------------------------- derived views
IDENTIFIER = r"([\p{L}\p{N}_]+)"


def identifiers(line: Column) -> Column:
    """Names of two or more bytes in a line that are neither keywords nor
    secret-like; of a line that gives a name a quoted value, those before its
    first equals sign."""
    body = F.when(T.is_string_assignment(F.trim(line)), F.substring_index(line, "=", 1)).otherwise(line)
    found = F.regexp_extract_all(body, F.lit(IDENTIFIER), F.lit(1))
    return F.filter(found, lambda n: (F.octet_length(n) >= 2) & ~T.is_keyword(n) & ~is_secret_name(n))


def derived_views(chunks: DataFrame, kind: str, most: int) -> DataFrame:
    """view_id, path, start_line, end_line, content_sha, kind, tags: identifier
    tags (``symbol_tags``) or the parts of the identifiers (``query_aliases``)
    of a chunk, in order of first use, at most ``most``."""
    lines = F.split("content", "\n", -1)
    names = F.array_distinct(F.flatten(F.transform(lines, identifiers)))
    if kind == "query_aliases":
        names = F.array_distinct(F.flatten(F.transform(names, T.split_identifier)))
    vid = T.view_id("path", F.col("start_line"), F.col("end_line"), "content_sha", F.lit(kind), F.lit("static"), F.lit("1"))
    return chunks.select(
        vid.alias("view_id"), "path", "start_line", "end_line", "content_sha", F.lit(kind).alias("kind"), F.slice(names, 1, most).alias("tags")
    )


def chunk_summaries(chunks: DataFrame) -> DataFrame:
    """A summary text of each file's first chunk: its range, language and the
    first identifier of a line that is no comment, if there is one."""
    first = chunks.where("start_line = 1")
    told = F.filter(F.split("content", "\n", -1), lambda x: ~F.trim(x).rlike("^(//|#)"))
    name = F.get(F.flatten(F.transform(told, identifiers)), 0)
    shown = F.concat(F.lit("chunk lines "), "start_line", F.lit("-"), "end_line", F.lit(": "), "language")
    text = F.concat(shown, F.coalesce(F.concat(F.lit(", first_ident="), name), F.lit("")))
    return first.select("path", "start_line", "end_line", "content_sha", text.alias("derived_text"))


def validate_views(views: DataFrame, files: DataFrame, kinds: list[str], max_level: int = 1, total: Column | None = None) -> DataFrame:
    """``views`` with verdict: valid or the first failing check. A view is stale
    unless a file of its path has its hash, null for null; repeated files count
    once. ``total``: a file's number of lines (null: unknown, ranges have no end);
    by default that of ``T.lines``."""
    total = F.size(T.lines(F.col("content"))) if total is None else total
    now = files.select(F.col("path").alias("_path"), F.col("content_sha").alias("_sha"), total.alias("_n"), F.lit(True).alias("_now")).distinct()
    same = F.col("path").eqNullSafe(F.col("_path")) & F.col("content_sha").eqNullSafe(F.col("_sha"))
    level = F.col("data_level") if "data_level" in views.columns else F.lit(1)
    verdict = (
        F.when(~F.col("kind").isin(*kinds), "kind_not_allowed").when(level > max_level, "data_level_exceeded")
        .when(~T.is_safe_path(F.col("path")), "path_unsafe").when(F.col("_now").isNull(), "stale")
        .when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")) | (F.col("end_line") > F.col("_n")), "range_invalid")
        .otherwise("valid")
    )
    return views.join(now, same, "left").withColumn("verdict", verdict).drop("_path", "_sha", "_n", "_now")


def upsert(store: DataFrame, views: DataFrame, key: str = "view_id") -> tuple[DataFrame, DataFrame]:
    """The store after an upsert, and counts of upserted and replaced rows."""
    counts = views.join(store.select(key, F.lit(1).alias("_old")), key, "left").agg(
        F.count("*").alias("upserted"), F.count("_old").alias("replaced")
    )
    return store.join(views.select(key), key, "left_anti").unionByName(views), counts


# -------------------------------------------------------------- logs and leaks
def audit_tail(log: DataFrame, n: int) -> DataFrame:
    return log.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)


def within_retention(log: DataFrame, days: int, now: Column) -> DataFrame:
    return log.where(F.col("ts") >= now - F.make_interval(days=F.lit(days)))


def traces_by_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("ts", "yyyyMMdd").alias("day"), "event_type").agg(F.count("*").alias("n"))


def leaked_fields(tasks: DataFrame, forbidden: list[str]) -> list[str]:
    """Private label fields among a public table's columns."""
    return [c for c in tasks.columns if c in forbidden]


def passage_leaks(corpus: DataFrame, passages: DataFrame, words: int = 8) -> DataFrame:
    """item_id, path of corpus texts that hold a whole passage.

    A passage's first and last word can be cut inside a word of the text, so the
    words between them are looked up by hash, the first ``words`` of them: runs
    of each length that occurs. Passages without such words are compared with
    every text; they are few words long. Only candidates are compared as texts.
    """
    inner = lambda w: F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    p = passages.select("item_id", F.col("text").alias("passage"), T.words(F.col("text")).alias("w")).where("passage is not null")
    p = p.select("item_id", "passage", F.slice(inner(F.col("w")), 1, words).alias("run"))
    p = p.select("item_id", "passage", F.size("run").alias("n"), F.xxhash64(F.size("run"), F.array_join("run", " ")).alias("key"))
    # At most ``words`` lengths.
    lengths = sorted(r["n"] for r in p.where("n > 0").select("n").distinct().collect())
    w = F.col("w")
    runs = lambda n: F.when(F.size(w) >= n, F.transform(
        F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(F.lit(n), F.array_join(F.slice(w, i + 1, n), " "))
    ))
    short = corpus.select("path", "content").join(bounded(p.where("n = 0")), F.col("content").contains(F.col("passage"))).select("item_id", "path")
    if not lengths:
        return short
    every = F.array_distinct(F.flatten(F.array_compact(F.array(*map(runs, lengths)))))
    c = corpus.select("path", T.words(F.col("content")).alias("w")).select("path", F.explode(every).alias("key"))
    near = c.join(p.where("n > 0").select("key", "item_id"), "key").select("path", "item_id").distinct()
    full = near.join(passages.select("item_id", F.col("text").alias("passage")), "item_id").join(corpus.select("path", "content"), "path")
    return full.where(F.col("content").contains(F.col("passage"))).select("item_id", "path").unionByName(short)


def json_fields(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, depth, field of each object key at any depth of a JSON column; texts
    that are no JSON have none. Each turn opens one more level of all values, as
    a written table, until no object or array is left."""
    spark, depth, found = rows.sparkSession, 1, []
    root = scratch(spark, "jsonlevels")
    level = rows.select(F.col(key).alias("_row"), F.try_parse_json(json).alias("value")).where("value IS NOT NULL")
    kind = level.schema["_row"].dataType.simpleString()
    while True:
        opened = level.withColumnRenamed("value", "_outer").lateralJoin(spark.tvf.variant_explode(F.col("_outer").outer()))
        nested = F.schema_of_variant("value").rlike("^(OBJECT|ARRAY)")
        opened.select("_row", F.col("key").alias("field"), F.when(nested, F.to_json("value")).alias("inner")).write.parquet(f"{root}/{depth}")
        now = spark.read.schema(f"_row {kind}, field string, inner string").parquet(f"{root}/{depth}")
        found.append(now.where("field IS NOT NULL").select(F.col("_row").alias(key), F.lit(depth).alias("depth"), "field"))
        level = now.where("inner IS NOT NULL").select("_row", F.parse_json("inner").alias("value"))
        if not level.limit(1).count():
            return reduce(DataFrame.unionByName, found)
        depth += 1


def private_fields(rows: DataFrame, json: str, fields: list[str]) -> DataFrame:
    """field, n: how often each private field is a key, at any depth, of a JSON
    text column; what looks like a key inside a string is none."""
    got = json_fields(rows.select(F.lit(0).alias("_id"), json), "_id", json)
    return got.where(F.col("field").isin(fields)).groupBy("field").agg(F.count("*").alias("n"))


def canary_hits(artifacts: DataFrame, key: str, text: str, tokens: DataFrame) -> DataFrame:
    """``key``, token: artifacts whose text holds a canary token (token), be it
    inside a longer word."""
    asked = tokens.select("token").distinct().withColumn("id", F.xxhash64("token"))
    held = containing(artifacts.select(F.col(key).alias("key"), F.col(text).alias("text")), asked.select("id", F.col("token").alias("pattern")))
    return held.join(asked, "id").select(F.col("key").alias(key), "token")


def forbidden_predictions(predictions: DataFrame, prefixes: list[str]) -> DataFrame:
    """strategy, n_bad, n_tasks: predictions whose path lies under a forbidden prefix."""
    bad = F.exists(F.array(*map(F.lit, prefixes)), lambda p: F.col("path").startswith(p))
    return predictions.where(bad).groupBy("strategy").agg(F.count("*").alias("n_bad"), F.countDistinct("task_id").alias("n_tasks"))
