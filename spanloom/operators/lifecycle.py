"""The index's life: manifest, dirty diff, status, update, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.storage import remove
from ..sources.corpus import line_chunks

SCHEMA_VERSION = "spanloom-chunks-1"


def manifest_of(files: DataFrame, *more: Column) -> DataFrame:
    """path, content_sha, size, language, status, skipped_reason, and ``more``."""
    reason = F.when(~T.is_safe_path(F.col("path")), "path_unsafe").when(F.col("content").isNull(), "read_error").when(
        F.col("size") == 0, "empty_file"
    )
    return files.select(
        "path", "content_sha", "size", "language",
        F.when(reason.isNull(), "indexed").otherwise("skipped").alias("status"), reason.alias("skipped_reason"), *more,
    )


def dirty_diff(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, state (added, modified, deleted or clean), old_sha, new_sha."""
    old = manifest.select("path", F.col("content_sha").alias("old_sha"), F.lit(True).alias("_old"))
    new = files.select("path", F.col("content_sha").alias("new_sha"), F.lit(True).alias("_new"))
    state = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "deleted").when(
        ~F.col("old_sha").eqNullSafe(F.col("new_sha")), "modified"
    ).otherwise("clean")
    return old.join(new, "path", "full_outer").select("path", state.alias("state"), "old_sha", "new_sha")


def status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """One row: counts by state, and whether the index has to be updated."""
    diff = dirty_diff(manifest, files)
    count = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    return diff.agg(*[count(s) for s in ("added", "modified", "deleted", "clean")]).withColumn(
        "is_dirty", F.col("n_added") + F.col("n_modified") + F.col("n_deleted") > 0
    )


def update_chunks(chunks: DataFrame, diff: DataFrame, files: DataFrame) -> DataFrame:
    """The chunk table after an update: chunks of changed paths go, and only new
    and modified files are cut again."""
    changed = diff.where("state <> 'clean'").select("path")
    fresh = files.join(diff.where("state in ('added', 'modified')").select("path"), "path", "left_semi")
    return chunks.join(changed, "path", "left_anti").unionByName(line_chunks(fresh))


def validate(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem for every entry that is not valid any more."""
    unsafe = manifest.where(~T.is_safe_path(F.col("path"))).select("path", F.lit("path_unsafe").alias("problem"))
    problem = F.when(F.col("state") == "deleted", "deleted").otherwise("stale")
    late = dirty_diff(manifest, files).where("state in ('deleted', 'modified')").select("path", problem.alias("problem"))
    return late.unionByName(unsafe)


def write_index(files: DataFrame, root: str, buckets: int = 16) -> None:
    """Writes chunks and manifest below ``root``. Chunks are partitioned by a
    hash bucket of the path, so an update rewrites only buckets that changed."""
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    line_chunks(files).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/chunks")
    manifest_of(files).withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(f"{root}/manifest")


def open_index(spark, root: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, manifest); refuses another schema version."""
    manifest = spark.read.parquet(f"{root}/manifest")
    if manifest.where(F.col("schema_version") != SCHEMA_VERSION).limit(1).count():
        raise ValueError("the index has another schema version; build it again")
    schema = line_chunks(manifest.select("path", "language", "content_sha", F.lit("").alias("content"))).schema
    return spark.read.schema(schema.add("bucket", "integer")).parquet(f"{root}/chunks").drop("bucket"), manifest.drop("schema_version")


def update_index(spark, root: str, files: DataFrame, buckets: int = 16) -> DataFrame:
    """Updates an index in place and returns the diff that was applied. Only
    buckets with a changed path are written; a second run changes nothing, and a
    run that broke off is made good by the next one, as the manifest comes last.

    The diff is a written table, read again until the next update: neither its
    rows nor the changed paths pass through the driver, only bucket numbers."""
    chunks, manifest = open_index(spark, root)
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    found = dirty_diff(manifest, files).where("state <> 'clean'")
    found.write.mode("overwrite").parquet(f"{root}/_diff")
    diff = spark.read.schema(found.schema).parquet(f"{root}/_diff")
    touched = {r[0] for r in diff.select(bucket).distinct().collect()}
    if touched:
        kept = chunks.where(bucket.isin(sorted(touched)))
        new = update_chunks(kept, diff, files).withColumn("bucket", bucket)
        staged = f"{root}/_staged"
        new.write.mode("overwrite").partitionBy("bucket").parquet(staged)
        manifest_of(files).withColumn("schema_version", F.lit(SCHEMA_VERSION)).write.mode("overwrite").parquet(f"{root}/_manifest")
        ready = spark.read.schema(new.schema).parquet(staged)
        full = {r[0] for r in ready.select("bucket").distinct().collect()}
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/chunks")
        # A bucket that lost its last chunk has no rows to overwrite it with.
        for b in touched - full:
            remove(spark, f"{root}/chunks/bucket={b}")
        spark.read.parquet(f"{root}/_manifest").write.mode("overwrite").parquet(f"{root}/manifest")
    return diff
