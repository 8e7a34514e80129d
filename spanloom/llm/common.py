"""Helpers that the corpus operators share: table loading, scratch tables in
the shared checkpoint folder, and null-safe row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only where that is unset and all
    tasks run in this process (tests, a notebook) a folder of this machine is
    made and set for the session. A cluster without the setting is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{scratch_root(spark)}/spanloom-{name}-{uuid.uuid4().hex}"
    spark.sparkContext.__dict__.setdefault("_spanloom_scratch", set()).add(path)
    return path


def scratch_made(spark: SparkSession) -> set[str]:
    """The scratch folders that this session has made and not swept."""
    return set(spark.sparkContext.__dict__.get("_spanloom_scratch", ()))


def sweep(spark: SparkSession, paths: set[str]) -> None:
    """Deletes scratch folders; only for callers that know that no plan that is
    still to run reads them."""
    for path in paths:
        remove_scratch(spark, path)
    spark.sparkContext.__dict__.setdefault("_spanloom_scratch", set()).difference_update(paths)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared scratch folder. It cuts the
    lineage, survives lost executors, and lets several consumers prune columns
    of one computed result instead of computing it again."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession, path: str) -> None:
    """Deletes a scratch table that no later plan reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """``wanted``, each with underscores until no column of ``df`` has the name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: Rows of two longs up to which a set of keys is broadcast (some 64 MB).
BROADCAST_KEYS = 1_000_000


def few(df: DataFrame, rows: int = BROADCAST_KEYS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counting
    stops there); otherwise as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def doc_crc(doc_id: Column) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary"))


def text_hash(text: Column) -> Column:
    """A 64-bit key of a text that tells null from the empty string."""
    return F.xxhash64(text.isNull(), text)


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once a session, so that workers can
    import it wherever only the driver's path has it."""
    # A batch of texts is held several times over; long ones need small batches.
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    context = spark.sparkContext
    if getattr(context, "_spanloom_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="spanloom-")) / "spanloom_package.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._spanloom_shipped = True
