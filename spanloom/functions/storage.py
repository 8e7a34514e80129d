"""Folders of tables on any file system that the cluster can open."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _opened(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def qualified(spark: SparkSession, path: str) -> str:
    """A path with its scheme, as Spark's readers name it."""
    target, system = _opened(spark, path)
    return system.makeQualified(target).toString()


def exists(spark: SparkSession, path: str) -> bool:
    target, system = _opened(spark, path)
    return system.exists(target)


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder; whether there was one."""
    target, system = _opened(spark, path)
    return system.exists(target) and system.delete(target, True)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none without the folder."""
    target, system = _opened(spark, path)
    return [s.getPath().getName() for s in system.listStatus(target)] if system.exists(target) else []


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that appears whole under its name, or not at all;
    an error if there is one already."""
    target, system = _opened(spark, path)
    part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    stream = system.create(part, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if system.exists(target) or not system.rename(part, target):
        system.delete(part, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text, or None without one."""
    target, system = _opened(spark, path)
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table of a running job below ``spark.checkpoint.dir``.
    Only where that is unset and all tasks run in this process a folder of this
    machine is made and set for the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/spanloom-{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to a scratch folder, for results that are small and
    read more than once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
