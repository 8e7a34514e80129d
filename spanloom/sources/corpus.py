"""Sources: the corpus as files, lines and chunks, and tolerant readers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ship import ship
from ..functions.storage import qualified
from .ignore import not_ignored, rules_of

CHUNK_LINES = 30


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files_of_documents(documents: DataFrame) -> DataFrame:
    """files(path, repo_id, language, content_sha, size, content)."""
    return documents.select(
        F.concat(F.lit("doc/"), F.col("doc_id")).alias("path"), F.col("source").alias("repo_id"),
        F.col("lang").alias("language"), F.sha2(F.col("text").cast("binary"), 256).alias("content_sha"),
        F.octet_length("text").cast("long").alias("size"), F.col("text").alias("content"),
    )


IGNORE_FILE = re.compile(r"(^|/)\.(git)?ignore$|^\.git/info/exclude$")


def hidden_names(spark: SparkSession, root: str) -> list[str]:
    """Paths below ``root`` of the files that Spark's own listing leaves out:
    those with a name, or in a folder, that starts with a dot or an underscore.
    git's store is left out but for its ignore file."""
    fs, base = pafs.FileSystem.from_uri(qualified(spark, root))
    base = base.rstrip("/")
    names = [i.path[len(base) + 1:] for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.type == pafs.FileType.File]
    return [n for n in names if re.search(r"(^|/)[._]", n) and (not re.search(r"(^|/)\.git/", n) or n == ".git/info/exclude")]


def read_files(spark: SparkSession, root: str, names: list[str]) -> DataFrame:
    """path (below ``root``), length, content of named files."""
    uri = qualified(spark, root).rstrip("/")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(uri)
        for batch in batches:
            for name in batch.column("path").to_pylist():
                with fs.open_input_stream(f"{base}/{name}") as source:
                    content = source.read()
                yield pa.RecordBatch.from_pydict({"path": [name], "length": pa.array([len(content)], pa.int64()), "content": pa.array([content], pa.binary())})

    listed = spark.createDataFrame([(n,) for n in names], "path string")
    return listed.repartition(1 + len(names) // 1000).mapInArrow(task, "path string, length long, content binary")


def scan_folder(spark: SparkSession, root: str, include: list[str], exclude: list[str], gitignored: bool = False) -> DataFrame:
    """Admitted text files below ``root`` with content hash and language; files
    that git's ignore files leave out only if ``gitignored``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.substring(F.col("path"), F.lit(len(qualified(spark, root).rstrip("/")) + 2), F.length("path"))
    named, hidden = raw.select(relative.alias("path"), "length", "content"), hidden_names(spark, root)
    if hidden:
        named = named.unionByName(read_files(spark, root, hidden))
    asked = [n for n in hidden if IGNORE_FILE.search(n)]
    if asked:
        texts = read_files(spark, root, asked).select("path", F.col("content").cast("string").alias("content"))
        named = not_ignored(named, rules_of(texts, git=not gitignored))
    kept = named.where(T.admitted(F.col("path"), include, exclude)).where(~T.looks_binary(F.col("content")))
    return kept.select(
        "path", F.lit("").alias("repo_id"), T.language_of(F.col("path")).alias("language"),
        F.sha2("content", 256).alias("content_sha"), F.col("length").alias("size"),
        F.col("content").cast("string").alias("content"),
    )


def lines_of(files: DataFrame) -> DataFrame:
    """path, language, content_sha, line_no (1-based), line."""
    return files.select(
        "path", "language", "content_sha", F.posexplode(T.lines(F.col("content"))).alias("line_no", "line")
    ).withColumn("line_no", F.col("line_no") + 1)


def windows(size: int = CHUNK_LINES) -> Column:
    """Windows of ``size`` lines of the array ``ls``, which is not empty:
    start_line, end_line, content."""
    return F.transform(
        F.sequence(F.lit(0), F.expr(f"cast((size(ls) - 1) div {size} as int)")),
        lambda i: F.struct(
            (i * size + 1).alias("start_line"), F.least((i + 1) * size, F.size("ls")).alias("end_line"),
            F.array_join(F.slice("ls", i * size + 1, size), "\n").alias("content"),
        ),
    )


def line_chunks(files: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """Windows of ``size`` lines without overlap: path, language, content_sha,
    start_line, end_line, total_lines (of the file), content. Cut inside the
    row, without a shuffle."""
    split = files.select("path", "language", "content_sha", T.lines(F.col("content")).alias("ls"))
    each = F.explode(F.when(F.size("ls") > 0, windows(size))).alias("w")
    spread = split.select("path", "language", "content_sha", F.size("ls").alias("total_lines"), each)
    return spread.select("path", "language", "content_sha", "w.start_line", "w.end_line", "total_lines", "w.content")


def read_span(files: DataFrame, spec: str) -> DataFrame:
    """The lines that a path spec names; the end is cut at the last line, a
    start behind it gives no row."""
    path, start, end = T.parse_path_spec(spec)
    split = files.where(F.col("path") == path).withColumn("ls", T.lines(F.col("content")))
    first = F.lit(start or 1)
    last = F.least(F.lit(end), F.size("ls")) if end else F.size("ls")
    return split.where(first <= F.size("ls")).select(
        "path", first.alias("start_line"), last.alias("end_line"), "content_sha", F.lit(1.0).alias("score"),
        F.array_join(F.slice("ls", first, last - first + 1), "\n").alias("excerpt"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Well-formed rows, and the number of rows that could not be parsed."""
    raw = spark.read.schema(f"{schema}, _bad STRING").option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_bad"
    ).json(path).cache()
    return raw.where("_bad is null").drop("_bad"), raw.agg(F.count("_bad").alias("parse_errors"))


CITATION = "path STRING, start_line BIGINT, end_line BIGINT, content_sha STRING, excerpt STRING"


def citations(raw: DataFrame, column: str) -> DataFrame:
    """Citations given as one object, an array, or an object with evidence."""
    one, many, wrapped = (
        F.from_json(column, f"STRUCT<{CITATION}>"), F.from_json(column, f"ARRAY<STRUCT<{CITATION}>>"),
        F.from_json(column, f"STRUCT<evidence: ARRAY<STRUCT<{CITATION}>>>").getField("evidence"),
    )
    is_array = F.ltrim(F.col(column)).startswith("[")
    each = F.when(is_array, many).when(wrapped.isNotNull(), wrapped).otherwise(F.array(one))
    return raw.select(F.explode(each).alias("c")).select("c.*")


def line_range(value: Column) -> Column:
    """A line range given as a number, ``a-b`` or a JSON pair, as a struct."""
    number = value.try_cast("bigint")
    pair = F.from_json(value, "array<bigint>")
    start = F.coalesce(number, F.regexp_extract(value, r"^\s*[Ll]?(\d+)\s*[-:]", 1).try_cast("bigint"), F.get(pair, 0))
    end = F.coalesce(number, F.regexp_extract(value, r"[-:]\s*[Ll]?(\d+)\s*$", 1).try_cast("bigint"), F.get(pair, 1), F.get(pair, 0))
    good = start.isNotNull() & (start >= 1) & (end >= start)
    return F.when(good, F.struct(start.alias("start_line"), end.alias("end_line")))


def manifest_sha(files: DataFrame) -> DataFrame:
    """One hash over all (path, content hash) pairs in path order. Files are
    hashed in groups first, so no row holds the whole list of a large corpus."""
    groups = files.groupBy(F.left(F.sha2(F.col("path").cast("binary"), 256), F.lit(3)).alias("g")).agg(
        F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "path", "content_sha"))), "\n").cast("binary"), 256).alias("h")
    )
    whole = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "g", "h"))), "\n")
    return groups.agg(F.sha2(whole.cast("binary"), 256).alias("manifest_sha"))
