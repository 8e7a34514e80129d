"""Search for many strings in texts at once.

The strings are written in pieces of bounded size. Each piece becomes an
Aho-Corasick automaton that a task builds once and runs over its texts, so a
text is read once a piece however many strings there are, and no pair of text and
string is made that does not match. Nothing of the strings but the pieces'
names passes the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import scratch

#: Bytes of patterns in a piece.
PIECE_BYTES = 16 << 20


def pieces_of(patterns: DataFrame) -> list[str]:
    """Files of ``patterns`` (columns id, pattern), each of a bounded size."""
    spark = patterns.sparkSession
    path, size = scratch(spark, "patterns"), F.sum(F.octet_length("pattern") + 16)
    pieces = 1 + int(patterns.agg(size).first()[0] or 0) // PIECE_BYTES
    patterns.select("id", "pattern").repartition(pieces).write.parquet(path)
    return sorted(spark.read.schema("id long, pattern string").parquet(path).inputFiles())


def read_piece(uri: str) -> tuple[list, list]:
    fs, path = pafs.FileSystem.from_uri(uri)
    with fs.open_input_file(path) as source:
        rows = pq.read_table(source)
    return rows.column("id").to_pylist(), rows.column("pattern").to_pylist()


def automaton_of(strings: list[str]) -> ahocorasick.Automaton | None:
    """An automaton whose values are the positions of equal strings in the list."""
    places: dict[str, list[int]] = {}
    for i, s in enumerate(strings):
        if s:
            places.setdefault(s, []).append(i)
    if not places:
        return None
    out = ahocorasick.Automaton()
    for s, at in places.items():
        out.add_word(s, at)
    out.make_automaton()
    return out


def each_piece(texts: DataFrame, pieces: list[str], task_of, schema: str) -> DataFrame:
    out = None
    for uri in pieces:
        one = texts.mapInArrow(task_of(uri), schema)
        out = one if out is None else out.unionByName(one)
    return texts.sparkSession.createDataFrame([], schema) if out is None else out


def containing(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """key, id: which texts (key, text) hold which strings (id, pattern), as they
    are. The empty string is in every text; nulls are in none and hold none."""
    kind = texts.schema["key"].dataType.simpleString()

    def task_of(uri: str):
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, strings = read_piece(uri)
            automaton, always = automaton_of(strings), {i for i, s in enumerate(strings) if not s}
            for batch in batches:
                rows, found = [], []
                for row, text in enumerate(batch.column("text").to_pylist()):
                    held = set(always)
                    if automaton is not None:
                        for _, at in automaton.iter(text):
                            held.update(at)
                    rows += [row] * len(held)
                    found += [ids[i] for i in held]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows, pa.int64())), pa.array(found, pa.int64())], names=["key", "id"])
        return task

    usable = patterns.where("pattern is not null")
    return each_piece(texts.select("key", "text").where("text is not null"), pieces_of(usable), task_of, f"key {kind}, id long")


def stem_tests(files: DataFrame, is_test: str = "contains(lower(path), 'test') OR contains(content, 'assert')", is_target: str = "true") -> DataFrame:
    """source_path, target_path, kind: test files and the other files of their
    repository (those of ``is_target``) whose stem, the name up to its last dot,
    their text holds. Names may hold line feeds."""
    name = F.element_at(F.split("path", "/"), -1)
    stem = F.when(name.rlike(r"(?s)^.+\.[^.]*\z"), F.regexp_extract(name, r"(?s)^(.+)\.[^.]*\z", 1)).otherwise(name)
    targets = files.where(~F.contains(F.lower("path"), F.lit("test"))).where(is_target).select("repo_id", F.col("path").alias("target_path"), stem.alias("stem"))
    stems = targets.select("stem").distinct().select(F.xxhash64("stem").alias("id"), F.col("stem").alias("pattern"))
    tests = files.where(is_test).select("repo_id", F.col("path").alias("source_path"), "content")
    held = containing(tests.select(F.struct("repo_id", "source_path").alias("key"), F.col("content").alias("text")), stems)
    # Stems are few a repository; pairs of a test and a stem meet the files of that stem there.
    named = held.select("key.repo_id", "key.source_path", F.col("id"))
    return named.join(targets.withColumn("id", F.xxhash64("stem")), ["repo_id", "id"]).select("source_path", "target_path", F.lit("tests").alias("kind")).distinct()
