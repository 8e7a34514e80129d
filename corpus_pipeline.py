"""A corpus cleaning pipeline of five operator stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns of their input, whatever their names; texts aren't shuffled
as long as the keys of the rows that change are few enough for a broadcast.

Defined results, beside those of each operator's module
* null or empty text: goes in the first stage, as its language can't be told;
  a stage on its own treats null as the empty text and returns it as null.
* very long texts: whole in every stage.
* repeated rows, ties: near_dedup leaves one of them, the row with the smallest
  hash of its columns; the other stages treat each row alike.
* several texts of one doc_id: each is judged by itself.
* empty table: empty results all along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spanloom.llm import decontam, langid, pieces, secrets, simhash
from spanloom.llm.common import scratch_made, ship, sweep, table, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go; the rest stays unchanged."""
    ship(spark)
    return langid.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    ship(spark)
    return simhash.keep_one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are masked."""
    return secrets.masked_documents(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids, with the check that they decode to its text."""
    ship(spark)
    return pieces.encoding_report(docs, with_ids=True)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("piece_encoding", piece_encoding),
]

#: Learnt models and connected components are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before = scratch_made(spark)
        docs = written(stage(spark, docs, sf_dir), name)
        # What the stage wrote on its way is done with; its result stays.
        sweep(spark, {p for p in scratch_made(spark) - before if f"/spanloom-{name}-" not in p})
    return docs
