"""Registration of queries with their SQL oracles, and shared SQL parts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.corpus import files_of_documents, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if it has one."""
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return add


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_of_documents(table(spark, sf_dir, "documents"))


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, query: each benchmark item as it is."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def words_sql(column: str) -> str:
    return f"list_filter(string_split_regex(lower({column}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def lines_sql(column: str) -> str:
    return (
        f"CASE WHEN coalesce({column}, '') = '' THEN []::VARCHAR[] ELSE list_transform(string_split("
        f"regexp_replace({column}, '\\n\\z', ''), chr(10)), lambda x: regexp_replace(x, '\\r\\z', '')) END"
    )


FILES = "files AS (SELECT 'doc/' || doc_id AS path, source AS repo_id, lang AS language, sha256(text) AS content_sha, strlen(text) AS size, text AS content FROM documents)"
LINES = f"lists AS (SELECT path, language, content_sha, {lines_sql('content')} AS ls FROM files), lines AS (SELECT path, language, content_sha, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM lists)"
CHUNKS = (
    "spread AS (SELECT *, unnest(range(0, (len(ls) + 29) // 30)) AS i FROM lists), "
    "chunks AS (SELECT path, language, content_sha, i * 30 + 1 AS start_line, least(len(ls), (i + 1) * 30) AS end_line, len(ls) AS total_lines, "
    "array_to_string(ls[i * 30 + 1 : least(len(ls), (i + 1) * 30)], chr(10)) AS content FROM spread)"
)
TOPICS = "topics AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
BM25 = (
    f"terms AS (SELECT query_id, term, count(*) AS weight FROM (SELECT query_id, unnest({words_sql('query')}) AS term FROM topics) GROUP BY ALL), "
    f"toks AS (SELECT path, start_line, end_line, content_sha, {words_sql('content')} AS w FROM chunks), "
    "stats AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM toks), "
    "tf AS (SELECT path, start_line, end_line, content_sha, greatest(len(w), 1) AS dl, term, count(*) AS tf FROM (SELECT *, unnest(w) AS term FROM toks) "
    "WHERE term IN (SELECT term FROM terms) GROUP BY ALL), "
    "df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), "
    "scored AS (SELECT query_id, path, start_line, end_line, content_sha, round(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / "
    "(tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_len))), 6) AS score FROM tf JOIN df USING (term) JOIN terms USING (term) CROSS JOIN stats GROUP BY ALL), "
    "bm25 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, path, start_line) AS rank FROM scored) WHERE rank <= 20)"
)
