"""Exact top-k search by inner product over whole-number vectors.

Queries are packed into tiles and written as a table. Each task cuts its part
of the vectors (a shard) into tiles, multiplies them with every query tile it
reads from that table, selects a part of each tile's scores, and gives one top
list a query of its shard. The lists of a query tile are merged in a tree of
FAN lists a node, each node a task of bounded size.

A worker holds one shard piece of SHARD vectors, one query tile, and its lists.
A scan of the vectors serves some QUERIES queries; with more there is a scan for
each so many, so that no task grows with the number of queries. Shards are not
shuffled; what is shuffled are the lists, which are written first.

A product is taken in single precision while no partial sum can pass 2^24, in
double precision up to 2^53, and else with Python's whole numbers: it is always
exact. Scores past 64 bits are put at the ends of their range before they are
ordered.

Defined results
* null vectors, and those that hold null, NaN or infinite components (scaled),
  take no part, nor do empty ones and rows with a null id.
* vectors of different lengths have no product and are no candidates of each
  other.
* ties: the smaller vec_id first.
* repeated ids: rows of a query's own id are never its candidates; of several
  vectors of one query id the first in array order asks, once; each row of a
  candidate counts, so its id may stand several times in a list.
* fewer candidates than k: all of them. Empty table: an empty result.
* further columns are ignored.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written

#: Queries of a tile, vectors of a tile, vectors of a shard piece, queries of a scan, lists of a merge.
TILE, CHUNK, SHARD, QUERIES, FAN = 1024, 4096, 1 << 19, 1 << 18, 8
#: Survivors a row of a tile from which the row's best are picked first.
DENSE = 64
LOW, HIGH = -(1 << 63), (1 << 63) - 1
PACKED = "dim int, ids binary, parts binary"
LISTS = "tile long, node int, query binary, vec binary, score binary"


def scaled(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: float = 64.0) -> DataFrame:
    """vec_id, v: the vectors that take part, as whole numbers in doubles."""
    v = F.col(embedding).cast("array<double>")
    usable = F.coalesce(F.size(v) > 0, F.lit(False)) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & usable)
    # Spark's floor gives whole numbers of 64 bits; the workers' floor has no such end.
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(v, lambda x: x * F.lit(scale)).alias("v"))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, ids and whole-number rows of a batch for each length of vectors."""
    ids, lists = batch.column("vec_id").to_numpy(zero_copy_only=False), batch.column("v")
    values, starts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    lengths = np.diff(starts)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), ids[at], np.floor(values[starts[at][:, None] + np.arange(dim)])


class Pieces:
    """Collects rows by length and gives them back in pieces of ``size``."""

    def __init__(self, size: int):
        self.size, self.held = size, {}

    def add(self, dim: int, ids: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        kept = self.held.setdefault(dim, [[], [], 0])
        while kept[2] + len(ids) >= self.size:
            n = self.size - kept[2]
            kept[0].append(ids[:n])
            kept[1].append(rows[:n])
            yield dim, np.concatenate(kept[0]), np.concatenate(kept[1])
            ids, rows = ids[n:], rows[n:]
            kept = self.held[dim] = [[], [], 0]
        if len(ids):
            kept[0].append(ids)
            kept[1].append(rows)
            kept[2] += len(ids)

    def rest(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for dim, (ids, rows, n) in self.held.items():
            if n:
                yield dim, np.concatenate(ids), np.concatenate(rows)


def _small(rows: np.ndarray) -> np.ndarray:
    """Rows of whole numbers in the narrowest type that holds them."""
    top = np.abs(rows).max(initial=0)
    return rows.astype(np.int8 if top < 128 else np.int16 if top < 1 << 15 else np.float32 if top < 1 << 24 else np.float64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pieces = Pieces(TILE)

    def row(dim: int, ids: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"dim": pa.array([dim], pa.int32()), "ids": [ids.astype("<i8").tobytes()], "parts": [rows.astype("<f8").tobytes()]}
        )

    for batch in batches:
        for group in _groups(batch):
            for piece in pieces.add(*group):
                yield row(*piece)
    for piece in pieces.rest():
        yield row(*piece)


def query_tiles(queries: DataFrame) -> DataFrame:
    """The queries (vec_id, v) as a written table of packed tiles."""
    one = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    return written(one.mapInArrow(_pack, PACKED), "querytiles")


# --------------------------------------------------------------------- product
def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The exact whole-number products of all rows of ``a`` with those of ``b``,
    as floats if they fit and else as 64-bit numbers."""
    norm = lambda m: float(np.sqrt(np.square(m.astype(np.float64)).sum(1).max(initial=0)))
    bound = norm(a) * norm(b)
    for kind, most in ((np.float32, 1 << 24), (np.float64, 1 << 53)):
        if bound * 1.001 + 1 < most:
            return a.astype(kind) @ b.astype(kind).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object)
    return np.clip(whole(a) @ whole(b).T, LOW, HIGH).astype(np.int64)


class TopLists:
    """The k best of each of n queries: row, score and place in ascending order
    of row, then descending score, then ascending id."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.row, self.score, self.vec = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        #: A score must pass its row's bound to enter; ids come in ascending order, so ties never do.
        self.bound = np.full(n, -np.inf)
        self.full = np.zeros(n, bool)

    def add(self, row: np.ndarray, score: np.ndarray, vec: np.ndarray) -> None:
        row, score, vec = (np.concatenate(p) for p in ((self.row, row), (self.score, score.astype(np.int64)), (self.vec, vec)))
        # The complement turns the order of whole numbers round without passing their range.
        order = np.lexsort((vec, ~score, row))
        row, score, vec = row[order], score[order], vec[order]
        first = np.searchsorted(row, np.arange(self.n))
        keep = np.arange(len(row)) - first[row] < self.k
        self.row, self.score, self.vec = row[keep], score[keep], vec[keep]
        ends = np.cumsum(np.bincount(self.row, minlength=self.n))
        self.full = np.diff(np.concatenate(([0], ends))) == self.k
        self.bound = np.where(self.full, self.score[np.maximum(ends, 1) - 1].astype(np.float64) if len(self.score) else -np.inf, -np.inf)


def search_shard(asked: np.ndarray, parts: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> TopLists:
    """The k best of a shard piece, whose ids ascend, for a query tile."""
    top = TopLists(len(asked), k)
    for at in range(0, len(ids), CHUNK):
        own, block = ids[at : at + CHUNK], rows[at : at + CHUNK]
        scores = products(parts, block)
        exact = scores.dtype == np.int64
        # 64-bit scores are compared with a bound just below theirs, since it is a rounded double.
        enter = ~top.full[:, None] | (scores >= np.nextafter(top.bound, -np.inf)[:, None]) if exact else scores > top.bound[:, None].astype(scores.dtype)
        low, high = np.searchsorted(own, asked, "left"), np.searchsorted(own, asked, "right")
        mine = np.flatnonzero(high > low)
        for q in mine:
            enter[q, low[q] : high[q]] = False
        count = np.count_nonzero(enter)
        if not count:
            continue
        if count > DENSE * len(asked) and not exact and len(own) > k:
            # Whole scores and places in one double each: all differ, so the k best are exact.
            keys = scores.astype(np.float64) * CHUNK - np.arange(len(own))
            if np.abs(scores).max(initial=0) < (1 << 52) // CHUNK:
                keys[~enter] = -np.inf
                best = np.argpartition(keys, len(own) - k, axis=1)[:, len(own) - k :]
                chosen = np.zeros_like(enter)
                np.put_along_axis(chosen, best, True, 1)
                enter &= chosen
        q, c = np.nonzero(enter)
        top.add(q, scores[q, c], own[c])
    return top


def _read_tiles(uri: str, names: list[tuple[int, str]]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """tile, dim, ids and rows of the packed tiles of files."""
    fs, base = pafs.FileSystem.from_uri(uri)
    for number, name in names:
        with fs.open_input_file(f"{base}/{name}") as source:
            at = 0
            for batch in pq.ParquetFile(source).iter_batches(batch_size=4):
                for row in batch.to_pylist():
                    ids = np.frombuffer(row["ids"], "<i8")
                    yield (number << 32) + at, row["dim"], ids, np.frombuffer(row["parts"], "<f8").reshape(len(ids), row["dim"])
                    at += 1


def _lists(tile: int, node: int, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> dict:
    return {
        "tile": pa.array([tile], pa.int64()), "node": pa.array([node], pa.int32()), "query": [query.astype("<i8").tobytes()],
        "vec": [vec.astype("<i8").tobytes()], "score": [score.astype("<i8").tobytes()],
    }


def _search(uri: str, names: list[tuple[int, str]], k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()

        def against(dim: int, ids: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], rows[order]
            for tile, of, asked, parts in _read_tiles(uri, names):
                if of == dim:
                    top = search_shard(asked, parts, ids, rows, k)
                    if len(top.row):
                        yield pa.RecordBatch.from_pydict(_lists(tile, node, asked[top.row], top.vec, top.score))

        pieces = Pieces(SHARD)
        for batch in batches:
            for dim, ids, rows in _groups(batch):
                for piece in pieces.add(dim, ids, _small(rows)):
                    yield from against(*piece)
        for piece in pieces.rest():
            yield from against(*piece)

    return task


# --------------------------------------------------------------------- merging
def _merged(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rank (from 0), query, vec and score of the k best of some lists."""
    query, vec, score = (np.frombuffer(b"".join(table.column(c).to_pylist()), "<i8") for c in ("query", "vec", "score"))
    order = np.lexsort((vec, ~score, query))
    query, vec, score = query[order], vec[order], score[order]
    starts = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1])))
    rank = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    keep = rank < k
    return rank[keep], query[keep], vec[keep], score[keep]


def merge_tree(lists: DataFrame, k: int, nodes: int) -> DataFrame:
    """query_id, rank, vec_id, score from the lists of ``nodes`` leaves."""
    def inner(table: pa.Table) -> pa.Table:
        _, query, vec, score = _merged(table, k)
        return pa.Table.from_pydict(_lists(table.column("tile")[0].as_py(), table.column("node")[0].as_py(), query, vec, score))

    def root(table: pa.Table) -> pa.Table:
        rank, query, vec, score = _merged(table, k)
        return pa.Table.from_pydict({"query_id": query, "rank": pa.array(rank + 1, pa.int32()), "vec_id": vec, "score": score})

    while nodes > FAN:
        lists = lists.withColumn("node", F.expr(f"node div {FAN}").cast("int")).groupBy("tile", "node").applyInArrow(inner, LISTS)
        nodes = -(-nodes // FAN)
    return lists.groupBy("tile").applyInArrow(root, "query_id long, rank int, vec_id long, score long")


def exact_topk(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows with the largest inner product
    for each row of (vec_id, embedding) for which ``is_query`` (over vec_id) holds."""
    rows = scaled(vectors, scale=scale)
    tiles = query_tiles(rows.where(is_query))
    uri = posixpath.dirname(tiles.inputFiles()[0]) if tiles.inputFiles() else ""
    names = list(enumerate(sorted(posixpath.basename(f) for f in tiles.inputFiles())))
    count = tiles.agg(F.coalesce(F.sum(F.octet_length("ids") / 8), F.lit(0))).first()[0]
    scans = max(1, min(len(names), -(-int(count) // QUERIES)))
    path = scratch_path(vectors.sparkSession, "toplists")
    for i in range(scans):
        some = names[i * len(names) // scans : (i + 1) * len(names) // scans]
        rows.mapInArrow(_search(uri, some, k), LISTS).write.mode("append").parquet(path)
    lists = vectors.sparkSession.read.schema(LISTS).parquet(path)
    last = lists.agg(F.max("node")).first()[0]
    return merge_tree(lists, k, (last or 0) + 1)


def search_report(vectors: DataFrame) -> DataFrame:
    return exact_topk(vectors, F.col("vec_id") % 20 == 0)


ORACLE = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20"""
