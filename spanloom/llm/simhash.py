"""SimHash near-duplicate classes with bit-sliced distance search.

Fingerprints are made in one map pass. Distinct fingerprints meet in ten
tables: with 64 bits cut into five blocks, two fingerprints at three or fewer
differing bits agree on at least two whole blocks, so each pair of blocks keys
one table and no link is lost. Inside a bucket the fingerprints are stored as
64 vertical bit planes; carry-save bitwise counters update the distances of 64
pairs per machine word, and a block of lanes is abandoned once all of its
lanes exceed the radius. A bucket emits a spanning forest of its links, never
all pairs. Components are found with alternating large-star and small-star
rounds on DataFrames; every round is a written table.

Defined results
* null or empty text, or one without a word: fingerprint zero, linked like any
  other fingerprint.
* null doc_id: the row is kept; its component is the smallest non-null doc_id
  that it reaches, or null when there is none.
* repeated rows and ids: one output row for each input row.
* very long texts: hashed whole, shingle by shingle.
* ties: none; a component is named by its smallest id, a leader is the smallest
  of (id, text hash), and of rows that repeat a leader the smallest row hash.
* empty table: an empty result. Further columns of the input are ignored.

The radius is fixed at RADIUS = 3 by the two counters of ``near_lanes``. Copies
that were edited more than that leaves room for are no links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import few, free_names, remove_scratch, scratch_path, text_hash, written

RADIUS = 3
#: Bit ranges (low, width) of the five blocks.
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Fingerprints of one bucket chunk; a larger bucket is compared chunk by chunk.
CHUNK = 2048
_POPCOUNT_ROWS = 1 << 15


# ---------------------------------------------------------------- fingerprints
def shingle_hashes(text: str | None, width: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each word shingle, as unsigned 64-bit integers."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: -width + 1].tolist(), ends[width - 1 :].tolist())
    return np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit b is one if more than half of the hashes have it."""
    n = len(hashes)
    if not n:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, n, _POPCOUNT_ROWS):
        part = hashes[at : at + _POPCOUNT_ROWS].astype("<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = (counts * 2 > n).astype(np.uint8)
    return int(np.packbits(ones, bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        prints = np.array([fingerprint(shingle_hashes(t.as_py())) for t in texts], np.uint64)
        kept = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        names = [name for name in batch.schema.names if name != "text"]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(prints.view(np.int64))], [*names, "fp"])


def fingerprints(docs: DataFrame, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_columns`` and ``fp`` (the fingerprint as a signed bigint)."""
    taken = docs.select(*id_columns, F.col("text").cast("string").alias("text"))
    schema = taken.drop("text").schema.add("fp", "long")
    return taken.mapInArrow(_fingerprint_batches, schema)


# ------------------------------------------------------- bit-sliced comparison
def bit_planes(values: np.ndarray) -> np.ndarray:
    """64 vertical planes: bit i of plane b is bit b of ``values[i]``."""
    words = -(-len(values) // 64)
    bits = np.zeros((words * 64, 64), np.uint8)
    bits[: len(values)] = np.unpackbits(
        values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"
    )
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_lanes(planes_a: np.ndarray, planes_b: np.ndarray, over: np.ndarray) -> np.ndarray:
    """A word array whose set bits are the lanes at RADIUS or fewer differing bits.
    ``over`` comes with the bits of the lanes that aren't asked for.

    ``planes_b`` is compared with ``planes_a`` plane by plane (the two broadcast
    against each other). Two planes enter the counters ``ones`` and ``twos`` per
    carry-save step; ``over`` is sticky. Lanes that are over the radius stay so,
    and the block is abandoned as soon as all of them are.
    """
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for b in range(0, 64, 2):
        x = planes_a[b] ^ planes_b[b]
        y = planes_a[b + 1] ^ planes_b[b + 1]
        half = ones ^ x
        carry = (ones & x) | (half & y)
        ones = half ^ y
        over |= twos & carry
        twos ^= carry
        if b % 8 == 6 and bool((over == full).all()):
            break
    return ~over


def lanes_after(n: int) -> np.ndarray:
    """Words for n lanes in which the padding lanes' bits are set."""
    words = np.zeros(-(-n // 64), np.uint64)
    if n % 64:
        words[-1] = np.uint64((0xFFFFFFFFFFFFFFFF << (n % 64)) & 0xFFFFFFFFFFFFFFFF)
    return words


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _union(parent: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
    for i, j in zip(left.tolist(), right.tolist()):
        a, b = _find(parent, i), _find(parent, j)
        if a != b:
            parent[max(a, b)] = min(a, b)


def small_bucket_pairs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within many small buckets at once. Lane i compares row i with the
    row ``shift`` places later; shifts run up to the largest bucket, and only
    rows that still have such a partner in their bucket become lanes."""
    last = np.repeat(starts + sizes - 1, sizes)
    rows = np.arange(len(values))
    left, right = [], []
    for shift in range(1, int(sizes.max(initial=1))):
        rows = rows[rows + shift <= last[rows]]
        if not len(rows):
            break
        near = near_lanes(bit_planes(values[rows]), bit_planes(values[rows + shift]), lanes_after(len(rows)))
        hits = np.flatnonzero(np.unpackbits(near.view(np.uint8), bitorder="little")[: len(rows)])
        left.append(rows[hits])
        right.append(rows[hits] + shift)
    if not left:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def large_bucket_forest(values: np.ndarray, parent: np.ndarray, base: int) -> None:
    """Links within one large bucket: 64 rows at a time meet all later rows,
    whose planes are stored once."""
    planes = bit_planes(values)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    no_later = np.array([(1 << (q + 1)) - 1 for q in range(64)], np.uint64)
    for at in range(0, len(values), 64):
        block = values[at : at + 64]
        masks = np.where((block[None, :] >> np.arange(64, dtype=np.uint64)[:, None]) & np.uint64(1), full, np.uint64(0))
        first = at // 64
        over = np.tile(lanes_after(len(values) - first * 64), (len(block), 1))
        over[:, 0] |= no_later[: len(block)]
        near = near_lanes(masks[:, :, None], planes[:, None, first:], over)
        query, lane = np.nonzero(np.unpackbits(np.ascontiguousarray(near).view(np.uint8), axis=1, bitorder="little"))
        i, j = query + at, lane + first * 64
        _union(parent, i + base, j + base)


def bucket_forest(values: np.ndarray, sizes: np.ndarray, large: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) links that join each bucket's linked fingerprints."""
    parent = np.arange(len(values))
    starts = np.cumsum(sizes) - sizes
    big = sizes > large
    if (~big).any():
        rows = np.flatnonzero(np.repeat(~big, sizes))
        small = sizes[~big]
        left, right = small_bucket_pairs(values[rows], np.cumsum(small) - small, small)
        _union(parent, rows[left], rows[right])
    for k in np.flatnonzero(big):
        large_bucket_forest(values[starts[k] : starts[k] + sizes[k]], parent, int(starts[k]))
    members = np.array([i for i in range(len(values)) if parent[i] != i], np.int64)
    roots = np.array([_find(parent, i) for i in members.tolist()], np.int64)
    return members, roots


def _forest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fps")
        offsets = np.asarray(lists.offsets)
        values = np.asarray(lists.values)[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64)
        members, roots = bucket_forest(values, np.diff(offsets).astype(np.int64))
        signed = values.view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(signed[members]), pa.array(signed[roots])], ["a", "b"])


def _block_keys() -> list:
    """Each table's key (its number and two of the five blocks of bits) with the
    bits of the other three blocks."""
    def block(low: int, width: int):
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))

    out = []
    for t, (x, y) in enumerate(combinations(BLOCKS, 2)):
        first, second, third = (block(*z) for z in BLOCKS if z not in (x, y))
        key = F.lit(t).cast("bigint") * (1 << 26) + block(*x) * (1 << 13) + block(*y)
        out.append(F.struct(key.alias("key"), (first * (1 << 26) + second * (1 << 13) + third).alias("rest")))
    return out


def fingerprint_links(classes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join all distinct fingerprints of ``classes`` (fp) at
    RADIUS or fewer differing bits into the same components.

    A bucket of more than ``chunk`` fingerprints is split by the bits that its
    key leaves open: of four parts of them, two fingerprints in reach agree on
    one at least. A part's bucket that is still larger is cut by hash into
    chunks and each pair of chunks meets in a group of its own, so no task holds
    a whole hot bucket. Hot keys are at most rows / chunk many; the optimiser
    decides by their measured size whether those joins are broadcast.
    """
    keyed = classes.select("fp", F.explode(F.array(*_block_keys())).alias("k")).select("fp", "k.key", "k.rest")
    large = lambda rows, *by: rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    hot = large(keyed, "key").select("key", F.lit(True).alias("hot"))
    part = lambda j: F.lit(j << 10).cast("bigint") + F.shiftrightunsigned("rest", 10 * j).bitwiseAND(F.lit(1023))
    sub = F.when(F.col("hot"), F.array(*map(part, range(RADIUS + 1)))).otherwise(F.array(F.lit(-1).cast("bigint")))
    spread = keyed.join(hot, "key", "left").select("key", "fp", F.explode(sub).alias("sub"))
    cut = large(spread.where("sub >= 0"), "key", "sub").select("key", "sub", F.ceil(F.col("n") / F.lit(chunk)).cast("int").alias("chunks"))
    mine = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    split = (
        spread.join(cut, ["key", "sub"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .select("key", "sub", "fp", mine.alias("mine"), other.alias("other"))
        .select("key", "sub", F.least("mine", "other").alias("lo"), F.greatest("mine", "other").alias("hi"), "fp")
    )
    buckets = (
        split.groupBy("key", "sub", "lo", "hi").agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1).select("fps")
    )
    return buckets.mapInArrow(_forest_batches, "a bigint, b bigint").distinct()


# ------------------------------------------------------------------ components
def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest
    node of its component. Alternates large-star and small-star rounds until a
    round changes nothing; only two numbers of a round reach the driver."""
    spark = links.sparkSession
    path = scratch_path(spark, "links")
    links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(path)
    edges = spark.read.parquet(path)
    mark = None
    for _ in count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(lowest.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = scratch_path(spark, "links")
        small.write.parquet(new)
        remove_scratch(spark, path)
        path, edges = new, spark.read.schema("u bigint, v bigint").parquet(new)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now


def near_duplicates(docs: DataFrame, id_columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``id_columns``, fp, component_id, root for each row of ``docs``; the first
    id column names the component (its smallest value). Where an id stands on
    different texts, components can share that name; root, the component's
    smallest fingerprint, is its own."""
    prints = written(fingerprints(docs, id_columns), "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min(id_columns[0]).alias("first_id")), "classes")
    roots = components(fingerprint_links(classes))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    named = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = rooted.join(named, "root").select("fp", "component_id", "root")
    return prints.join(of_class, "fp").select(*id_columns, "fp", "component_id", "root")


def near_duplicate_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that lead their component: the smallest doc_id
    (null last), then the smallest text hash. Rows that repeat both the id and
    the text of a leader count as its copies: the one whose columns have the
    smallest hash stays.

    Decisions are made on keys. A row is looked up by a broadcast of the keys
    that go, where those are few enough, so that texts aren't shuffled.
    """
    (hashed,) = free_names(docs, "hash")
    keys = docs.select("doc_id", text_hash(F.col("text")).alias(hashed), "text")
    found = near_duplicates(keys, ("doc_id", hashed)).select("root", F.col("doc_id").alias("id"), F.col(hashed).alias("h"))
    rank = F.struct(F.col("id").isNull().alias("n"), "id", "h")
    leaders = found.groupBy("root").agg(F.min(rank).alias("lead"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    groups = found.join(leaders, "root").groupBy("id", "h", "lead").agg(F.count("*").alias("n"))
    leads = F.col("lead.id").eqNullSafe(F.col("id")) & (F.col("lead.h") == F.col("h"))
    verdicts = groups.select("id", "h", leads.alias("leads"), "n").where("not leads or n > 1")
    verdicts = written(verdicts, "verdicts")
    mine, lead_id, lead_hash = free_names(docs, "mine", "lead_id", "lead_hash")
    keys_of = lambda df: few(df.select(F.col("id").alias(lead_id), F.col("h").alias(lead_hash)))
    rows = docs.select("*", F.col("doc_id").alias(mine), text_hash(F.col("text")).alias(hashed))
    same = F.col(mine).eqNullSafe(F.col(lead_id)) & (F.col(hashed) == F.col(lead_hash))
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = rows.join(keys_of(verdicts), same, "left_anti").select(*own)
    again = verdicts.where("leads")
    if again.isEmpty():
        return out
    whole = F.struct(*own)
    once = rows.join(keys_of(again), same).groupBy(lead_id, lead_hash).agg(F.min_by(whole, F.xxhash64(F.to_json(whole))).alias("row"))
    return out.unionByName(once.select("row.*"))
