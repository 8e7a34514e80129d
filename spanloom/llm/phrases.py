"""Phrase collocations from vertical positional inverted lists.

Texts are gathered in blocks; within a block words are numbered through, with a
gap between pieces, and each word's positions form a sorted list. A phrase is
extended by one word by a merge of its list with the lists of the words that
stand one position further; a list's length is the phrase's frequency in the
block, and the sum over the blocks its exact frequency. Only phrases with the
least frequency keep their lists for the next level. As both parts of a frequent
phrase are frequent, the adjacent words at a level are those that end a frequent
phrase of that level one position on: that merge is exact and gives, with the
phrase, its first and last parts, which hold all frequencies that scores need.

Lists stay with their block. What goes round is one bundle for each block and
bucket of phrases (by hash), with the phrases' numbers and list lengths; a
bucket's task sums the lengths, numbers the frequent phrases, and answers each
block with those it holds. A frequent phrase has one entry a block, however
often it occurs, and the number of buckets grows with the words, so no task's
input grows with the table.

Defined results
* null or empty text: no words. Null language: ``und``.
* very long texts: whole, in a block of their own if need be.
* repeated rows: each counts. Ties: by frequency, then by the phrase's bytes;
  cuts of equal score by the fewest words in the first part.
* empty table, or no frequent phrase: an empty result.
* further columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lexical import ranked
from .common import few, scratch_path, sweep, written

LEAST, MOST_WORDS, FIRST = 30, 4, 2000
SCALE = 2_000_000
#: Of 100 occurrences of a phrase so many in one longer phrase make it a part of that.
ABSORBED = 80
#: Bytes of texts in a block.
BLOCK_BYTES = 12 << 20
#: Bytes of frequent words up to which they are broadcast.
BROADCAST_BYTES = 64 << 20
BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
#: A-Z to a-z, every break to a line feed, tab to blank; all other bytes stay.
FOLD = bytes(0x0A if b in BREAKS else 0x20 if b == 0x09 else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))

LISTS = "block long, lang string, word string, cnt long, places binary"
BUNDLES = "block long, bucket long, bundle binary"
FOUND = "head long, tail long, a long, id long"
#: Words for which there is one bucket of phrases.
BUCKET_WORDS = 1 << 21


# ----------------------------------------------------------------------- lists
def packed(places: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Sorted lists, one after the other from ``starts``, as binary values: the
    differences (the first place as it is) of seven bits a byte, lowest first,
    the top bit set where more follow."""
    if not len(starts):
        return pa.array([], pa.binary())
    steps = np.diff(places, prepend=0)
    steps[starts] = places[starts]
    size = np.ones(len(steps), np.uint8)
    for bits in range(7, 35, 7):
        size += steps >= 1 << bits
    after = np.cumsum(size, dtype=np.int64)
    first, out = after - size, np.zeros(after[-1], np.uint8)
    for i in range(int(size.max())):
        at = np.flatnonzero(size > i)
        out[first[at] + i] = ((steps[at] >> (7 * i)) & 127) | np.where(size[at] > i + 1, 128, 0)
    ends = np.append(first[starts], after[-1]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(out.tobytes())])


def unpacked(lists: pa.ChunkedArray, counts: np.ndarray) -> np.ndarray:
    """All places of packed lists, whose lengths are known, one after the other."""
    raw = np.frombuffer(b"".join(lists.to_pylist()), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64)
    first = np.concatenate(([0], np.flatnonzero(raw < 128)[:-1] + 1))
    steps = (raw[first] & 127).astype(np.int64)
    size = np.diff(np.append(first, len(raw)))
    for i in range(1, int(size.max())):
        at = np.flatnonzero(size > i)
        steps[at] |= (raw[first[at] + i] & 127).astype(np.int64) << (7 * i)
    summed = np.cumsum(steps)
    starts = np.cumsum(counts) - counts
    return summed - np.repeat(summed[starts] - steps[starts], counts)


class Block:
    """Word numbers and places of the texts of a block, by language."""

    def __init__(self):
        self.numbers: dict[str, defaultdict] = {}
        self.ids: dict[str, list[int]] = {}
        self.bytes = 0

    def add(self, lang: str, text: bytes) -> None:
        self.bytes += len(text)
        numbers = self.numbers.get(lang)
        if numbers is None:
            numbers = self.numbers[lang] = defaultdict()
            numbers.default_factory = numbers.__len__
            self.ids[lang] = []
        ids = self.ids[lang]
        number = numbers.__getitem__
        for piece in text.translate(FOLD).split(b"\n"):
            # Only blanks are white space here, and they never stand alone as a word.
            words = [w for w in piece.split(b" ") if w]
            if words:
                ids.extend(map(number, words))
                ids.append(-1)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        base = 0
        for lang, numbers in self.numbers.items():
            ids = np.array(self.ids[lang], np.int64)
            order = np.argsort(ids, kind="stable")
            order = order[np.searchsorted(ids[order], 0) :]
            if len(order):
                counts = np.bincount(ids[order], minlength=len(numbers))
                starts = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(numbers), block)), pa.array([lang] * len(numbers), pa.string()), pa.array([w.decode("utf-8", "replace") for w in numbers], pa.string()),
                     pa.array(counts.astype(np.int64)), packed(order + base, starts)],
                    names=["block", "lang", "word", "cnt", "places"],
                )
            base += len(ids)


def word_lists(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """block, lang, word, cnt, places: the lists of each block's words."""
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for of, raw in zip(batch.column("lang"), batch.column("text")):
                block.add(of.as_py(), raw.as_py())
                if block.bytes >= BLOCK_BYTES:
                    yield from block.rows(number)
                    number, block = number + 1, Block()
        yield from block.rows(number)

    return rows.mapInArrow(task, LISTS)


# --------------------------------------------------------------------- bundles
def sealed(*arrays: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes, lowest bytes first."""
    planes = [np.ascontiguousarray(np.asarray(a).astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for a in arrays]
    lengths = np.array([len(arrays), *map(len, arrays)], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(lengths + b"".join(planes))


def opened(bundle: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(bundle)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    out, at = [], 8 * (n + 1)
    for length in np.frombuffer(raw, "<i8", n, 8):
        planes = np.frombuffer(raw, np.uint8, 8 * length, at).reshape(8, -1)
        out.append(np.ascontiguousarray(planes.T).view("<i8").reshape(-1))
        at += 8 * int(length)
    return out


def bucket_of(head: np.ndarray, tail: np.ndarray, buckets: int) -> np.ndarray:
    mixed = head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + tail.astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _runs(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys start in sorted arrays."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _table(rows: list[tuple], schema: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.Table.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, schema)], names=[name for name, _ in schema])


def _bundled(rows: list[tuple]) -> pa.Table:
    return _table(rows, [("block", pa.int64()), ("bucket", pa.int64()), ("bundle", pa.binary())])


def extended(block: int, at: np.ndarray, ids: np.ndarray, buckets: int, keep: bool) -> pa.Table:
    """Bundles of a block for each bucket: head, tail and list length of the
    phrases of one more word, which stand where ``head`` stands and ``tail``
    stands one position further; and, without a bucket, the block's own lists.
    Places ascend: one phrase of a level begins at each."""
    follows = np.flatnonzero(np.diff(at) == 1)
    head, tail = ids[follows], ids[follows + 1]
    bucket = bucket_of(head, tail, buckets)
    order = np.lexsort((tail, head, bucket))
    head, tail, bucket = head[order], tail[order], bucket[order]
    new = _runs(bucket, head, tail)
    counts = np.diff(np.append(new, len(head)))
    head, tail, bucket = head[new], tail[new], bucket[new]
    ends = np.append(_runs(bucket), len(bucket))
    rows = [(block, int(bucket[i]), sealed(np.diff(head[i:j], prepend=0), tail[i:j], counts[i:j])) for i, j in zip(ends[:-1], ends[1:])]
    if keep and len(follows):
        # Only places that follow or are followed can be part of longer phrases.
        used = np.union1d(follows, follows + 1)
        at, ids = at[used], ids[used]
        order = np.argsort(ids, kind="stable")
        at, ids = at[order], ids[order]
        new = _runs(ids)
        lengths = np.diff(np.append(new, len(ids)))
        steps = np.diff(at, prepend=0)
        steps[new] = at[new]
        rows.append((block, None, sealed(ids[new], lengths, steps)))
    return _bundled(rows)


def _in_order(ids: np.ndarray, counts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists' places in ascending order, and the phrase at each."""
    order = np.argsort(at, kind="stable")
    return at[order], np.repeat(ids, counts)[order]


def _first_bundles(lists: DataFrame, buckets: int) -> DataFrame:
    """Bundles of the pairs of words from the words' lists (block, id, cnt, places)."""
    def task(table: pa.Table) -> pa.Table:
        counts = table.column("cnt").to_numpy()
        at, ids = _in_order(table.column("id").to_numpy(), counts, unpacked(table.column("places"), counts))
        return extended(table.column("block")[0].as_py(), at, ids, buckets, True)

    return lists.groupBy("block").applyInArrow(task, BUNDLES)


def _next_bundles(lists: DataFrame, frequent: DataFrame, buckets: int, keep: bool) -> DataFrame:
    """Bundles of the next level from the blocks' lists of one level before and
    the frequent phrases (head, tail, id) of this level in each block."""
    def task(own: pa.Table, answers: pa.Table) -> pa.Table:
        if not own.num_rows or not answers.num_rows:
            return _bundled([])
        ids, counts, steps = opened(own.column("bundle")[0].as_py())
        summed, starts = np.cumsum(steps), np.cumsum(counts) - counts
        at, phrase = _in_order(ids, counts, summed - np.repeat(summed[starts] - steps[starts], counts))
        head, tail, number = (np.concatenate(c) for c in zip(*(opened(b) for b in answers.column("bundle").to_pylist())))
        place = lambda heads, tails: np.searchsorted(ids, heads) * len(ids) + np.searchsorted(ids, tails)
        known = place(head, tail)
        order = np.argsort(known)
        known, number = known[order], number[order]
        follows = np.flatnonzero(np.diff(at) == 1)
        asked = place(phrase[follows], phrase[follows + 1])
        found = np.minimum(np.searchsorted(known, asked), len(known) - 1)
        hit = known[found] == asked
        return extended(own.column("block")[0].as_py(), at[follows[hit]], number[found[hit]], buckets, keep)

    return lists.groupBy("block").cogroup(frequent.groupBy("block")).applyInArrow(task, BUNDLES)


def _answered(bundles: DataFrame, least: int) -> DataFrame:
    """For each bucket: its frequent phrases (head, tail, a, id) in one bundle
    without a block, and for each block those that it holds (head, tail, id)."""
    def task(table: pa.Table) -> pa.Table:
        bucket, parts = table.column("bucket")[0].as_py(), [opened(b) for b in table.column("bundle").to_pylist()]
        block = np.repeat(table.column("block").to_numpy(), [len(p[0]) for p in parts])
        head, tail, count = (np.concatenate(c) for c in zip(*((np.cumsum(h), t, n) for h, t, n in parts)))
        order = np.lexsort((tail, head))
        new = _runs(head[order], tail[order])
        total = np.add.reduceat(count[order], new)
        often = total >= least
        number = np.where(often, (bucket << 32) + np.cumsum(often) - 1, -1)
        first = order[new[often]]
        rows = [(None, bucket, sealed(head[first], tail[first], total[often], number[often]))] if len(first) else []
        given = np.empty(len(order), np.int64)
        given[order] = np.repeat(number, np.diff(np.append(new, len(order))))
        kept = np.flatnonzero(given >= 0)
        kept = kept[np.argsort(block[kept], kind="stable")]
        ends = np.append(_runs(block[kept]), len(kept))
        for i, j in zip(ends[:-1], ends[1:]):
            at = kept[i:j]
            rows.append((int(block[at[0]]), bucket, sealed(head[at], tail[at], given[at])))
        return _bundled(rows)

    return bundles.where("bucket is not null").groupBy("bucket").applyInArrow(task, BUNDLES)


def _found(answers: DataFrame) -> DataFrame:
    """head, tail, a, id of all frequent phrases of a level."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle in batch.column("bundle"):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in opened(bundle.as_py())], names=["head", "tail", "a", "id"])

    return answers.where("block is null").select("bundle").mapInArrow(task, FOUND)


# ---------------------------------------------------------------------- levels
def _kept(lists: DataFrame, words: DataFrame) -> DataFrame:
    """The lists of frequent words, by their ids; the words are broadcast if
    both their number and their bytes are bounded."""
    keys = words.select("lang", "word", "id")
    length = keys.agg(F.sum(F.octet_length("lang") + F.octet_length("word"))).first()[0]
    return lists.join(few(keys) if (length or 0) <= BROADCAST_BYTES else keys, ["lang", "word"]).select("block", "id", "cnt", "places")


class _Scratch:
    """Written tables of one run that are deleted when a later one rests on them."""

    def __init__(self, spark):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = scratch_path(self.spark, name)
        df.write.parquet(self.paths[name])
        return self.spark.read.schema(df.schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        sweep(self.spark, {self.paths.pop(name) for name in names if name in self.paths})


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(SCALE * a / (l + r)) without a limit of 64 bits for the product."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", wide(a) * F.lit(SCALE).cast("decimal(8,0)"), wide(l) + wide(r))


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of the frequent phrases of 1, 2, ... words (id, lang, phrase, a,
    and for two words or more: head and tail, the ids of the phrases without the
    last and without the first word), and lang, n."""
    scratch = _Scratch(docs.sparkSession)
    lists = scratch.write(word_lists(docs), "wordlists")
    totals = written(lists.groupBy("lang").agg(F.sum("cnt").alias("n")), "totals")
    counted = lists.groupBy("lang", "word").agg(F.sum("cnt").alias("a")).where(F.col("a") >= least)
    words = written(counted.withColumn("id", F.monotonically_increasing_id()), "words")
    buckets = 1 + (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS
    levels = [words.select("id", "lang", F.col("word").alias("phrase"), "a")]
    bundles = scratch.write(_first_bundles(_kept(lists, words), buckets), "bundles2") if most_words > 1 else None
    scratch.drop("wordlists")
    for size in range(2, most_words + 1):
        answers = scratch.write(_answered(bundles, least), f"answers{size}")
        head = levels[-1].select(F.col("id").alias("head"), "lang", F.col("phrase").alias("first"))
        tail = levels[-1].select(F.col("id").alias("tail"), F.substring_index("phrase", " ", -1).alias("last"))
        named = _found(answers).join(head, "head").join(tail, "tail")
        levels.append(written(named.select("id", "lang", F.concat_ws(" ", "first", "last").alias("phrase"), "a", "head", "tail"), f"phrases{size}"))
        if size < most_words:
            own, frequent = bundles.where("bucket is null"), answers.where("block is not null")
            bundles = scratch.write(_next_bundles(own, frequent, buckets, size + 1 < most_words), f"bundles{size + 1}")
        scratch.drop(f"bundles{size}", f"answers{size}")
    return levels, totals


def _with_parts(levels: list[DataFrame]) -> list[DataFrame]:
    """The phrases of two words or more with the frequencies l and r of the
    parts of every cut, as ``cuts``: (l, r) from the shortest first part on."""
    out, before = [], levels[0].select("id", F.array("a").alias("fronts"), F.array("a").alias("backs"))
    for level in levels[1:]:
        # fronts: frequencies of the beginnings of 1, 2, ... words, the phrase itself last; backs: of the endings.
        front = before.select(F.col("id").alias("head"), "fronts")
        back = before.select(F.col("id").alias("tail"), "backs")
        both = level.join(front, "head").join(back, "tail")
        out.append(both.select("id", "lang", "phrase", "a", "head", "tail", F.arrays_zip(F.col("fronts").alias("l"), F.reverse("backs").alias("r")).alias("cuts")))
        before = both.select("id", F.concat("fronts", F.array("a")).alias("fronts"), F.concat("backs", F.array("a")).alias("backs"))
    return out


def _longest(levels: list[DataFrame]) -> list[DataFrame]:
    """For each level of two words or more: id, f, the largest frequency of a
    longer phrase that holds the phrase."""
    out, above = [], None
    for level in reversed(levels[1:]):
        f = F.col("a") if above is None else F.greatest("a", F.coalesce("f", F.lit(0)))
        reach = level if above is None else level.join(above, "id", "left")
        out.append(above)
        parts = reach.select(F.explode(F.array("head", "tail")).alias("id"), f.alias("f"))
        above = parts.groupBy("id").agg(F.max("f").alias("f"))
    return out[::-1]


def collocations(docs: DataFrame, least: int = LEAST, most_words: int = MOST_WORDS, first: int = FIRST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``first`` phrases of each
    language by the score of their worst cut."""
    levels, totals = frequent_phrases(docs, least, most_words)
    out = None
    for level, longer in zip(_with_parts(levels), _longest(levels)):
        if longer is not None:
            inside = 100 * F.col("f").cast("decimal(20,0)") >= ABSORBED * F.col("a").cast("decimal(20,0)")
            level = level.join(longer, "id", "left").where(~F.coalesce(inside, F.lit(False)))
        scored = F.transform("cuts", lambda c, k: F.struct(_score(F.col("a"), c["l"], c["r"]).alias("score"), k.alias("k"), c["l"].alias("l"), c["r"].alias("r")))
        one = level.select("lang", "phrase", "a", F.array_min(scored).alias("cut"))
        out = one if out is None else out.unionByName(one)
    flat = out.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    best = ranked(flat, [F.desc("score"), F.desc("a"), "phrase"], ["lang"], first)
    return best.join(few(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocation_report(docs: DataFrame) -> DataFrame:
    return collocations(docs)


def _oracle() -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, {size} AS k, {' || chr(32) || '.join(f'w{i}' for i in range(size))} AS phrase, count(*) AS a FROM p WHERE w{size - 1} IS NOT NULL GROUP BY ALL"
        for size in range(1, MOST_WORDS + 1)
    )
    part = "array_to_string(string_split(phrase, ' ')[{}:{}], ' ')"
    cuts = " UNION ALL ".join(
        f"SELECT lang, k, phrase, a, {cut} AS cut, {part.format(1, cut)} AS front, {part.format(cut + 1, size)} AS back FROM c WHERE k = {size}"
        for size in range(2, MOST_WORDS + 1) for cut in range(1, size)
    )
    return f"""WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT doc, lang, unnest(range(1, len(ps) + 1)) AS piece, unnest(ps) AS x FROM (SELECT *, string_split_regex(t, '[.,;:!?\\x0A-\\x0D]') AS ps FROM d)),
w AS (SELECT doc, lang, piece, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS w0 FROM (SELECT *, list_filter(string_split_regex(x, '[\\x20\\x09]+'), lambda y: y <> '') AS ws FROM pieces)),
p AS (SELECT lang, w0, lead(w0) OVER o AS w1, lead(w0, 2) OVER o AS w2, lead(w0, 3) OVER o AS w3 FROM w WINDOW o AS (PARTITION BY doc, piece ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang), f AS MATERIALIZED (SELECT * FROM ({grams}) WHERE a >= {LEAST}), c AS (SELECT * FROM f WHERE k > 1),
cuts AS ({cuts}), s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, ({SCALE} * c.a::HUGEINT // (x.a + y.a))::BIGINT AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.front JOIN f y ON y.lang = c.lang AND y.phrase = c.back),
worst AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
kept AS (SELECT * FROM worst x WHERE NOT EXISTS (SELECT 1 FROM c y WHERE y.lang = x.lang AND y.k > x.k AND contains(' ' || y.phrase || ' ', ' ' || x.phrase || ' ') AND 100 * y.a >= {ABSORBED} * x.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN n USING (lang) WHERE rank <= {FIRST}"""


ORACLE = _oracle()
