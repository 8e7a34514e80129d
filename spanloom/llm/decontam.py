"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions.

A text's lower-cased words become 64-bit hashes. A document overlaps an item
where a window of w aligned words has at most t different ones, with one rule for
all lengths: w is WINDOW or the item's length if that is less, and t is a
SUBSTITUTED share of w (two in thirteen; one in seven to twelve; none below).

At each position fixed masks hash some of the next words and ignore the rest;
equal hashes of an item and a document are hits, and the windows around a hit
are verified word by word. The masks of an item's length class together meet
every placing of its substitutions, so no window is lost (a test tries all).
Masks that no item of the benchmark uses are left out.

The corpus is neither shuffled nor exploded on disk: positions are generated,
hashed and probed inside one generated stage, and only hits reach an
aggregation. The seeds of the benchmark are broadcast in slices whose size is
counted first; more slices mean more passes over the written word hashes, not a
larger broadcast. Positions of an item whose surroundings are equal to the width
of a window give one seed, so repetitive items don't multiply hits.

Defined results
* null or empty text on either side: no overlap.
* very long texts: all positions are probed.
* items of equal words: the smallest item_id stands for them (null if all are).
* ties: matched is the best window's; the words' span covers all windows.
* rows of one doc_id are reported together; a null doc_id is an id of its own.
* repeated rows and items change nothing; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import few, free_names, text_hash, written

WINDOW = 13
#: Substitutions that a window of w words may have: w * 2 // 13.
SUBSTITUTED = (2, 13)
#: By least item length: offsets of the words that each mask hashes.
CLASSES = (
    (13, ((0, 1, 2, 3, 4, 5), (0, 3, 4, 6, 8, 9), (0, 2, 3, 4, 6, 7))),
    (7, ((0, 1, 2, 3), (0, 2, 4, 6))),
    (4, ((0, 1, 2, 3),)),
    (3, ((0, 1, 2),)),
    (2, ((0, 1),)),
    (1, ((0,),)),
)
#: The class of whole windows.
MASKS, SUBSTITUTIONS = CLASSES[0][1], WINDOW * SUBSTITUTED[0] // SUBSTITUTED[1]
#: Seeds of one broadcast slice (some 40 bytes each), and words of items that are broadcast.
SLICE_SEEDS = 1_500_000
SLICE_WORDS = 5_000_000
#: Matched words from which an overlap counts by itself, and the share of all
#: documents that a shorter item may overlap to count.
INFORMATIVE, SHORT_SHARE = 7, 0.001
WORD = r"[\p{L}\p{N}]+"


def tolerance(words: int) -> int:
    """Substitutions that an item of so many words may have in a window."""
    return min(words, WINDOW) * SUBSTITUTED[0] // SUBSTITUTED[1]


def masks_of(words: int) -> tuple[tuple[int, ...], ...]:
    """The masks of an item of so many words."""
    return next(masks for least, masks in CLASSES if words >= least)


def word_hashes(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(hashes: str, at: Column, mask: Column, masks: list[tuple[int, ...]]) -> Column:
    """The hash of one mask at one position. It is never null, so that the probe
    gets no filter: words past the end count as absent."""
    one = [F.xxhash64(F.lit(len(m) * 100 + m[-1]), *[F.get(F.col(hashes), at + o) for o in m]) for m in masks]
    out = one[-1]
    for k in range(len(masks) - 1):
        out = F.when(mask == k, one[k]).otherwise(out)
    return out


def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """item_id, ih (word hashes) of each distinct item with a word."""
    hashed = benchmark.select("item_id", word_hashes(F.col("text")).alias("ih")).where(F.size("ih") > 0)
    return hashed.groupBy("ih").agg(F.min("item_id").alias("item_id"))


def item_seeds(items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """seed, item_key, p for every mask of an item's class that fits at one of
    its positions; one position of those with equal surroundings."""
    spread = items.select("item_key", "ih", F.explode(F.sequence(F.lit(0), F.size("ih") * len(masks) - 1)).alias("i"))
    at, mask = F.expr(f"cast(i div {len(masks)} as int)"), F.col("i") % len(masks)
    used = F.lit(False)
    upper = None
    for least, own in CLASSES:
        of_class = F.size("ih") >= least
        of_class = of_class if upper is None else of_class & (F.size("ih") < upper)
        used = used | (of_class & mask.isin([masks.index(m) for m in own if m in masks]))
        upper = least
    w = F.least(F.lit(WINDOW), F.size("ih"))
    # Words that windows around this position can span, and the item's ends.
    before, after = F.least(at, w - 1), F.least(F.size("ih") - at, w)
    around = F.xxhash64(before, after, F.slice("ih", at - before + 1, before + after))
    spans = F.element_at(F.array(*[F.lit(m[-1]) for m in masks]), mask + 1)
    fits = spread.where(used & (at + spans < F.size("ih")))
    fits = fits.select(_seed("ih", at, mask, masks).alias("seed"), "item_key", at.alias("p"), around.alias("around"))
    return fits.groupBy("seed", "item_key", "around").agg(F.min("p").alias("p")).drop("around")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, matched (most equal words of a window), first_word and
    last_word (the word positions that the windows in reach span)."""
    items = written(benchmark_items(benchmark).withColumn("item_key", F.xxhash64("ih")), "benchmark-items")
    size = F.size("ih")
    least = F.coalesce(*[F.when(size >= n, F.lit(n)) for n, _ in CLASSES])
    found = items.groupBy(least.alias("least")).agg(F.sum(size).alias("words")).collect()
    present = {r["least"] for r in found}
    masks = list(dict.fromkeys(m for n, own in CLASSES if n in present for m in own)) or [CLASSES[0][1][0]]
    seeds = written(item_seeds(items, masks), "benchmark-seeds")
    slices = max(1, math.ceil(seeds.count() / SLICE_SEEDS))
    small = sum(r["words"] for r in found) <= SLICE_WORDS
    hashed = docs.select("doc_id", word_hashes(F.col("text")).alias("h"))
    if slices > 1:
        hashed = written(hashed, "word-hashes")
    out = None
    for k in range(slices):
        part = seeds.where(F.pmod(F.xxhash64("seed"), F.lit(slices)) == k)
        found = _verified(hashed, part, F.broadcast(items) if small else items, masks)
        out = found if out is None else out.unionByName(found)
    # The verdict is applied to the aggregate: a filter here would join the probe
    # itself and take it out of generated code.
    return out.groupBy("doc_id", "item_id").agg(
        F.max("matched").alias("matched"), F.min("first_word").alias("first_word"), F.max("last_word").alias("last_word")
    ).where("matched is not null")


def _verified(hashed: DataFrame, seeds: DataFrame, items: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """Hits with their windows. No filter stands between the hashing of a text
    and the probes, as it would be pushed down and hash the text once more."""
    n_masks = len(masks)
    positions = F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") * n_masks - 1)))
    at = F.expr(f"cast(j div {n_masks} as int)")
    probes = hashed.select("doc_id", "h", positions.alias("j")).select(
        "doc_id", "h", at.alias("i"), _seed("h", at, F.col("j") % n_masks, masks).alias("seed")
    )
    # Seeds are bounded by SLICE_SEEDS, counted above; of the text only the words
    # in reach go on.
    hits = probes.join(F.broadcast(seeds), "seed")
    begin = F.greatest(F.col("i") - WINDOW + 1, F.lit(0))
    near = hits.select("doc_id", "item_key", "i", "p", begin.alias("from"), F.slice("h", begin + 1, 2 * WINDOW).alias("near"))
    hits = near.join(items, "item_key")
    w = F.least(F.lit(WINDOW), F.size("ih"))
    d = F.col("i") - F.col("p")
    low = F.greatest(F.col("p") - w + 1, F.lit(0), -d)
    high = F.least(F.col("p") + w, F.size("ih"), F.col("from") + F.size("near") - d)
    length = F.greatest(high - low, F.lit(0))
    cut = hits.select(
        "doc_id", "item_id", w.alias("w"), (low + d).alias("at"),
        F.slice("near", low + d - F.col("from") + 1, length).alias("dh"), F.slice("ih", low + 1, length).alias("sh"),
    )
    same = F.zip_with("dh", "sh", lambda x, y: F.when(x == y, 1).otherwise(0))
    cut = cut.select("doc_id", "item_id", "w", "at", same.alias("eq"))
    total = lambda s: F.aggregate(F.slice("eq", s + 1, F.col("w")), F.lit(0), lambda a, x: a + x)
    starts = F.when(F.size("eq") >= F.col("w"), F.sequence(F.lit(0), F.size("eq") - F.col("w"))).otherwise(F.array().cast("array<int>"))
    scored = cut.select("doc_id", "item_id", "w", "at", F.transform(starts, lambda s: F.struct(s.alias("s"), total(s).alias("n"))).alias("windows"))
    least = F.col("w") - F.floor(F.col("w") * SUBSTITUTED[0] / SUBSTITUTED[1]).cast("int")
    good = F.filter("windows", lambda x: x.n >= least)
    scored = scored.select("doc_id", "item_id", "w", "at", good.alias("good"))
    edge = lambda pick: F.col("at") + pick(F.transform("good", lambda x: x.s))
    return scored.select(
        "doc_id", "item_id", F.array_max(F.transform("good", lambda x: x.n)).alias("matched"),
        edge(F.array_min).alias("first_word"), (edge(F.array_max) + F.col("w") - 1).alias("last_word"),
    )


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each doc_id and item_id that overlap."""
    return overlaps(docs, benchmark)


def telling(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The overlaps that are evidence of contamination: those of INFORMATIVE
    matched words or more, and shorter ones if their item overlaps at most
    SHORT_SHARE of the documents. A short item that many documents hold (an
    answer "yes") tells nothing about any of them; it is reported only."""
    short = F.col("matched") < INFORMATIVE
    if not found.where(short).limit(1).count():
        return found
    held = found.where(short).groupBy("item_id").agg(F.count_distinct("doc_id").alias("_held"))
    rare = few(held.where(F.col("_held") <= SHORT_SHARE * docs.count()).select(F.col("item_id").alias("_rare")))
    return found.where(~short).unionByName(found.where(short).join(rare, F.col("item_id").eqNullSafe(F.col("_rare")), "left_semi"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a ``telling`` overlap with a benchmark item.
    They are looked up by a broadcast of the keys that go, where those are few
    enough, so that texts aren't shuffled."""
    mine, hashed, bad_id, bad_hash = free_names(docs, "mine", "hash", "bad_id", "bad_hash")
    keyed = docs.select(F.struct("doc_id", text_hash(F.col("text")).alias("hash")).alias("doc_id"), "text")
    found = written(overlaps(keyed, benchmark).select("doc_id", "item_id", "matched"), "contaminated")
    bad = telling(found, docs).select(F.col("doc_id.doc_id").alias(bad_id), F.col("doc_id.hash").alias(bad_hash)).distinct()
    bad = few(bad)
    rows = docs.select("*", F.col("doc_id").alias(mine), text_hash(F.col("text")).alias(hashed))
    same = F.col(mine).eqNullSafe(F.col(bad_id)) & (F.col(hashed) == F.col(bad_hash))
    return rows.join(bad, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
