"""Toxicity by compression distance.

Two Zstandard dictionaries are trained, one on toxic and one on ordinary text.
Both begin with the same common content, which the library's trainer builds from
ordinary windows, so a window's two compressed lengths differ only by what the
special parts know. The library's trainer builds these too, from the pieces of a
label's windows that tell it from the other label: places where a run of GRAM
bytes makes up LIFT times the share of a text that it does in the other label's
texts. Shares count up to FULL of a text, so one text that repeats a run weighs
no more than any other. A run needs the weight of EVIDENCE texts, however many
texts there are: a language with few toxic texts takes part, and the forms of a
word are pooled by the run that they share.

A text is cut at blanks into windows of some WINDOW bytes. Its windows' length
differences (mean, largest, share over a threshold) are turned into a
probability by a logistic curve that is calibrated on cross-fitted differences:
no calibration text is scored with dictionaries trained on itself.

Training reads labelled texts of crc32(doc_id) mod 5 <> 0, a bounded sample: at
most ``toxic`` and ``ordinary`` texts, the lowest hashes first, whole, until
``sample_bytes``. Copies among them count once. Scores cover all rows.

Defined results
* null or empty text: the score of a text without any difference.
* null doc_id: held_out is false; the row is never learnt from.
* several labels of one doc_id: toxic if any of them is; null labels are ignored.
* several texts of one doc_id: the one with the smallest hash is learnt from.
* very long texts: scored whole, window by window. Ties: none.
* no toxic or no ordinary label at all: the score is 0 or 1 for every text.
* repeated rows give repeated results; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_crc, written

WINDOW = 64
LEVEL = 3
GRAM = 6
LIFT = 10
FULL = 0.002
EVIDENCE = 2
AROUND = 2
SEGMENT, MER = 12, 8
FOLDS = 6
COMMON_BYTES, SPECIAL_BYTES = 16384, 1536
FLAGGED = 2


def lowered(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "replace")


def windows(data: bytes, size: int = WINDOW) -> list[bytes]:
    """Consecutive windows of at most ``size`` bytes, cut after a blank if one
    stands in the second half."""
    out, at = [], 0
    while at < len(data):
        end = min(len(data), at + size)
        if end < len(data):
            blank = data.rfind(b" ", at + size // 2, end)
            end = blank if blank > 0 else end
        out.append(data[at:end])
        at = end
    return out


def distinct_texts(texts: list[bytes]) -> list[int]:
    """Indexes of texts apart from exact and near copies: a text goes if it
    shares one of four minimum hashes of three-word shingles with a kept one."""
    seen: set = set()
    kept = []
    for k, text in enumerate(texts):
        words = text.split()
        spans = range(max(1, len(words) - 2))
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words[i : i + 3])) for i in spans], np.uint64)
        marks = {(i, int((h * np.uint64(m)).min())) for i, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))}
        if not marks & seen:
            kept.append(k)
            seen |= marks
    return kept


def trained_content(samples: list[bytes], size: int, k: int = 64, d: int = 6) -> bytes:
    """The content of a trained dictionary; the samples themselves where they
    are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples, k=k, d=d).as_bytes()[-(size - 300) :]
    except zstandard.ZstdError:
        return b"".join(samples)[-(size - 300) :]


def grams(data: bytes) -> np.ndarray:
    """Each run of GRAM bytes as a number, in order."""
    a = np.frombuffer(data, np.uint8).astype(np.uint64)
    n = max(0, len(a) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for k in range(GRAM):
        out = (out << np.uint64(8)) | a[k : k + n]
    return out


def places(sought: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``sought`` are in the sorted ``known``, and where there."""
    at = np.searchsorted(known, sought)
    at[at == len(known)] = 0
    return known[at] == sought if len(known) else np.zeros(len(sought), bool), at


def telling_grams(mine: list[bytes], other: list[bytes]) -> np.ndarray:
    """Runs of bytes that tell the texts ``mine`` from ``other``, sorted."""
    known, texts = np.unique(np.concatenate([np.unique(grams(t)) for t in mine]), return_counts=True)
    known = known[texts > EVIDENCE]

    def weight(side: list[bytes]) -> np.ndarray:
        total = np.zeros(len(known))
        for t in side:
            own, n = np.unique(grams(t), return_counts=True)
            found, at = places(own, known)
            total[at[found]] += np.minimum(n[found] / (FULL * len(t)), 1)
        return total

    has, rest = weight(mine), weight(other)
    return known[(has >= EVIDENCE) & (has / len(mine) >= LIFT * (rest + 1) / max(1, len(other)))]


def telling_pieces(texts: list[bytes], telling: np.ndarray) -> list[bytes]:
    """The places of telling runs with AROUND bytes on both sides, within the
    words that they touch."""
    out = []
    for t in texts:
        found, _ = places(grams(t), telling)
        spans = set()
        for i in np.flatnonzero(found).tolist():
            first, end = max(0, t.rfind(b" ", 0, i + 1)), t.find(b" ", i + GRAM - 1) + 1 or len(t)
            spans.add((max(first, i - AROUND), min(end, i + GRAM + AROUND)))
        out += [t[a:b].ljust(8) for a, b in sorted(spans)]
    return out


class Distance:
    """Compressed lengths of windows under the two dictionaries."""

    def __init__(self, toxic: list[bytes], ordinary: list[bytes]):
        special = []
        for mine, other in ((toxic, ordinary), (ordinary, toxic)):
            pieces = telling_pieces(mine, telling_grams(mine, other))
            special.append(trained_content(pieces, SPECIAL_BYTES + 300, SEGMENT, MER) if pieces else b"")
        self.common = trained_content([w for text in ordinary for w in windows(text, 96)], COMMON_BYTES)
        longest = max(8, *map(len, special))
        self.special = [s.rjust(longest, b"\0") for s in special]
        self._tools = None

    def __getstate__(self) -> dict:
        return {"common": self.common, "special": self.special, "_tools": None}

    def differences(self, data: bytes) -> np.ndarray:
        """Ordinary minus toxic length of each window."""
        if self._tools is None:
            self._tools = [
                zstandard.ZstdCompressor(
                    level=LEVEL, write_content_size=False,
                    dict_data=zstandard.ZstdCompressionDict(self.common + s, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                ).compress
                for s in self.special
            ]
        toxic, ordinary = self._tools
        return np.array([len(ordinary(w)) - len(toxic(w)) for w in windows(data)], np.float64)


def features(d: np.ndarray) -> np.ndarray:
    if not len(d):
        return np.zeros(4)
    return np.array([d.mean(), np.clip(d.max(), 0, 12) / 4, (d >= FLAGGED).mean() * 4, np.log1p((d >= FLAGGED).sum())])


def fit_curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.02, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the last entry is the intercept."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    ridge = penalty * np.diag([1.0] * x.shape[1] + [1e-6])
    weight = weight / weight.sum() * len(weight)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        step = np.linalg.solve((x1 * (weight * p * (1 - p))[:, None]).T @ x1 + ridge, x1.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class ToxicityModel:
    def __init__(self, texts: list[bytes], labels: list[int], shares: dict[int, float]):
        """``shares``: how many labelled rows of the corpus stand for each label."""
        self.constant = None
        if len(set(labels)) < 2:
            self.constant = float(labels[0]) if labels else 0.0
            return
        groups = {v: [t for t, y in zip(texts, labels) if y == v] for v in (0, 1)}
        groups = {v: [g[k] for k in distinct_texts(g)] for v, g in groups.items()}
        folds = FOLDS
        x, y = [], []
        for k in range(folds):
            rest = {v: [t for i, t in enumerate(g) if i % folds != k] or g for v, g in groups.items()}
            part = Distance(rest[1], rest[0])
            for v, g in groups.items():
                for i, t in enumerate(g):
                    if i % folds == k:
                        x.append(features(part.differences(t)))
                        y.append(v)
        y = np.array(y, np.float64)
        weight = np.where(y > 0, shares[1] / max(1, len(groups[1])), shares[0] / max(1, len(groups[0])))
        self.curve = fit_curve(np.array(x), y, weight)
        self.distance = Distance(groups[1], groups[0])

    def score(self, text: str | None) -> float:
        if self.constant is not None:
            return self.constant
        v = features(self.distance.differences(lowered(text)))
        return float(1 / (1 + np.exp(-np.clip(v @ self.curve[:-1] + self.curve[-1], -30, 30))))


def train(docs: DataFrame, labels: DataFrame, toxic: int = 2000, ordinary: int = 4000, sample_bytes: int = 24 << 20) -> ToxicityModel:
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(doc_crc(F.col("doc_id")) % 5 != 0).groupBy("doc_id").agg(F.max(F.when(F.col("y") > 0, 1).otherwise(0)).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return ToxicityModel([], [], {})
    bound = {1: toxic, 0: ordinary}
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 40))
    limit = {v: int(min(1.0, bound[v] / n) * (1 << 40)) for v, n in counts.items()}
    chosen = known.withColumn("draw", draw).where(
        F.col("draw") <= F.when(F.col("y") == 1, limit.get(1, 0)).otherwise(limit.get(0, 0))
    ).orderBy("draw", "doc_id").limit(toxic + ordinary)
    # At most toxic + ordinary ids: a proven bound for the broadcast.
    texts = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("draw", "doc_id", "y").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    one = one.select("draw", "doc_id", "y", F.octet_length("text").alias("bytes"), "text")
    sample = written(one, "toxicity-sample")
    budget, last = {0: sample_bytes * 2 // 3, 1: sample_bytes // 3}, {0: -1, 1: -1}
    for row in sample.select("draw", "y", "bytes").orderBy("draw", "doc_id").collect():
        if budget[row["y"]] > 0:
            budget[row["y"]] -= row["bytes"]
            last[row["y"]] = row["draw"]
    within = F.col("draw") <= F.when(F.col("y") == 1, last[1]).otherwise(last[0])
    got = sample.where(within).orderBy("draw", "doc_id").select("text", "y").collect()
    return ToxicityModel([lowered(r["text"]) for r in got], [r["y"] for r in got], counts)


def scored(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` and score for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    taken = docs.select(*keep, F.col("text").alias("_text_in"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = shared.value
        for batch in batches:
            scores = [judge.score(t.as_py()) for t in batch.column("_text_in")]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], pa.array(scores, pa.float64())], [*keep, "score"])

    return taken.mapInArrow(task, taken.drop("_text_in").schema.add("score", "double"))


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``."""
    found = scored(docs, train(docs, labels))
    held = F.coalesce(doc_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
