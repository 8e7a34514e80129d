"""Hierarchical language identification.

A text's hashed character n-grams (one to three letters, whole text) form a
unit vector. A linear support vector machine for each family picks the family
first; inside it, one-versus-one linear machines separate the related
languages by votes, ties by summed margins. Every machine is fitted here.

Training reads a bounded sample: ``total`` labelled texts shared out over all
languages (at least one each), at most ``per_language`` of one, those with the
lowest hashes of id and text. Repeated rows count once. Counts, folds and
predictions cover all rows, and every label is learnt.

Defined results
* null text or one without a letter (``str.isalpha``): ``und`` with score 1.
* null doc_id: held_out is false, and the row is never learnt from.
* no labelled row at all: every text is ``und`` with score 0.
* one learnt language: that language with score 1.
* very long texts: read whole, in blocks of STEP characters.
* ties: of equal votes the larger sum of margins, then the first name, wins.
* repeated rows give repeated results; an empty table an empty result; further
  columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_crc, few

DIMENSIONS = 4096
#: Characters that are hashed at once.
STEP = 1 << 16
#: Language families by ISO 639-1 code; a code that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi".split(),
    "romance": "fr es it pt ro ca gl oc la".split(),
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs".split(),
    "uralic": "fi et hu".split(),
    "baltic": "lt lv".split(),
    "turkic": "tr az kk uz ky tk".split(),
    "indic": "hi bn mr gu pa ur ne".split(),
    "semitic": "ar he am mt".split(),
    "sinitic": "zh yue wuu".split(),
}
_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes}


def family_of(lang: str) -> str:
    return _FAMILY_OF.get(lang.lower().split("-")[0], lang)


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def features(text: str, dims: int = DIMENSIONS) -> np.ndarray:
    """Square roots of hashed n-gram counts (n = 1, 2, 3) at unit length.
    Runs of anything but letters count as one space."""
    low = f" {re.sub(r'[\W\d_]+', ' ', text.lower()).strip()} "
    counts = np.zeros(dims, np.float64)
    for at in range(0, len(low), STEP):
        # The two characters before a block complete the n-grams that end in it.
        begin = max(0, at - 2)
        codes = np.frombuffer(low[begin : at + STEP].encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
        mixed = codes
        for n in (1, 2, 3):
            if n > 1:
                mixed = mixed[:-1] * np.uint64(0x100000001B3) + codes[n - 1 :]
            ends_here = mixed[max(0, at - begin - n + 1) :]
            slot = ((ends_here * np.uint64(0x9E3779B97F4A7C15) + np.uint64(n)) >> np.uint64(40)) % np.uint64(dims)
            counts += np.bincount(slot.astype(np.int64), minlength=dims)
    counts = np.sqrt(counts)
    return (counts / max(np.linalg.norm(counts), 1e-12)).astype(np.float32)


def fit_machine(x: np.ndarray, y: np.ndarray, c: float = 20.0, rounds: int = 120) -> tuple[np.ndarray, float]:
    """A linear machine with squared hinge loss and balanced classes, by
    accelerated gradient steps. ``y`` holds +1 and -1; returns (w, bias)."""
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(np.float32)
    w = np.zeros(x1.shape[1], np.float32)
    ahead, step = w.copy(), np.float32(1.0 / (1.0 + 2 * c * 2.0))
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ ahead)).astype(np.float32)
        gradient = ahead - np.float32(2 * c) * ((weight * slack * y) @ x1)
        new = ahead - step * gradient
        ahead = new + np.float32(k / (k + 3)) * (new - w)
        w = new
    return w[:-1], float(w[-1])


class LanguageModel:
    """Family machines (one against the rest) and pair machines in families."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        names = np.array(langs)
        families = np.array([family_of(v) for v in langs])
        self.families = sorted(set(families))
        self.members = {f: [v for v in self.langs if family_of(v) == f] for f in self.families}
        self.dims = x.shape[1] if len(x) else DIMENSIONS
        self.family_w, self.family_b = self._stack(
            [fit_machine(x, np.where(families == f, 1, -1).astype(np.float32)) for f in self.families]
            if len(self.families) > 1 else []
        )
        self.pairs = {}
        for f, members in self.members.items():
            duos = list(combinations(members, 2))
            fits = []
            for a, b in duos:
                rows = (names == a) | (names == b)
                fits.append(fit_machine(x[rows], np.where(names[rows] == a, 1, -1).astype(np.float32)))
            self.pairs[f] = (duos, *self._stack(fits))

    def _stack(self, fits: list) -> tuple[np.ndarray, np.ndarray]:
        if not fits:
            return np.zeros((0, self.dims), np.float32), np.zeros(0, np.float32)
        return np.vstack([w for w, _ in fits]), np.array([b for _, b in fits], np.float32)

    @staticmethod
    def _chance(margin: np.ndarray | float) -> np.ndarray | float:
        return 1.0 / (1.0 + np.exp(-4.0 * np.clip(margin, -20, 20)))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text):
            return "und", 1.0
        if not self.langs:
            return "und", 0.0
        v = features(text, self.dims)
        family, sure = self.families[0], 1.0
        if len(self.families) > 1:
            p = self._chance(self.family_w @ v + self.family_b)
            best = int(np.argmax(p))
            family, sure = self.families[best], float(p[best])
        duos, w, b = self.pairs[family]
        if not duos:
            return self.members[family][0], sure
        p = self._chance(w @ v + b)
        votes = {m: [0, 0.0, []] for m in self.members[family]}
        for (first, second), q in zip(duos, p.tolist()):
            won = votes[first if q >= 0.5 else second]
            won[0] += 1
            votes[first][1] += q
            votes[second][1] += 1 - q
            votes[first][2].append(q)
            votes[second][2].append(1 - q)
        lang = max(sorted(votes), key=lambda m: (votes[m][0], votes[m][1]))
        return lang, sure * min(votes[lang][2])


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's drawn texts as features, each pair of language and draw once."""
    seen = set()
    for batch in batches:
        out = []
        for draw, text, lang in zip(*(batch.column(c) for c in ("draw", "text", "lang"))):
            key = lang.as_py(), draw.as_py()
            if key not in seen and has_letter(text.as_py()):
                out.append((key[1], features(text.as_py()).astype(np.float16).tobytes(), key[0]))
            seen.add(key)
        columns = list(zip(*out)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.string()))], ["draw", "v", "lang"])


def train(docs: DataFrame, per_language: int = 400, total: int = 4000) -> LanguageModel:
    """Fits on rows with a text, a non-null lang and crc32(doc_id) mod 4 <> 2."""
    rows = docs.select("doc_id", "lang", "text").where("lang is not null and lang <> 'und' and text is not null")
    rows = rows.where(doc_crc(F.col("doc_id")) % 4 != 2)
    drawn = rows.withColumn("draw", F.pmod(F.xxhash64("doc_id", "text", F.lit(17)), F.lit(1 << 40)))
    # One row a language: how many different rows it has, to a few per cent.
    counts = drawn.groupBy("lang").agg(F.approx_count_distinct("draw", 0.02).alias("n")).collect()
    if not counts:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), [])
    share = max(1, min(per_language, total // len(counts)))
    # A hash threshold a little above the share needs no sort of all rows; the
    # lowest hashes among those that pass are the sample.
    ample = share * 1.1 + 6 * share**0.5 + 8
    limits = [(r["lang"], int(min(1.0, ample / r["n"]) * (1 << 40))) for r in counts]
    limits = few(docs.sparkSession.createDataFrame(limits, "lang string, most long"))
    sample = drawn.join(limits, "lang").where("draw <= most").select("lang", "draw", "text")
    rows = sample.mapInArrow(_feature_batches, "draw long, v binary, lang string").dropDuplicates(["lang", "draw"])
    got, taken = [], Counter()
    for row in sorted(rows.collect(), key=lambda r: (r["draw"], r["lang"])):
        taken[row["lang"]] += 1
        if taken[row["lang"]] <= share:
            got.append(row)
    if not got:
        return LanguageModel(np.zeros((0, DIMENSIONS), np.float32), [])
    x = np.frombuffer(b"".join(r["v"] for r in got), np.float16).reshape(-1, DIMENSIONS).astype(np.float32)
    return LanguageModel(x, [r["lang"] for r in got])


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, lang_pred and score for each row."""
    spark: SparkSession = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    taken = docs.select(*keep, F.col("text").alias("_text_in"))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = shared.value
        for batch in batches:
            found = [machine.predict(t.as_py()) for t in batch.column("_text_in")]
            columns = [batch.column(name) for name in keep]
            columns += [pa.array([v for v, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    schema = taken.drop("_text_in").schema.add("lang_pred", "string").add("score", "double")
    return taken.mapInArrow(label, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs``."""
    found = identify(docs, train(docs))
    held = F.coalesce(doc_crc(F.col("doc_id")) % 4 == 2, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.05) -> DataFrame:
    """The rows whose language is found: ``und`` and scores under ``least`` go.
    Only texts go to Python and only verdicts come back."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))

    @F.arrow_udf("boolean")
    def found(texts: pa.Array) -> pa.Array:
        machine = shared.value
        verdicts = (machine.predict(t.as_py()) for t in texts)
        return pa.array([lang != "und" and score >= least for lang, score in verdicts], pa.bool_())

    return docs.where(found(F.col("text")))
