"""Quality rules as a bitmask ledger.

Every text is measured once and every rule is evaluated once; the ledger keeps
the measurements and one failure bit for each rule. A policy is a versioned set
of rules, that is, a mask: applying it, comparing versions and dropping single
rules are bit operations on the ledger, which never read a text again.

Defined results
* null or empty text: all measurements are zero; it fails ``few_words``.
* very long texts: measured whole. Ties: none.
* letters and capitals are the Unicode categories L and Lu.
* null doc_id and repeated rows: a ledger row each.
* empty table: an empty ledger. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from unicodedata import category

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_lines", "n_upper", "n_letters", "n_distinct",
)


def measure(text: str | None) -> tuple[int, ...]:
    """The MEASURES of a whole text."""
    if not text:
        return (0,) * len(MEASURES)
    words = text.encode("utf-8", "replace").split()
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    seen, lines, duplicates = set(), 0, 0
    for line in text.split("\n"):
        if line.strip(SPACES):
            lines += 1
            if line in seen:
                duplicates += 1
            seen.add(line)
    upper = sum(text.count(c) for c in set(text) if c.isupper() and category(c) == "Lu")
    letters = sum(map(str.isalpha, text))
    return len(words), chars, symbols, duplicates, repeated_words(words), lines, upper, letters, len(set(words))


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered, end = 0, 0
    for i, window in enumerate(windows):
        if window in often:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def _rules() -> dict[str, Column]:
    c = F.col
    return {
        "few_words": c("n_words") < 50,
        "repeated_phrases": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 100 * c("n_symbols") > 25 * c("n_words"),
        "duplicate_lines": 100 * c("n_dup_lines") > 50 * c("n_lines"),
        "shouting": 100 * c("n_upper") > 50 * c("n_letters"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 25 * c("n_words")),
        "few_letters": 100 * c("n_letters") < 30 * c("word_chars"),
        "one_word_again": 100 * c("n_distinct") < 5 * c("n_words"),
    }


RULES = tuple(
    "few_words repeated_phrases symbols duplicate_lines shouting word_length few_letters one_word_again".split()
)
#: Policies by version: the rules that reject a document.
POLICIES = {
    "base": ("few_words", "repeated_phrases"),
    "v1": RULES[:6],
    "v2": RULES,
}


def mask_of(rules: tuple[str, ...]) -> int:
    return sum(1 << RULES.index(r) for r in rules)


def _measure_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = list(zip(*(measure(t.as_py()) for t in batch.column("text")))) or [()] * len(MEASURES)
        arrays = [batch.column(i) for i in range(batch.num_columns - 1)]
        arrays += [pa.array(c, pa.int64()) for c in columns]
        yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names[:-1], *MEASURES])


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, the MEASURES, and fail_bits (bit i: RULES[i] failed)."""
    taken = docs.select(*keep, "text")
    schema = taken.drop("text").schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    rules = _rules()
    bits = F.lit(0).cast("long")
    for i, name in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(rules[name], F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return taken.mapInArrow(_measure_batches, schema).withColumn("fail_bits", bits)


def passes(policy: str) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long")) == 0


def ablations(ledger_rows: DataFrame, policy: str) -> DataFrame:
    """Rows rejected by ``policy`` as a whole, by each rule at all and by each
    rule alone: one aggregation of the distinct masks' counts."""
    mask = mask_of(POLICIES[policy])
    masked = ledger_rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).count()
    rule = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(1 << RULES.index(r)).cast("long").alias("bit")) for r in POLICIES[policy]
    ])).alias("r")
    return masked.select("bits", "count", rule).groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("count")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("count")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits") != 0, F.col("count")).otherwise(0)).alias("n_rejected"),
    )


def alone(policy: str) -> Column:
    """The rule without which ``policy`` would keep a row that it rejects; null
    if there is none or more than one."""
    failed = F.col("fail_bits").bitwiseAND(F.lit(mask_of(POLICIES[policy])).cast("long"))
    out = F.lit(None).cast("string")
    for i, name in enumerate(RULES):
        out = F.when(failed == 1 << i, F.lit(name)).otherwise(out)
    return out


def quality_report(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """doc_id, the five base measurements, base_failed, kept, fail_bits; sole_rule
    (the one rule that rejects the row under ``policy``) and n_sole (how many
    rows of the corpus dropping that rule would bring back, an ablation)."""
    rows = written(ledger(docs), "ledger")
    effect = ablations(rows, policy).select(F.col("rule").alias("sole_rule"), F.col("n_only_this").alias("n_sole"))
    report = rows.select(
        "doc_id", *MEASURES[:5], (~passes("base")).alias("base_failed"),
        (passes("base") & passes(policy)).alias("kept"), "fail_bits", alone(policy).alias("sole_rule"),
    )
    # One row a rule.
    return report.join(F.broadcast(effect), "sole_rule", "left")
