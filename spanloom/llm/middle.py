"""Fill-in-the-middle transformation by run-length class encoding.

A text is kept as the maximal runs of code points of one class, the class being
the number of UTF-8 bytes of a code point, each run with the number of units
(code points) and bytes before it. A cut after a number of units is found by a
binary search for its run; its byte is then the run's first byte plus the units
into the run times the class's width. No text is decoded, and a text of one
class has a single run whatever its length.

Defined results
* null or empty text: no units, form ``plain``, an empty output.
* null doc_id: the seed's text ends after its colon.
* a text that holds a mark already: plain, as it couldn't be restored.
* very long texts: whole; the runs are found in slices of SLICE bytes.
* repeated rows and ties: each row is transformed alike, by its doc_id.
* empty table: an empty result. Columns of the input are not passed on but the
  key, so that no name can clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Of a hundred texts so many are transformed, and of these so many start with the suffix.
RATE, SUFFIX_FIRST = 90, 20
SLICE = 1 << 22
#: UTF-8 bytes of the code point that starts with a byte; 0 inside one.
WIDTHS = np.zeros(256, np.uint8)
WIDTHS[:0x80], WIDTHS[0xC0:0xE0], WIDTHS[0xE0:0xF0], WIDTHS[0xF0:] = 1, 2, 3, 4


class ClassRuns:
    """The runs of a UTF-8 text: for each its width, and the units and bytes
    before it; ``units`` is the number of code points of the text."""

    def __init__(self, text: bytes):
        widths, units, total = [], [], 0
        for at in range(0, len(text), SLICE):
            of = WIDTHS[np.frombuffer(text, np.uint8, min(SLICE, len(text) - at), at)]
            of = of[of > 0]
            if not len(of):
                continue
            first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            if widths and widths[-1][-1] == of[0]:
                first = first[1:]
            if len(first):
                widths.append(of[first])
                units.append(first + total)
            total += len(of)
        self.units = total
        self.width = np.concatenate(widths).astype(np.int64) if widths else np.zeros(0, np.int64)
        self.units_before = np.concatenate(units).astype(np.int64) if units else np.zeros(0, np.int64)
        lengths = np.diff(np.append(self.units_before, total)) * self.width
        self.bytes_before = np.cumsum(lengths) - lengths

    def byte_of(self, unit: int) -> int:
        """The byte at which a text is cut after ``unit`` units."""
        if unit == 0:
            return 0
        run = int(np.searchsorted(self.units_before, unit, side="left")) - 1
        return int(self.bytes_before[run] + (unit - self.units_before[run]) * self.width[run])


def transform_one(text: bytes, draws: tuple[int, int, int, int]) -> tuple[int, str, int | None, int | None, bytes]:
    """units, form, prefix units, middle units and output of a text."""
    runs = ClassRuns(text)
    if not runs.units or draws[2] % 100 >= RATE or any(mark in text for mark in MARKS.values()):
        return runs.units, "plain", None, None, text
    first, second = sorted((draws[0] % (runs.units + 1), draws[1] % (runs.units + 1)))
    a, b = runs.byte_of(first), runs.byte_of(second)
    prefix, suffix = MARKS["prefix"] + text[:a], MARKS["suffix"] + text[b:]
    middle = MARKS["middle"] + text[a:b]
    if draws[3] % 100 < SUFFIX_FIRST:
        return runs.units, "spm", first, second - first, suffix + prefix + middle
    return runs.units, "psm", first, second - first, prefix + suffix + middle


def transform(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1:") -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row. The cuts
    are drawn from the hash of ``seed`` and the key."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"), digest.alias("seed"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for raw, hashed in zip(batch.column("text"), batch.column("seed")):
                hashed = hashed.as_py()
                draws = tuple(int(hashed[i : i + 8], 16) for i in range(0, 32, 8))
                done.append(transform_one(raw.as_py(), draws))
            n, form, prefix, middle, out = zip(*done) if done else ((),) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()),
                 pa.array(middle, pa.int64()), pa.array(out, pa.binary())],
                names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    out = rows.mapInArrow(task, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from. Each mark stands once in it, since
    texts that hold one stay plain and no mark can begin inside another's end."""
    parts = F.split(output, "<[PSM]>", 4)
    put = lambda *order: F.concat(*[F.get(parts, i) for i in order])
    return F.when(form == "plain", output).when(form == "psm", put(1, 3, 2)).otherwise(put(2, 3, 1))


def middle_report(docs: DataFrame) -> DataFrame:
    """The operator's columns with digests of output and restored text in their
    place."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    out = transform(docs)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


ORACLE = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substring(h, i, 8))::BIGINT) AS v FROM d),
y AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR v[3] % 100 >= 90 THEN 'plain' WHEN v[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
 least(v[1] % (n + 1), v[2] % (n + 1)) AS a, greatest(v[1] % (n + 1), v[2] % (n + 1)) AS b FROM x),
z AS (SELECT *, '<P>' || substring(t, 1, a) AS p, '<S>' || substring(t, b + 1) AS s, '<M>' || substring(t, a + 1, b - a) AS m FROM y)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN p || s || m ELSE s || p || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM z"""
