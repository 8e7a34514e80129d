"""Secret scans with corpus-wide ownership frequency, in DataFrame functions.

Each text is scanned once for three base kinds and for generic key-like tokens.
The hash of every found value is counted over distinct repositories and owners
of the whole corpus: a value that many owners hold is a widely copied example;
a live-looking value of few owners is reported. Base spans always stay; the
method adds generic spans that look live and are owner-specific.

Owners and repositories of a value are counted apart, each through distinct
pairs, so a hot value is never gathered in one task. The join of occurrences
with their counts has one row per value on its right side, so a hot value's left
side can be split.

Places of matches, and the removal of generic spans that overlap base ones, are
running values over arrays, kept in blocks (``running``), so a text's cost is in
proportion to its length and its number of matches.

Defined results
* null text: as the empty text; null owner or repository: not counted, and a
  value without any owner counts as owned by none (specific).
* very long texts: scanned whole; a text with a million matches is one row.
* ties (spans of one start): in the order of the kinds; then the shorter first.
* repeated rows: one output row each; they add no owner and no repository.
* empty table: an empty result. Further columns of the input are ignored.
* the digest of a text without base spans is that of the empty string.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_names, text_hash, written

#: Fixed patterns of the base kinds, in listed order, and the least length.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_VALUE = 6
#: Generic candidates: long tokens of mixed classes.
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
PATTERNS = (ASSIGN, ACCESS, HEX, GENERIC)
KINDS = ("assign", "access", "hex", "generic")
MASK = "[REDACTED]"
#: Start, kind number and end (code points), start and end in bytes, hashed value.
_SPANS = "array<struct<s:int,k:int,e:int,b:int,t:int,v:string>>"
#: Rows with spans and spans, together, that are broadcast (some 100 bytes each).
MARKED = 500_000
#: Elements whose running values are appended one by one.
_BLOCK = 128


def running(n: Column, zero: Column, step: Callable, emit: Callable, kind: str) -> Column:
    """emit(state before i, i) for i from 0 to n - 1, where step(state, i) gives
    the next state. ``kind`` is the SQL type of what emit returns. Arrays grow
    by copying, so elements are appended in blocks and blocks to a list."""
    none = F.array().cast(f"array<{kind}>")
    first = F.struct(zero.alias("at"), none.alias("out"))

    def block(before: Column, number: Column) -> Column:
        state = F.coalesce(F.get(before, F.size(before) - 1).getField("at"), zero)
        last = F.least(n, (number + 1) * _BLOCK) - 1
        return F.aggregate(
            F.sequence(number * _BLOCK, last), F.struct(state.alias("at"), none.alias("out")),
            lambda a, i: F.struct(step(a.at, i).alias("at"), F.concat(a.out, F.array(emit(a.at, i))).alias("out")),
        )

    blocks = F.aggregate(
        F.sequence(F.lit(0), F.floor((n - 1) / _BLOCK).cast("int")), F.slice(F.array(first), 1, 0),
        lambda a, number: F.concat(a, F.array(block(a, number))),
    )
    return F.when(n > 0, F.flatten(F.transform(blocks, lambda x: x.out))).otherwise(none)


def _located(hits: Column, pieces: Column, kind: int) -> Column:
    """Spans of matches from the matches and the pieces between them; the value
    is the match itself."""
    place = lambda chars, octets: F.struct(chars.alias("c"), octets.alias("o"))
    size = lambda f, i: (f(F.get(pieces, i)), f(F.get(hits, i)))

    def step(at: Column, i: Column) -> Column:
        (p, h), (bp, bh) = size(F.length, i), size(F.octet_length, i)
        return place(at.c + p + h, at.o + bp + bh)

    def emit(at: Column, i: Column) -> Column:
        (p, h), (bp, bh) = size(F.length, i), size(F.octet_length, i)
        return F.struct(
            (at.c + p).alias("s"), F.lit(kind).alias("k"), (at.c + p + h).alias("e"),
            (at.o + bp).alias("b"), (at.o + bp + bh).alias("t"), F.get(hits, i).alias("v"),
        )

    return running(F.size(hits), place(F.lit(0), F.lit(0)), step, emit, _SPANS[6:-1])


def _apart(base: Column, extra: Column) -> Column:
    """The spans of ``extra`` that overlap none of ``base``; both are sorted.

    In the order of starts, a span overlaps an earlier base span if the largest
    base end so far is past its start, and a later one if the next base start
    (the running smallest, seen from behind) is before its end.
    """
    pair = F.array_sort(F.concat(
        F.transform(base, lambda x: F.struct(x.s.alias("s"), F.lit(0).alias("g"), x.e.alias("e"), F.lit(-1).alias("i"))),
        F.transform(extra, lambda x, i: F.struct(x.s.alias("s"), F.lit(1).alias("g"), x.e.alias("e"), i.alias("i"))),
    ))

    def free(both: Column) -> Column:
        every, back = both.getField("on"), both.getField("back")
        is_base = lambda x: x.getField("g") == 0
        reached = running(
            F.size(every), F.lit(0),
            lambda at, i: F.when(is_base(F.get(every, i)), F.greatest(at, F.get(every, i).e)).otherwise(at),
            lambda at, i: at, "int",
        )
        coming = F.reverse(running(
            F.size(every), F.lit(2**31 - 1),
            lambda at, i: F.when(is_base(F.get(back, i)), F.get(back, i).s).otherwise(at),
            lambda at, i: at, "int",
        ))
        facts = F.arrays_zip(every.alias("x"), reached.alias("r"), coming.alias("n"))
        kept = F.filter(facts, lambda f: ~is_base(f.x) & (f.r <= f.x.s) & (f.n >= f.x.e))
        return F.transform(kept, lambda f: F.get(extra, f.x.i))

    # One element, so that the sorted arrays are made once and bound to a name.
    both = F.struct(pair.alias("on"), F.reverse(pair).alias("back"))
    some = F.get(F.transform(F.array(both), free), F.lit(0))
    return F.when((F.size(base) > 0) & (F.size(extra) > 0), some).otherwise(extra)


def scanned(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """``keep`` plus base (spans of the three kinds) and extra (generic spans
    apart from base ones)."""
    df = docs.select(*[c.alias(n) for n, c in keep.items()], F.coalesce("text", F.lit("")).alias("_text"))
    df = df.select("*", *[F.regexp_extract_all("_text", F.lit(p), F.lit(0)).alias(f"_h{k}") for k, p in enumerate(PATTERNS)])
    none = F.array().cast("array<string>")
    df = df.select(*keep, *[f"_h{k}" for k in range(len(PATTERNS))], *[
        F.when(F.size(f"_h{k}") > 0, F.split("_text", p, -1)).otherwise(none).alias(f"_p{k}")
        for k, p in enumerate(PATTERNS)
    ])
    df = df.select(*keep, *[_located(F.col(f"_h{k}"), F.col(f"_p{k}"), k).alias(f"_s{k}") for k in range(len(PATTERNS))])
    value = lambda v: F.regexp_extract(v, ASSIGN, 2)
    whole = lambda x, v: F.struct(*[x.getField(f).alias(f) for f in "skebt"], F.sha2(v.cast("binary"), 256).alias("v"))
    assign = F.transform(F.filter("_s0", lambda x: F.length(value(x.v)) >= ASSIGN_VALUE), lambda x: whole(x, value(x.v)))
    hashed = lambda name: F.transform(name, lambda x: whole(x, x.v))
    mixed = lambda v: (
        v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]") & (F.size(F.array_distinct(F.split(v, ""))) >= 12)
    )
    df = df.select(
        *keep, F.array_sort(F.concat(assign, hashed("_s1"), hashed("_s2"))).alias("base"),
        F.transform(F.filter("_s3", lambda x: mixed(x.v)), lambda x: whole(x, x.v)).alias("_mixed"),
    )
    return df.select(*keep, "base", _apart(F.col("base"), F.col("_mixed")).alias("extra"))


def ownership(found: DataFrame) -> DataFrame:
    """v, n_owners, n_repos for each value hash of ``found`` (v, owner, repo):
    distinct non-null owners, and distinct non-null repositories."""
    of = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("name"))
    holders = found.select("v", F.explode(F.array(of(0, "owner"), of(1, "repo"))).alias("h")).distinct()
    held = lambda kind: F.count(F.when(F.col("h.kind") == kind, F.col("h.name")))
    return holders.groupBy("v").agg(held(0).alias("n_owners"), held(1).alias("n_repos"))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name(x.k), x.s, x.e)), ",")


def scan(
    docs: DataFrame,
    owner: str = "source",
    repo: str = "source",
    max_owners: int = 2,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keep``, base, spans (arrays), n_copied and n_live for each row.

    ``owner`` and ``repo`` name the columns that hold a row's owner and
    repository. A value of at most ``max_owners`` owners and repositories is
    owner-specific.
    """
    columns = {f"_k{i}": F.col(c) for i, c in enumerate(keep)}
    columns |= {"owner": F.col(owner).cast("string"), "repo": F.col(repo).cast("string")}
    rows = scanned(docs, columns)
    # The written table fixes the row numbers and is all that later steps read.
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()), "secret-spans")
    every = rows.where((F.size("base") > 0) | (F.size("extra") > 0)).select(
        "rid", "owner", "repo", F.explode(F.concat("base", "extra")).alias("span")
    ).select("rid", "owner", "repo", "span", F.col("span.v").alias("v"))
    counted = ownership(every)
    specific = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_owners)
    judged = every.join(counted, "v").select("rid", "span", specific.alias("specific"))
    is_extra = F.col("span.k") == KINDS.index("generic")
    by_row = judged.groupBy("rid").agg(
        F.collect_list(F.when(is_extra & F.col("specific"), F.col("span"))).alias("added"),
        F.count_if(F.col("specific")).alias("n_live"),
        F.count_if(~F.col("specific")).alias("n_copied"),
    )
    added = F.coalesce("added", F.array().cast(_SPANS))
    out = rows.join(by_row, "rid", "left").withColumn("spans", F.array_sort(F.concat("base", added)))
    return out.select(
        *[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "base", "spans",
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied."""
    found = scan(docs)
    count = lambda k: F.size(F.filter("base", lambda x: x.k == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), "n_live", "n_copied",
    )


def masked(text: Column, spans: Column) -> Column:
    """``text`` with each maximal run of overlapping spans (sorted) replaced by
    MASK. Cuts are made in bytes, where each costs only its own length."""
    cuts = running(
        F.size(spans), F.lit(0),
        lambda at, i: F.greatest(at, F.get(spans, i).t),
        lambda at, i: F.struct(at.alias("a"), F.get(spans, i).b.alias("b")), "struct<a:int,b:int>",
    )
    end = F.array_max(F.transform(spans, lambda x: x.t))

    def rebuilt(data: Column) -> Column:
        # A span that starts inside the run so far makes no cut.
        kept = F.filter(cuts, lambda x: x.b >= x.a)
        parts = F.transform(kept, lambda x: F.substring(data, x.a + 1, x.b - x.a).cast("string"))
        return F.array_join(F.concat(parts, F.array(F.substring(data, end + 1, F.octet_length(data)).cast("string"))), MASK)

    # One element, so that the bytes are made once and bound to a name.
    return F.when(F.size(spans) > 0, F.get(F.transform(F.array(text.cast("binary")), rebuilt), F.lit(0))).otherwise(text)


def masked_documents(docs: DataFrame, owner: str = "source", repo: str | None = None) -> DataFrame:
    """``docs`` with every reported span masked in text, and n_chars to match.
    All rows and columns stay; a row without a span is unchanged.

    Only rows with a span are looked up: by a broadcast of their keys and spans
    where those are few enough, else by a shuffle of the rows in which a pattern
    occurs. All other rows pass straight through.
    """
    hashed = free_names(docs, "hash")[0]
    key = docs.select("doc_id", *dict.fromkeys((owner, repo or owner)), "text", text_hash(F.col("text")).alias(hashed))
    found = scan(key, owner, repo or owner, keep=("doc_id", hashed)).where(F.size("spans") > 0)
    # Rows that repeat an id and a text have equal base spans; all of them get
    # what any of them reports.
    marks = found.groupBy(F.col("doc_id").alias("id"), F.col(hashed).alias("h")).agg(
        F.array_sort(F.flatten(F.collect_set("spans"))).alias("spans")
    )
    marks = written(marks, "secret-marks")
    size = marks.agg(F.count("*"), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    mine, mark_id, mark_hash, spans, new = free_names(docs, "mine", "mark_id", "mark_hash", "spans", "new")
    marks = marks.toDF(mark_id, mark_hash, spans)
    rows = docs.select("*", F.col("doc_id").alias(mine), text_hash(F.col("text")).alias(hashed))
    rest = None
    if size[0] + size[1] <= MARKED:
        marks = F.broadcast(marks)
    else:
        maybe = F.coalesce(F.col("text").rlike("|".join(PATTERNS)), F.lit(False))
        rows, rest = rows.where(maybe), rows.where(~maybe)
    joined = rows.join(marks, F.col(mine).eqNullSafe(F.col(mark_id)) & (F.col(hashed) == F.col(mark_hash)), "left")
    marked = F.col(spans).isNotNull()
    joined = joined.withColumn(new, F.when(marked, masked(F.col("text"), F.col(spans))))
    replaced = {"text": F.when(marked, F.col(new)).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        n_chars = F.when(marked, F.length(new)).otherwise(F.col("n_chars"))
        replaced["n_chars"] = n_chars.cast(docs.schema["n_chars"].dataType)
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = joined.select(*[replaced[c].alias(c) if c in replaced else column for c, column in zip(docs.columns, own)])
    return out if rest is None else out.unionByName(rest.select(*own))
