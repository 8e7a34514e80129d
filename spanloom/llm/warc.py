"""WARC archives with a Zstandard dictionary per archive.

Pages are shuffled once by payload digest next to their decision (response or
revisit). Every task then writes one archive: it trains a dictionary on its
first records, embeds it in a leading skippable frame, and compresses each
record as a frame of its own, so a record can be read at its offset
(``read_at``); a file of the archive's name and ``.idx`` lists the pages' ids and
offsets. An archive begins with a warcinfo record. A file
gets its final name only when it is complete; the written manifest lists the
files of the attempts that succeeded, so a lost executor or a repeated task
leaves nothing behind that a reader would see.

Reading decompresses every frame with the embedded dictionary, parses the
record, and checks each response's payload against its recorded digest.

Defined results
* null html: an empty payload. Null url: no target URI.
* payloads under 100 bytes: always a response.
* null page_id: written and read back as null; it never is the smallest id,
  unless all pages with that payload have none (then all are responses).
* rows that share the smallest page_id of a payload are all responses.
* very long payloads: one frame each; frames are read in steps.
* repeated rows: a record each, with an id of its own.
* empty table: no archive and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import chain

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

LEAST_REVISIT = 100
#: Fixed magic number of the skippable frame that holds the dictionary.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SAMPLE_BYTES = 1 << 21
DICTIONARY_BYTES = 1 << 16
LEVEL = 3
_READ = 1 << 20
FIELDS = ("page_id", "url", "payload", "digest", "refers_to", "row", "first_row")


def decided(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for a response), row (a
    number of its own), first_row (that of the response)."""
    page_id, row = F.col("page_id").cast("long").alias("page_id"), F.monotonically_increasing_id().alias("row")
    payload = F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    rows = pages.select(page_id, "url", payload, row).select("*", F.sha2("payload", 256).alias("digest"))
    large = F.octet_length("payload") >= LEAST_REVISIT
    first = (
        pages.select(page_id, payload, row).where(large).groupBy(F.sha2("payload", 256).alias("digest"))
        .agg(F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "row"))).alias("first"), F.count("*").alias("n"))
        .where("n > 1 and first is not null").select("digest", "first")
    )
    joined = rows.join(first.hint("shuffle_hash"), "digest", "left")
    again = large & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    of_first = lambda field: F.when(again, F.col(f"first.{field}"))
    return joined.select("page_id", "url", "payload", "digest", of_first("page_id").alias("refers_to"), "row", of_first("row").alias("first_row"))


# --------------------------------------------------------------------- records
def info(name: str, date: str) -> bytes:
    """The warcinfo record of an archive."""
    block = f"software: spanloom\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
    lines = [
        "WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}",
        f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(
    page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str,
    row: int = 0, first_row: int = 0,
) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, which has the length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_page_uri(page_id, row)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_page_uri(refers_to, first_row)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _page_uri(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}:{row}>"


def _page_of(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+):\d+>", uri or "")
    return int(found[1]) if found else None


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None] | None:
    """page_id, payload_bytes, payload_digest, record_type, refers_to; None for
    a warcinfo record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Type"] == "warcinfo":
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return _page_of(fields["WARC-Record-ID"]), length, digest, kind, _page_of(fields.get("WARC-Refers-To"))


# -------------------------------------------------------------------- archives
def build_dictionary(sample: list[bytes]) -> bytes:
    """A trained dictionary; where the sample is too small to train one, the
    sample itself serves as content."""
    total = sum(map(len, sample))
    try:
        return zstandard.train_dictionary(
            min(DICTIONARY_BYTES, max(1024, total // 8)), [x[:65536] for x in sample], k=256, d=8
        ).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[-DICTIONARY_BYTES:] or b"WARC/1.1"


def _dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_AUTO)


def write_archive(records: Iterator[bytes], out, places: list[int] | None = None) -> int:
    """Writes the dictionary frame and a frame for each record; returns the
    count. ``places`` gets each frame's offset."""
    sample, size = [], 0
    for raw in records:
        sample.append(raw)
        size += len(raw)
        if size >= SAMPLE_BYTES:
            break
    raw_dictionary = build_dictionary(sample)
    out.write(struct.pack("<II", DICTIONARY_MAGIC, len(raw_dictionary)) + raw_dictionary)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(raw_dictionary), write_checksum=True).compress
    n, place = 0, 8 + len(raw_dictionary)
    for part in (sample, records):
        for raw in part:
            if places is not None:
                places.append(place)
            place += out.write(pack(raw))
            n += 1
    return n


def read_archive(source) -> Iterator[bytes]:
    """The records of an archive, one frame at a time."""
    magic, length = struct.unpack("<II", source.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("no dictionary frame")
    opener = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(length)))
    data = source.read(_READ)
    while data:
        frame, parts = opener.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or source.read(_READ)
                break
            data = source.read(_READ)
            if not data:
                raise ValueError("cut-off frame")
        yield b"".join(parts)


def read_at(source, offset: int) -> bytes:
    """The record of the frame at ``offset`` of a seekable archive."""
    source.seek(0)
    _, length = struct.unpack("<II", source.read(8))
    frame = zstandard.ZstdDecompressor(dict_data=_dictionary(source.read(length))).decompressobj()
    source.seek(offset)
    parts = []
    while not frame.eof:
        data = source.read(_READ)
        if not data:
            raise ValueError("cut-off frame")
        parts.append(frame.decompress(data))
    return b"".join(parts)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` as archives below ``folder`` (a URI that executors can
    reach); returns the manifest: archive, n_records."""
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, places = [], []

        def records() -> Iterator[bytes]:
            for batch in batches:
                page, url, payload, digest, refers_to, row, first_row = (batch.column(c) for c in FIELDS)
                for x in zip(page, url, payload, digest, refers_to, row, first_row):
                    page_id, *rest, row_number, first_number = (v.as_py() for v in x)
                    ids.append(page_id)
                    yield record(page_id, *rest, date, row_number, first_number)

        rest = records()
        first = next(rest, None)
        if first is None:
            return
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        name = f"pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
        with fs.open_output_stream(f"{base}/.{name}") as out:
            n = write_archive(chain([info(name, date), first], rest), out, places) - 1
        with fs.open_output_stream(f"{base}/{name}.idx") as out:
            out.write("".join(f"{'' if i is None else i} {at}\n" for i, at in zip(ids, places[1:])).encode())
        fs.move(f"{base}/.{name}", f"{base}/{name}")
        yield pa.RecordBatch.from_pydict({"archive": [f"{folder}/{name}"], "n_records": [n]})

    return written(decided(pages).mapInArrow(task, "archive string, n_records long"), "warc-manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record in the archives of ``manifest``."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column("archive"):
                fs, path = pafs.FileSystem.from_uri(uri.as_py())
                with fs.open_input_stream(path) as source:
                    rows = []
                    for raw in read_archive(source):
                        row = parse(raw)
                        if row is not None:
                            rows.append(row)
                        if len(rows) == 4096:
                            yield _batch(rows, names, types)
                            rows = []
                    yield _batch(rows, names, types)

    files = max(1, manifest.count())
    return manifest.select("archive").coalesce(1).repartition(files).mapInArrow(task, schema)


def dangling_revisits(read: DataFrame) -> DataFrame:
    """refers_to and payload_digest of the revisits in ``read`` whose response
    isn't there with that digest."""
    asked = read.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_digest").distinct()
    return asked.join(read.where("record_type = 'response'"), ["page_id", "payload_digest"], "left_anti")


def _batch(rows: list[tuple], names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def warc_report(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes all pages, then reads the archives back: one row for each page."""
    return read_archives(write_archives(pages, scratch_path(spark, "warc")))
