"""Token ids in fixed-width bit-packed files.

Documents are range-partitioned and sorted by doc_id; each task encodes its
texts and writes one file, in which an id takes the fewest bits that hold the
vocabulary. Ids stand in blocks of BLOCK ids, each at a recorded byte offset,
and numpy unpacks whole blocks, so any range of ids can be read on its own.

File layout (little-endian): magic; bits (u8); block length (u32); blocks; then
the index: doc ids (i64), a flag byte for each null id, id offsets (u64, one
more than documents), block offsets (u64); last the three counts (u64:
documents, blocks, index start) and the magic again. Ids are packed from the
lowest bit up.

A file gets its final name when it is complete, and the written manifest lists
only files of attempts that succeeded.

Defined results
* null text: as the empty text, which has just the end id.
* null doc_id: such rows come first; equal ids are ordered by a hash of the
  text. Repeated rows are written each time, in any order among them, and may
  stand in several files.
* very long texts: encoded whole. Ties: rows of equal id and text only.
* empty table: no file and an empty result. Further columns are ignored.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, written

MAGIC = b"SPLMIDS1"
BLOCK = 8192
END_ID = 1
#: Bytes of words and ids of one generation that a worker keeps; a word counts
#: WORD_BYTES besides.
CACHED_BYTES, WORD_BYTES = 64 << 20, 160
_ENCODERS: dict[str, "WordEncoder"] = {}


# ------------------------------------------------------------------- encoding
class WordEncoder(dict):
    """Whole-text encoding through words: a mapping from a word (UTF-8 without
    ASCII white space) to its ids, little-endian unsigned 32-bit integers.

    The tokenizer's pre-tokens never cross ASCII white space, so a text's ids
    are its words' ids in order. A word of lower-case Latin letters is one
    pre-token that no normalizer changes, and goes to the tokenizer's model in
    its byte alphabet; any other word goes through the whole tokenizer. Two
    generations of words are kept, so memory stays bounded.
    """

    PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")

    def __init__(self, path: str, kept: int = CACHED_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        self.kept, self.size_now, self.before = kept, 0, {}
        # Each Latin-1 letter's two bytes in the model's byte alphabet.
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100)}
        self.marks = {m: self._whole(m) for m in (b".", b",")}

    def _whole(self, word: bytes) -> bytes:
        found = self.tokenizer.encode(word.decode("utf-8"), add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: bytes) -> bytes:
        ids = self.before.get(word)
        if ids is None:
            if self.PLAIN.fullmatch(word):
                text = word.decode("utf-8")
                if len(text) < len(word):
                    text = text.translate(self.letters)
                found = [t.id for t in self.tokenizer.model.tokenize(text)]
                ids = struct.pack(f"<{len(found)}I", *found)
            elif word[-1:] in self.marks and self.PLAIN.fullmatch(word, 0, len(word) - 1):
                # Letters before one mark: the mark is a pre-token of its own.
                ids = self[word[:-1]] + self.marks[word[-1:]]
            else:
                ids = self._whole(word)
        self[word] = ids
        self.size_now += len(word) + len(ids) + WORD_BYTES
        return ids

    def encode(self, data: bytes) -> bytes:
        """The ids of a UTF-8 text."""
        # The tokenizer lower-cases; special tokens are matched before that.
        words = data.split() if b"<|" in data else data.lower().split()
        out = b"".join(map(self.__getitem__, words))
        if self.size_now > self.kept:
            # Longer than that in one text: nothing is worth keeping.
            self.before = dict(self) if self.size_now < 2 * self.kept else {}
            self.size_now = 0
            self.clear()
        return out


def encoder(path: str) -> WordEncoder:
    """One encoder for each worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


# -------------------------------------------------------------------- packing
def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    raw = ids.astype("<u4")
    if bits % 8 == 0:
        return raw.view(np.uint8).reshape(-1, 4)[:, : bits // 8].tobytes()
    planes = np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(planes.reshape(-1), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits % 8 == 0:
        out = np.zeros((count, 4), np.uint8)
        out[:, : bits // 8] = np.frombuffer(data, np.uint8, count * bits // 8).reshape(count, -1)
        return out.view("<u4").reshape(-1)
    planes = np.zeros((count, 32), np.uint8)
    planes[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: count * bits].reshape(count, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").reshape(-1)


class PackedWriter:
    """Writes one file; holds at most a block of ids and the index."""

    def __init__(self, out, bits: int):
        self.out, self.bits, self.buffer, self.held = out, bits, [], 0
        self.doc_ids, self.ends, self.block_at = [], [0], []
        self.place = out.write(MAGIC + struct.pack("<BI", bits, BLOCK))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.ends.append(self.ends[-1] + len(ids))
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK:
            every = np.concatenate(self.buffer)
            whole = len(every) // BLOCK * BLOCK
            for at in range(0, whole, BLOCK):
                self._block(every[at : at + BLOCK])
            self.buffer, self.held = [every[whole:]], len(every) - whole

    def _block(self, ids: np.ndarray) -> None:
        self.block_at.append(self.place)
        self.place += self.out.write(pack(ids, self.bits))

    def close(self) -> int:
        """Writes the last block and the index; returns the number of ids."""
        if self.held:
            self._block(np.concatenate(self.buffer))
        nulls = np.array([d is None for d in self.doc_ids], np.uint8)
        ids = np.array([0 if d is None else d for d in self.doc_ids], "<i8")
        index = ids.tobytes() + nulls.tobytes() + np.array(self.ends, "<u8").tobytes() + np.array(self.block_at, "<u8").tobytes()
        self.out.write(index + struct.pack("<QQQ", len(ids), len(self.block_at), self.place) + MAGIC)
        return self.ends[-1]


class PackedReader:
    """Random access to the ids of one file (a seekable source and its size)."""

    def __init__(self, source, size: int):
        self.source = source
        head, tail = self._at(0, 13), self._at(size - 32, 32)
        if head[:8] != MAGIC or tail[24:] != MAGIC:
            raise ValueError("not a packed id file")
        self.bits, self.block = struct.unpack("<BI", head[8:])
        n, blocks, start = struct.unpack("<QQQ", tail[:24])
        index = self._at(start, size - 32 - start)
        self.data_end = start
        ids, nulls = np.frombuffer(index, "<i8", n), np.frombuffer(index, np.uint8, n, n * 8)
        self.doc_ids = [None if gone else int(d) for d, gone in zip(ids, nulls)]
        self.offsets = np.frombuffer(index, "<u8", n + 1, n * 9).astype(np.int64)
        self.block_at = np.frombuffer(index, "<u8", blocks, n * 9 + (n + 1) * 8).astype(np.int64)

    def _at(self, place: int, length: int) -> bytes:
        self.source.seek(place)
        return self.source.read(length)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file."""
        if stop <= start:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        begin = int(self.block_at[first])
        end = int(self.block_at[last + 1]) if last + 1 < len(self.block_at) else self.data_end
        count = min((last + 1) * self.block, int(self.offsets[-1])) - first * self.block
        if self.block * self.bits % 8:
            raise ValueError("blocks must be whole bytes")
        return unpack(self._at(begin, end - begin), count, self.bits)[start - first * self.block : stop - first * self.block]

    def documents(self, at_once: int = 1 << 20) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids) in order, some ``at_once`` ids a read."""
        n, i = len(self.doc_ids), 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + at_once, "right")) - 1)
            j = min(j, n)
            base = int(self.offsets[i])
            part = self.ids(base, int(self.offsets[j]))
            for k in range(i, j):
                yield self.doc_ids[k], int(self.offsets[k]), part[self.offsets[k] - base : self.offsets[k + 1] - base]
            i = j


# ----------------------------------------------------------------- Spark plans
def write_packed(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> DataFrame:
    """Writes all ids below ``folder``; returns the manifest: part (files in
    ascending doc_id order), file, n_ids, n_docs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, writer, out = encoder(path), None, None
        part = TaskContext.get().partitionId()
        name = f"ids-{part:06d}-{uuid.uuid4().hex}.bin"
        fs, base = pafs.FileSystem.from_uri(folder)
        end = np.array([end_id], "<u4")
        for batch in batches:
            if writer is None and batch.num_rows:
                fs.create_dir(base, recursive=True)
                out = fs.open_output_stream(f"{base}/.{name}")
                writer = PackedWriter(out, width_of(max(words.size, end_id + 1)))
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.frombuffer(words.encode(text.as_py()), "<u4")
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            n_ids = writer.close()
            out.close()
            fs.move(f"{base}/.{name}", f"{base}/{name}")
            row = {"part": [part], "file": [f"{folder}/{name}"], "n_ids": [n_ids], "n_docs": [len(writer.doc_ids)]}
            yield pa.RecordBatch.from_pydict(row)

    text = F.coalesce("text", F.lit("")).cast("binary")
    taken = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # The row's number deals out rows that repeat an id and its text.
    taken = taken.select("*", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("hash"), F.col("row")]
    ranged = taken.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.mapInArrow(task, "part long, file string, n_ids long, n_docs long"), "packed-manifest")


def read_packed(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 for each document of the files."""
    spark = manifest.sparkSession
    # One row a file; a file is a whole partition of documents.
    files, base = [], 0
    for row in manifest.orderBy("part").collect():
        files.append((row["file"], base))
        base += row["n_ids"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                fs, path = pafs.FileSystem.from_uri(uri)
                with fs.open_input_file(path) as source:
                    rows = []
                    for doc_id, place, ids in PackedReader(source, source.size()).documents():
                        rows.append((doc_id, start + place, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    columns = list(zip(*rows)) or [()] * 4
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    listed = spark.createDataFrame(files, "file string, base long").coalesce(1).repartition(max(1, len(files)))
    return listed.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def packed_report(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes every document's ids and reads the files back."""
    path = path or public_tokenizers.path("word_bpe_49k.json")
    return read_packed(write_packed(docs, scratch_path(spark, "ids"), path))
