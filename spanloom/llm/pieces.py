"""Subword encoding, decoding and token counts over a public piece model.

Both operators run a Viterbi trellis over the pieces of a model file and give
exactly the library's ids. The file's pieces come from ranked merges, so pieces
have no additive score. What is scored is a path: a step from one piece to the
next costs nothing if it is allowed and rules the path out if it isn't; a
character without a piece, which is spelled as bytes (``<0xNN>``), costs one. A
step is allowed if the two pieces, side by side, would not have merged anywhere
across their border before they were complete (see ``compatible``). The best
path of every prefix is the maximum over the lengths of its last piece.

A text gets one leading blank, and blanks become U+2581. No piece has that mark
after another character and none holds a line feed (both checked at load), so a
text falls into words that are encoded apart: distinct words of a batch once.
Words that start with several blanks go through a heap of merges, since the file
gives all pieces of blanks the same score. A word of more than LONG characters is
first cut at every border that no piece of the file spans; what is still longer
goes through the heap too, so time stays near in proportion to the length.

* ``encode``: batched numpy Viterbi. Words of equal length advance together;
  hashes of their substrings probe the sorted piece keys; the vectorised maximum
  over the piece lengths is kept as a back-pointer.
* ``count``: a trie of the batch's distinct words, level by level. A prefix that
  words share is one node, whose forward score, last piece and number of ids are
  computed once from its ancestors; a word's count is read at its terminal node.
* ``decode``: the ids of a batch index one table of piece bytes.

Defined results
* null or empty text: no ids; it decodes to the empty text.
* null doc_id, repeated rows: a result row each. Further columns are ignored.
* very long texts and words: encoded whole; workers keep no word of more than
  LONG characters from batch to batch.
* ties: none; at most one last piece of a prefix has an allowed step.
* empty table: an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
#: Scores under this are shared by several pieces (runs of blanks).
SHARED_SCORE = -1e8
#: Characters of new words after which a worker's kept words become the older
#: generation, a word counting WORD_CHARS besides; longer ones than LONG are not kept.
CACHED_CHARS, WORD_CHARS = 4 << 20, 32
LONG = 256
#: Rows, and bytes of text if there are several rows, that are worked on at once.
PART_ROWS, PART_BYTES = 2048, 2 << 20
#: Words of one trellis, and ids that are decoded at once.
LANES, DECODED = 1 << 13, 1 << 20
#: A path that no allowed step continues.
IMPOSSIBLE = -(1 << 40)
#: Last pieces: a character without a piece, and the start.
LONE, START = -2, -1
_P = 0x9E3779B97F4A7C15 | 1
_ALL = 0xFFFFFFFFFFFFFFFF
_U = np.uint64
_SALT, _MIX = 0xC2B2AE3D27D4EB4F, np.uint64(0x9E3779B97F4A7C15)
_MODELS: dict[str, "PieceModel"] = {}


class Kept(dict):
    """Values by word, in two generations, so that memory stays bounded."""

    def __init__(self, total):
        super().__init__()
        self.total, self.older, self.chars = total, {}, 0

    def recalled(self, words: set[str]) -> set[str]:
        """Takes words over from the older generation; returns the unknown ones."""
        missing = words - self.keys()
        back = missing & self.older.keys()
        self.update((w, self.older[w]) for w in back)
        self.chars += sum(map(len, missing)) + len(missing) * WORD_CHARS
        return missing - back

    def joined(self, words) -> bytes | int:
        return self.total(map(self.__getitem__, words))

    def age(self) -> None:
        """After a batch: long words go, and a full generation becomes the older."""
        for w in [w for w in self if len(w) > LONG]:
            del self[w]
        if self.chars > CACHED_CHARS:
            self.older, self.chars = dict(self), 0
            self.clear()


class PieceModel:
    """Pieces by rank: single characters first, then merges, best score first."""

    def __init__(self, path: str | None = None, pieces: dict[str, tuple[int, float]] | None = None):
        """From a model file; or, for tests, from pieces: text to (id, score),
        with byte pieces at ids 3 to 258."""
        if pieces is None:
            model = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = {
                model.id_to_piece(i): (i, model.get_score(i))
                for i in range(model.get_piece_size())
                if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))
            }
            self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        else:
            self.byte_ids = list(range(3, 259))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in pieces):
            raise ValueError("a piece crosses a word boundary")
        self.pieces = pieces
        self._table()
        ranked = sorted(
            (p for p, (_, s) in pieces.items() if len(p) == 1 or s > SHARED_SCORE), key=lambda p: (len(p) > 1, -pieces[p][1])
        )
        self.id_of_rank = np.array([pieces[p][0] for p in ranked], np.int64)
        self.singles = sum(len(p) == 1 for p in ranked)
        usable = self._split(ranked)
        self.longest = max(len(ranked[r]) for r in usable)
        keys = np.array([self.key(ranked[r]) for r in usable], np.uint64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(usable, np.int64)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("piece keys collide")
        # Probes compare characters as well: equal hashes are not yet equal pieces.
        self.codes = np.zeros((len(usable), self.longest), np.uint32)
        for row, r in zip(self.codes, self.ranks.tolist()):
            row[: len(ranked[r])] = [ord(c) for c in ranked[r]]
        # By length, longest first, as the columns of a trellis step.
        lengths = range(self.longest, 0, -1)
        self.powers = np.array([pow(_P, k, _ALL + 1) for k in lengths], np.uint64)
        self.salts = np.array([k * _SALT & _ALL for k in lengths], np.uint64)
        # Most substrings are no piece: a bitmap spares them the sorted search.
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.keys * _MIX) >> _U(44)] = True
        # Marks that no piece has after a letter, so that a word can be cut before them.
        after = {b for p in pieces for a, b in zip(p, p[1:]) if a.isalpha()}
        self.marks = "".join(c for c in ".,;:!?)]}\"'*&$%#" if c not in after)
        self.encoded, self.counted = Kept(b"".join), Kept(sum)
        self._seen = np.full(1 << 20, -1, np.int64)
        self._verdict = np.zeros(1 << 20, bool)

    def _split(self, ranked: list[str]) -> list[int]:
        """Fills left and right (the two pieces that each merge joins) and the
        sorted pair table; returns the ranks that merges can reach."""
        rank = {p: r for r, p in enumerate(ranked)}
        left, right = list(range(len(ranked))), list(range(len(ranked)))
        pairs: dict[tuple[int, int], int] = {}
        usable = list(range(self.singles))
        reached = set(usable)

        def apart(x: int, y: int) -> bool:
            limit = len(ranked)
            while True:
                if pairs.get((x, y), limit) < limit:
                    return False
                if x < self.singles and y < self.singles:
                    return True
                if x > y:
                    limit, x = x, right[x]
                else:
                    limit, y = y + 1, left[y]

        for r in range(self.singles, len(ranked)):
            p = ranked[r]
            for k in range(1, len(p)):
                x, y = rank.get(p[:k], r), rank.get(p[k:], r)
                if x < r and y < r and x in reached and y in reached and apart(x, y):
                    pairs[x, y], left[r], right[r] = r, x, y
                    reached.add(r)
                    usable.append(r)
                    break
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        packed = np.array([x << 20 | y for x, y in pairs], np.int64)
        order = np.argsort(packed)
        self.pair_keys, self.pair_ranks = packed[order], np.array(list(pairs.values()), np.int64)[order]
        return usable

    @staticmethod
    def key(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * _P + ord(c)) & _ALL
        return (h ^ (len(piece) * _SALT)) & _ALL

    def _table(self) -> None:
        """The bytes that each id decodes to, in one array."""
        parts = {i: p.replace(MARK, " ").encode() for p, (i, _) in self.pieces.items()}
        parts |= {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        every = [parts.get(i, b"") for i in range(max(parts) + 1)]
        self.sizes = np.fromiter(map(len, every), np.int64, len(every))
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(every), np.uint8)

    def advance(
        self, end: np.ndarray, start: np.ndarray, last: np.ndarray, score: np.ndarray, tail: list[np.ndarray]
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score, length, last piece) of the best path to each row's end.

        ``end`` is the rolling hash of a row's prefix; column c of ``start``,
        ``last`` and ``score`` stands for the prefix that is width - c characters
        shorter; ``tail[k]`` is the character k places before the end.
        """
        n, width = start.shape
        keys = (end[:, None] - start * self.powers[-width:]) ^ self.salts[-width:]
        row, col = np.nonzero(self.maybe[(keys * _MIX) >> _U(44)])
        sought = keys[row, col]
        place = np.minimum(np.searchsorted(self.keys, sought), len(self.keys) - 1)
        found = self.keys[place] == sought
        row, col, place = row[found], col[found], place[found]
        rank = self.ranks[place]
        total = np.full((n, width), IMPOSSIBLE, np.int64)
        total[row, col] = np.where(self.compatible(last[row, col], rank), score[row, col], IMPOSSIBLE)
        where = np.full((n, width), -1, np.int64)
        where[row, col] = place
        best, rows = total.argmax(axis=1), np.arange(n)
        top, place = total[rows, best], where[rows, best]
        lone = score[:, -1] - 1
        spelled = lone > top
        length = np.where(spelled, 1, width - best)
        # Equal hashes are not yet equal pieces.
        for k in range(int(length.max(initial=0))):
            some = np.flatnonzero((length > k) & ~spelled)
            if (self.codes[place[some], length[some] - 1 - k] != tail[k][some]).any():
                raise LookupError("a substring has the key of another piece")
        return np.maximum(top, lone), length, np.where(spelled, LONE, self.ranks[place])

    def compatible(self, before: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Whether ``piece`` may follow the last piece ``before``.

        Time runs backwards: the merge made last of the two that meet at the
        border is undone, until both are single characters. If the two then at
        the border form a piece that merges before the one just undone (or, on
        the right side, at the same rank, as the leftmost pair goes first), the
        border would not have lasted.
        """
        out = np.ones(len(before), bool)
        rows = np.flatnonzero(before >= 0)
        if not len(rows):
            return out
        packed = before[rows] << 20 | piece[rows]
        slot = (packed * np.int64(0x9E3779B97F4A7C1) >> np.int64(20)) & np.int64(len(self._seen) - 1)
        known = self._seen[slot] == packed
        out[rows[known]] = self._verdict[slot[known]]
        rows, slot, packed = rows[~known], slot[~known], packed[~known]
        x, y = before[rows], piece[rows]
        at = np.arange(len(rows))
        limit = np.full(len(rows), 1 << 40, np.int64)
        verdict = np.ones(len(rows), bool)
        while len(at):
            pair = x << 20 | y
            place = np.minimum(np.searchsorted(self.pair_keys, pair), len(self.pair_keys) - 1)
            merged = (self.pair_keys[place] == pair) & (self.pair_ranks[place] < limit)
            verdict[at[merged]] = False
            more = ~merged & ((x >= self.singles) | (y >= self.singles))
            at, x, y = at[more], x[more], y[more]
            undo_left = x > y
            limit = np.where(undo_left, x, y + 1)
            x, y = np.where(undo_left, self.right[x], x), np.where(undo_left, y, self.left[y])
        out[rows] = verdict
        self._seen[slot], self._verdict[slot] = packed, verdict
        # Of several pairs in one slot the last stays; its verdict has to be its own.
        return out

    # ------------------------------------------------------------------- words
    @staticmethod
    def words(text: str) -> list[str]:
        """The parts of a text that are encoded apart."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        if "\n" not in text and "  " not in text and MARK not in text and text[0] != " ":
            return [MARK + w for w in text.split(" ")]
        return re.findall(f"\n|{MARK}*[^\n{MARK}]+|{MARK}+", marked)

    # ----------------------------------------------------------------- Viterbi
    def _viterbi(self, words: list[str]) -> list[bytes]:
        """Ids of words that all have the same length."""
        n, size = len(words), len(words[0])
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size)
        rolled = np.zeros((n, size + 1), np.uint64)
        for i in range(size):
            rolled[:, i + 1] = rolled[:, i] * _U(_P) + codes[:, i]
        last = np.full((n, size + 1), START, np.int64)
        score = np.zeros((n, size + 1), np.int64)
        back = np.ones((n, size + 1), np.int64)
        for end in range(1, size + 1):
            low = max(0, end - self.longest)
            tail = [codes[:, end - 1 - k] for k in range(end - low)]
            score[:, end], back[:, end], last[:, end] = self.advance(
                rolled[:, end], rolled[:, low:end], last[:, low:end], score[:, low:end], tail
            )
        ids = np.where(last >= 0, self.id_of_rank[np.maximum(last, 0)], -1)
        ids[:, 1:] = np.where(ids[:, 1:] < 0, -1 - codes.astype(np.int64), ids[:, 1:])
        path = np.zeros((n, size + 1), bool)
        at, rows = np.full(n, size), np.arange(n)
        while len(rows):
            path[rows, at[rows]] = True
            at[rows] -= back[rows, at[rows]]
            rows = rows[at[rows] > 0]
        flat = ids[path]
        ends = np.cumsum(path.sum(axis=1))
        cuts = [0, *(ends * 4).tolist()]
        held = flat.astype("<u4").tobytes()
        out = [held[a:b] for a, b in zip(cuts, cuts[1:])]
        for k in np.flatnonzero(score[:, -1] < 0).tolist():
            out[k] = self._spelled(flat[cuts[k] // 4 : cuts[k + 1] // 4].tolist())
        return out

    def _spelled(self, ids: list[int]) -> bytes:
        """Ids in which -1 - c stands for the bytes of character c."""
        out = []
        for i in ids:
            out += [i] if i >= 0 else [self.byte_ids[b] for b in chr(-1 - i).encode("utf-8", "replace")]
        return np.array(out, "<u4").tobytes()

    def _merged(self, word: str) -> bytes:
        """Ids of one word by merges of its best, leftmost pair, from a heap."""
        parts: list[str | None] = list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts):
                both = parts[i] + parts[j]
                if both in self.pieces:
                    heapq.heappush(heap, (-self.pieces[both][1], i, j, both))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return self._spelled([self.pieces[p][0] if p in self.pieces else -1 - ord(p) for p in parts if p is not None])

    def _cut(self, word: str) -> list[str]:
        """The parts of a long word between borders that no piece spans."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        spans = np.zeros(len(codes) + 1, np.int64)
        for low in range(0, len(codes), 1 << 18):
            part = codes[low : low + (1 << 18) + self.longest - 1].astype(np.uint64)
            h = np.zeros(len(part), np.uint64)
            for length in range(1, min(self.longest, len(part)) + 1):
                h = h[: len(part) - length + 1] * _U(_P) + part[length - 1 :]
                if length > 1:
                    keys = h ^ self.salts[-length]
                    some = np.flatnonzero(self.maybe[(keys * _MIX) >> _U(44)])
                    place = np.minimum(np.searchsorted(self.keys, keys[some]), len(self.keys) - 1)
                    some = some[self.keys[place] == keys[some]] + low
                    np.add.at(spans, some + 1, 1)
                    np.add.at(spans, some + length, -1)
        cuts = np.flatnonzero(np.cumsum(spans)[1:-1] == 0) + 1
        cuts = [0, *cuts.tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:])]

    def _resolved(self, texts: list[str | None], known: "Kept", by_heap, by_batch) -> list[list[str]]:
        """Each text's words; ``known`` then has a value for every one of them.
        A word's value is the sum of its parts' values."""
        split = [self.words(t or "") for t in texts]
        missing = known.recalled(set().union(*split))
        batch, parts = set(), []
        for w in missing:
            if w[:2] == MARK * 2:
                known[w] = by_heap(w)
            elif len(w) > LONG:
                parts.append((w, self._cut(w)))
            else:
                stem = w.rstrip(self.marks)
                if len(stem) < len(w) and stem and stem[-1].isalpha():
                    parts.append((w, (stem, w[len(stem) :])))
                else:
                    batch.add(w)
        for p in known.recalled({p for _, ps in parts for p in ps}):
            if len(p) > LONG:
                known[p] = by_heap(p)
            else:
                batch.add(p)
        known.update(by_batch(list(batch)))
        for w, ps in parts:
            known[w] = known.joined(ps)
        return split

    def _by_length(self, words: list[str]) -> Iterator[tuple[str, bytes]]:
        groups: dict[int, list[str]] = {}
        for w in words:
            groups.setdefault(len(w), []).append(w)
        for group in groups.values():
            for at in range(0, len(group), LANES):
                part = group[at : at + LANES]
                try:
                    yield from zip(part, self._viterbi(part))
                except LookupError:
                    yield from ((w, self._merged(w)) for w in part)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = self._resolved(texts, self.encoded, self._merged, self._by_length)
        out = list(map(self.encoded.joined, split))
        self.encoded.age()
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence of ids."""
        return self.decode_all([np.asarray(ids, "<u4").tobytes()])[0]

    def decode_all(self, encoded: list[bytes]) -> list[str]:
        """The texts of encoded ids: bytes are joined, the leading blank goes."""
        ids = np.frombuffer(b"".join(encoded), "<u4")
        ends = np.zeros(len(ids) + 1, np.int64)
        held = []
        for at in range(0, len(ids), DECODED):
            part = ids[at : at + DECODED]
            size = self.sizes[part]
            stop = np.cumsum(size)
            ends[at + 1 : at + 1 + len(part)] = ends[at] + stop
            place = np.repeat(self.places[part] - (stop - size), size) + np.arange(stop[-1])
            held.append(self.bytes[place].tobytes())
        data = b"".join(held)
        stops = ends[np.cumsum([0, *(len(x) // 4 for x in encoded)])].tolist()
        return [data[a:b].decode("utf-8", "replace")[1:] for a, b in zip(stops, stops[1:])]

    # -------------------------------------------------------------------- trie
    def count(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        split = self._resolved(texts, self.counted, lambda w: len(self._merged(w)) // 4, self._by_trie)
        out = list(map(self.counted.joined, split))
        self.counted.age()
        return out

    def _by_trie(self, words: list[str]) -> Iterator[tuple[str, int]]:
        words.sort()
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            try:
                yield from zip(part, self._trie_counts(part))
            except LookupError:
                yield from ((w, len(self._merged(w)) // 4) for w in part)

    def _trie_counts(self, words: list[str]) -> list[int]:
        """Terminal counts of sorted distinct words. Level d holds a node for
        each distinct prefix of d characters, in sorted order."""
        n = len(words)
        lengths = np.fromiter(map(len, words), np.int64, n)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros(n, np.int64)
        alive, node = np.arange(n), np.zeros(n, np.int64)
        # The last levels' nodes: hash, last piece, score, ids, parent and code.
        root = np.zeros(1, np.int64)
        levels = [(np.zeros(1, np.uint64), root + START, root, root, root, np.zeros(1, np.uint32))]
        depth = 0
        while len(alive):
            depth += 1
            code = flat[starts[alive] + depth - 1]
            parent = node[alive]
            fresh = np.ones(len(alive), bool)
            fresh[1:] = (parent[1:] != parent[:-1]) | (code[1:] != code[:-1])
            node[alive] = np.cumsum(fresh) - 1
            parent, code = parent[fresh], code[fresh]
            hashes = levels[-1][0][parent] * _U(_P) + code
            # up[k]: each node's ancestor k + 1 levels above; tail: its last characters.
            up, tail = [parent], [code]
            for k in range(1, min(self.longest, depth)):
                above = levels[-k]
                tail.append(above[5][up[-1]])
                up.append(above[4][up[-1]])
            column = lambda field: np.stack([levels[-k][field][up[k - 1]] for k in range(len(up), 0, -1)], axis=1)
            score, length, last = self.advance(hashes, column(0), column(1), column(2), tail)
            spelled = np.where(last == LONE, 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF), 1)
            count = column(3)[np.arange(len(code)), len(up) - length] + spelled
            levels.append((hashes, last, score, count, parent, code))
            if len(levels) > self.longest:
                levels.pop(0)
            done = lengths[alive] == depth
            out[alive[done]] = count[node[alive[done]]]
            alive = alive[~done]
        return out.tolist()


def model(path: str) -> PieceModel:
    """One model for each worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _parts(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most PART_ROWS rows and PART_BYTES bytes in column
    ``text``; a longer text is a run of its own."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0)
    ends = np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        stop = min(int(np.searchsorted(ends, before + PART_BYTES, "right")), at + PART_ROWS)
        stop = max(stop, at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def encoded(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, ids (binary, little-endian unsigned 32-bit) and decoded (the
    text that the ids give back) for each row."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for some in _parts(batch, "_text_in"):
                ids = pieces.encode(some.column("_text_in").to_pylist())
                texts = pieces.decode_all(ids)
                columns = [*[some.column(k) for k in keep], pa.array(ids, pa.binary()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "ids", "decoded"])

    taken = docs.select(*keep, F.col("text").alias("_text_in"))
    return taken.mapInArrow(task, taken.drop("_text_in").schema.add("ids", "binary").add("decoded", "string"))


def encoding_report(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_ids, ids_crc32, round_trip, decoded_chars: digests of each
    document's ids and of the text decoded from them; the ids too if asked."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for some in _parts(batch, "text"):
                texts = [t or "" for t in some.column("text").to_pylist()]
                ids = pieces.encode(texts)
                back = pieces.decode_all(ids)
                columns = [
                    some.column("doc_id"),
                    pa.array([len(x) // 4 for x in ids], pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array([a == b.replace(MARK, " ") for a, b in zip(back, texts)], pa.bool_()),
                    pa.array([len(t) for t in back], pa.int64()),
                ]
                columns += [pa.array(ids, pa.binary())] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names)

    taken = docs.select("doc_id", "text")
    schema = taken.drop("text").schema.add("n_ids", "long").add("ids_crc32", "long")
    schema = schema.add("round_trip", "boolean").add("decoded_chars", "long")
    schema = schema.add("ids", "binary") if with_ids else schema
    names = schema.names
    return taken.mapInArrow(task, schema)


def count_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens for each document."""
    path = path or public_tokenizers.path("piece_bpe_32k.model")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model(path)
        for batch in batches:
            for some in _parts(batch, "text"):
                counts = pieces.count(some.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(counts, pa.int64())], ["doc_id", "n_tokens"])

    taken = docs.select("doc_id", "text")
    return taken.mapInArrow(task, taken.drop("text").schema.add("n_tokens", "long"))
