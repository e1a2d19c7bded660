"""Byte-level BPE: ids by merge ranks, and back.

A text is split into pieces by the vocabulary's pattern; equal pieces are encoded once per task while they are remembered.
New pieces become rows of padded matrices of token ids, one matrix per bucket of lengths. Each round finds in every row
the leftmost pair of minimum rank, merges it, and closes the gap; rows without a pair left leave the matrix. The rank of a
pair comes from an open-addressing hash table of all pairs of tokens that join to a token. Pieces over ``WIDE`` bytes take
the same merges in the same order from a heap, as a matrix of one endless row would be quadratic.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from satbill.llm.batches import small_batches

NONE = np.iinfo(np.int32).max
WIDE = 512
CELLS = 1 << 18
SLICE = 1 << 20  # characters, and at most a quarter as many ids, handled at once; a longer text is handled by itself
REMEMBERED = 1_000_000  # pieces
SPACE, LETTER, NUMBER, OTHER = range(4)
#: The pattern of the byte-level vocabularies, a fixed value; ``starts_of`` does by arrays what it says.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class PairTable:
    """Hash table from two token ids to the id of their join; linear probing, at most a quarter full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        keys = self._keys(left, right)
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        slots, todo = self._slots(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slots[todo]] == -1]
            _, first = np.unique(slots[free], return_index=True)  # one key a slot
            won = free[first]
            self.keys[slots[won]], self.values[slots[won]] = keys[won], joined[won]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _keys(left, right):
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _slots(self, keys):
        with np.errstate(over="ignore"):
            return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair; ``NONE`` where the two don't join or one of them is padding (-1)."""
        keys = self._keys(left, right)
        slots = self._slots(keys)
        out = np.full(keys.shape, NONE, np.int32)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        while len(todo):
            held = self.keys[slots[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slots[todo[hit]]]
            todo = todo[~hit & (held != -1)]
            slots[todo] = (slots[todo] + 1) & ((1 << self.bits) - 1)
        return out


def _ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places of all cells of the runs that begin at ``starts``."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


class Vocabulary:
    """Tokens by rank, read from a file of lines ``base64 rank``."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
        self.tokens = [b""] * (max(self.ids.values()) + 1)
        for token, i in self.ids.items():
            self.tokens[i] = token
        pairs = [
            (self.ids[token[:at]], self.ids[token[at:]], i)
            for token, i in self.ids.items() for at in range(1, len(token)) if token[:at] in self.ids and token[at:] in self.ids
        ]
        self.pairs = PairTable(*np.array(pairs, np.int32).reshape(-1, 3).T)
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.text = np.frombuffer(b"".join(self.tokens), np.uint8)

    def encode(self, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of ``text`` (bytes), one after another, and how many each piece has."""
        order, at, parts = np.argsort(lengths, kind="stable"), 0, []
        sizes = lengths[order]
        while at < len(order):
            width = int(sizes[at])
            if width > WIDE:
                piece = order[at]
                ids = np.array(self._long(text[starts[piece] : starts[piece] + width].tobytes()), np.int32)
                parts.append((order[at : at + 1], np.array([len(ids)]), ids))
                at += 1
                continue
            width += width // 4  # the bucket's longest
            end = min(int(np.searchsorted(sizes, width, side="right")), at + max(1, CELLS // max(width, 1)))
            rows = order[at:end]
            parts += [(rows[r], counts, ids) for r, counts, ids in self._matrix(text, starts[rows], lengths[rows])]
            at = end
        counts = np.zeros(len(order), np.int64)
        for rows, n, _ in parts:
            counts[rows] = n
        out, begin = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        for rows, n, ids in parts:
            out[_ragged(begin[rows], n)] = ids
        return out, counts

    def _matrix(self, text, starts, lengths):
        """(rows, number of ids of each, their ids) as the rows are done."""
        width = max(int(lengths.max(initial=0)), 1)
        cells = np.full((len(starts), width + 1), -1, np.int32)  # the last column stays padding
        cells[:, :-1][np.arange(width) < lengths[:, None]] = self.bytes[text[_ragged(starts, lengths)]]
        rows = np.arange(len(starts))
        ranks = self.pairs.ranks(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(rows), width)
        while len(rows):
            best = ranks.argmin(axis=1)  # the leftmost of equal ones
            lines = np.arange(len(rows))
            rank = ranks[lines, best]
            done = rank == NONE
            if done.any():
                full = cells[done]
                yield rows[done], (full >= 0).sum(axis=1), full[full >= 0]
                cells, ranks, rows, best, rank = cells[~done], ranks[~done], rows[~done], best[~done], rank[~done]
                if not len(rows):
                    break
                lines = np.arange(len(rows))
            cells[lines, best] = rank
            cells = self._close(cells, best + 1)
            ranks = self._close(ranks, best)
            ranks[:, -1] = NONE
            here = cells[lines, best]
            after = np.minimum(best + 1, cells.shape[1] - 1)
            ranks[lines, best] = self.pairs.ranks(here, cells[lines, after])
            before = best > 0
            ranks[lines[before], best[before] - 1] = self.pairs.ranks(cells[lines[before], best[before] - 1], here[before])
            wide = int((cells >= 0).any(axis=0).sum())
            cells, ranks = cells[:, : wide + 1], ranks[:, :wide]

    @staticmethod
    def _close(cells: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Each row without its cell ``gone``; the last cell is kept once more."""
        width = cells.shape[1]
        take = np.arange(width) + (np.arange(width) >= gone[:, None])
        return np.take_along_axis(cells, np.minimum(take, width - 1), axis=1)

    def _long(self, piece: bytes) -> list[int]:
        ids = self.bytes[np.frombuffer(piece, np.uint8)].tolist()
        after = list(range(1, len(ids))) + [-1]
        before = list(range(-1, len(ids) - 1))
        tokens, table = self.tokens, self.ids
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(len(ids) - 1) if (r := table.get(tokens[ids[i]] + tokens[ids[i + 1]])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j < 0 or ids[j] != right:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = rank, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := table.get(tokens[ids[a]] + tokens[ids[b]])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]


    def decode(self, ids: np.ndarray) -> bytes:
        """The tokens' bytes, joined."""
        return self.text[_ragged(self.starts[ids], self.lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    kinds = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    codes = np.frombuffer(everything.encode("utf-32-le"), np.uint32)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for run in regex.finditer(pattern, everything):
            kinds[codes[run.start() : run.end()]] = kind
    return kinds


def starts_of(codes: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The places where the pieces of ``PATTERN`` begin, in texts that begin at ``begins`` (none of them empty).

    A piece is a run of one kind of character. The last white space before another character is a piece apart from the
    white space before it; a blank there joins the piece that follows. An apostrophe that begins a piece and stands before
    one of the fixed endings makes a piece with it.
    """
    n = len(codes)
    kind = _kinds()[codes]
    new_text = np.zeros(n + 3, bool)
    new_text[begins] = True
    new_text[n:] = True
    start = new_text[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~new_text[1:n])
    start[last] = True
    start[last[codes[last] == 32] + 1] = False
    mark = np.flatnonzero((codes == 39) & start)
    ahead = np.concatenate([codes, [0, 0, 0]]).astype(np.int64)
    mark = mark[~new_text[mark + 1]]
    first, second = ahead[mark + 1], np.where(new_text[mark + 2], 0, ahead[mark + 2])
    one = np.isin(first, [ord(c) for c in "stmd"])
    two = np.isin(first * 128 + np.minimum(second, 127), [ord(a) * 128 + ord(b) for a, b in ("re", "ve", "ll")])
    start[mark[one | two] + 1] = False
    ends = np.concatenate([mark[one] + 2, mark[two & ~one] + 3])
    start[ends[ends < n]] = True
    return np.flatnonzero(start)


class _Pieces:
    """Ids of pieces by a hash of their characters; tokens are known from the start, so a piece that is a token is that token."""

    def __init__(self, words: Vocabulary):
        self.words = words
        texts = [(i, t.decode()) for t, i in words.ids.items() if self._is_text(t)]
        codes = np.frombuffer("".join(t for _, t in texts).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(t) for _, t in texts], np.int64)
        hashes, order = np.unique(self.hashes(codes, np.cumsum(lengths) - lengths, lengths), return_index=True)
        self.first = hashes, np.arange(len(order)), np.ones(len(order), np.int64), np.array([i for i, _ in texts], np.int32)[order]
        self.reset()

    def reset(self) -> None:
        self.keys, self.begin, self.count, self.ids = self.first

    @staticmethod
    def _is_text(token: bytes) -> bool:
        try:
            return bool(token.decode())
        except UnicodeDecodeError:
            return False

    @staticmethod
    def hashes(codes, starts, lengths):
        """64-bit sums over the characters, each mixed with its place in the piece."""
        place = np.arange(len(codes)) - np.repeat(starts, lengths)
        x = codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return np.add.reduceat(x ^ (x >> np.uint64(32)), starts) if len(starts) else np.zeros(0, np.uint64)

    def encode(self, codes, text, starts, lengths) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces of ``codes`` (characters; ``text`` has their bytes), and how many each piece has."""
        keys, first, again = np.unique(self.hashes(codes, starts, lengths), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        new = self.keys[at] != keys
        if new.any():
            if len(self.keys) + int(new.sum()) > REMEMBERED:
                self.reset()
                at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
                new = self.keys[at] != keys
            ids, count = self.encode_new(codes, text, starts[first[new]], lengths[first[new]])
            order = np.argsort(all_keys := np.concatenate([self.keys, keys[new]]), kind="stable")
            self.begin = np.concatenate([self.begin, len(self.ids) + np.cumsum(count) - count])[order]
            self.count = np.concatenate([self.count, count])[order]
            self.ids, self.keys = np.concatenate([self.ids, ids]), all_keys[order]
            at = np.searchsorted(self.keys, keys)
        at = at[again]
        return self.ids[_ragged(self.begin[at], self.count[at])], self.count[at]


    def encode_new(self, codes, text, starts, lengths):
        size = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF).astype(np.int64)
        ends = np.cumsum(size)
        begin = ends[starts] - size[starts]
        return self.words.encode(text, begin, ends[starts + lengths - 1] - begin)


def encode_texts(texts: list[str | None], pieces: _Pieces, pattern: str = PATTERN) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the texts, one after another, and how many each has."""
    full = [t for t in texts if t]
    counts = np.zeros(len(texts), np.int64)
    if not full:
        return np.zeros(0, np.int32), counts
    whole = "".join(full)
    codes, sizes = np.frombuffer(whole.encode("utf-32-le"), np.uint32), np.array([len(t) for t in full])
    begins = np.cumsum(sizes) - sizes
    if pattern == PATTERN:
        starts = starts_of(codes, begins)
        lengths = np.diff(np.append(starts, len(codes)))
    else:
        spans = [(b + m.start(), b + m.end()) for b, t in zip(begins.tolist(), full, strict=True) for m in regex.finditer(pattern, t) if m.group()]
        starts, lengths = np.array([a for a, _ in spans], np.int64), np.array([b - a for a, b in spans], np.int64)
        kept = _ragged(starts, lengths)  # characters that no piece holds are left out
        inside = np.searchsorted(kept, begins)
        codes, begins = codes[kept], inside
        starts = np.cumsum(lengths) - lengths
        whole = codes.tobytes().decode("utf-32-le")
    ids, n = pieces.encode(codes, np.frombuffer(whole.encode(), np.uint8), starts, lengths)
    owner = np.searchsorted(begins, starts, side="right") - 1
    counts[np.flatnonzero([bool(t) for t in texts])] = np.bincount(owner, n, len(full)).astype(np.int64)
    return ids, counts


def _portions(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` in sum."""
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1 if len(sizes) else np.zeros(0, np.int64)
    yield from ((a, b) for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True) if b > a)


def encoded(docs: DataFrame, path: str, pattern: str = PATTERN, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``ids``, the token ids of each whole text. A null or empty text has none.

    ``path`` names the rank file on every machine. Rows stay where they are; repeated rows and null keys are rows like
    others, and further columns of ``docs`` are left out.
    """

    def run(batches):
        pieces = _Pieces(vocabulary(path))
        for whole in batches:
            sizes = np.array([len(t) if t else 0 for t in whole.column("text").to_pylist()], np.int64)
            for a, b in _portions(sizes, SLICE):
                batch = whole.slice(a, b - a)
                ids, counts = encode_texts(batch.column("text").to_pylist(), pieces, pattern)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), lists], [*keep, "ids"])

    small_batches(docs.sparkSession)
    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    chosen = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("text"))
    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` with ``decoded``, the bytes their ``ids`` stand for. Null ids decode to no bytes, an unknown id raises."""

    def run(batches):
        words = vocabulary(path)
        for whole in batches:
            place = whole.schema.names.index("ids")
            sizes = np.asarray(whole.column(place).value_lengths().fill_null(0)).astype(np.int64)
            for a, b in _portions(sizes, SLICE // 4):
                batch = whole.slice(a, b - a)
                n = sizes[a:b]
                ids = np.asarray(batch.column(place).flatten()).astype(np.int64)
                text, ends = words.decode(ids), np.concatenate([[0], np.cumsum(words.lengths[ids])])
                bounds = ends[np.concatenate([[0], np.cumsum(n)])]
                texts = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(text)])
                yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*batch.schema.names, "decoded"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("decoded", T.BinaryType())]))
