"""Token ids as files: concatenated ids with Elias-Fano coded document boundaries, in ascending order of doc_id.

A file row is a shard of consecutive documents: its place (part, seq), the documents' ids, the concatenated token ids in
two or four bytes each, and the ends of the documents within the shard as an Elias-Fano code. Of n ends up to u the code
keeps the low log2(u / n) bits of each in a packed array and the high bits as a bit vector with a one for each end, so
that a document's boundary takes about two bits and the low bits. ``select`` finds the i-th one through samples of every
256th. No table of 64-bit offsets exists; a shard's first token is the sum of the sizes before it.
"""

from __future__ import annotations

import json
import struct
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satbill.llm.batches import small_batches
from satbill.llm.bpe import _kinds, _Pieces, _ragged
from satbill.sources.snapshot import new_folder

SHARD_TOKENS = 1 << 20  # a shard is closed beyond so many ids; a longer document is a shard of its own
SAMPLE = 256
FEW = 100_000  # shards whose starts (16 bytes each) are sent to every task; those of more are joined by a shuffle


class EliasFano:
    """A non-decreasing sequence of whole numbers in near-minimal space."""

    def __init__(self, n: int, bits: int, low: bytes, high: bytes):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        self._samples: tuple[np.ndarray, np.ndarray] | None = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n, last = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        high = np.zeros((last >> bits) + n + 1 if n else 0, np.uint8)
        high[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        pack = lambda x: np.packbits(x.astype(np.uint8).ravel(), bitorder="little").tobytes()
        return cls(n, bits, pack(low), pack(high))

    def to_bytes(self) -> bytes:
        return struct.pack("<QBQ", self.n, self.bits, len(self.low)) + self.low + self.high

    @classmethod
    def from_bytes(cls, blob: bytes) -> EliasFano:
        n, bits, size = struct.unpack_from("<QBQ", blob)
        at = struct.calcsize("<QBQ")
        return cls(n, bits, blob[at : at + size], blob[at + size :])

    def _sampled(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every ``SAMPLE``-th one the byte that holds it, and how many ones stand before that byte. Bytes are read in runs."""
        places, befores, passed = [], [], 0
        for at in range(0, len(high), 1 << 16):
            count = passed + np.cumsum(np.bitwise_count(high[at : at + (1 << 16)]), dtype=np.int64)
            wanted = np.arange(-(-passed // SAMPLE) * SAMPLE, int(count[-1]), SAMPLE)
            inside = np.searchsorted(count, wanted, side="right")
            places.append((at + inside).astype(np.uint32))
            befores.append(np.where(inside > 0, count[inside - 1], passed).astype(np.uint32))
            passed = int(count[-1])
        empty = np.zeros(0, np.uint32)
        return np.concatenate([empty, *places]), np.concatenate([empty, *befores])

    def select(self, i: np.ndarray) -> np.ndarray:
        """The values at the places ``i``."""
        i = np.asarray(i, np.int64)
        high = np.frombuffer(self.high, np.uint8)
        if self._samples is None:
            self._samples = self._sampled(high)
        low = np.zeros(len(i), np.int64)
        bits = np.frombuffer(self.low, np.uint8)
        for b in range(self.bits):
            at = i * self.bits + b
            low |= ((bits[at >> 3] >> (at & 7)) & 1).astype(np.int64) << b
        byte, before = (x[i // SAMPLE].astype(np.int64) for x in self._samples)  # walk on from the sample until the byte holds the one
        own = np.bitwise_count(high[byte]).astype(np.int64) if len(i) else byte
        todo = np.flatnonzero(before + own <= i)
        while len(todo):
            before[todo] += own[todo]
            byte[todo] += 1
            own[todo] = np.bitwise_count(high[byte[todo]])
            todo = todo[before[todo] + own[todo] <= i[todo]]
        inside = np.unpackbits(high[byte][:, None], axis=1, bitorder="little")
        nth = np.argmax(np.cumsum(inside, axis=1) > (i - before)[:, None], axis=1)
        return ((byte * 8 + nth - i) << self.bits) | low


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What the fine splitting relies on, fixed values: the normalizer and the splitting of the vocabulary file.
NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = 0x250  # characters below lower to one character each, but for one, and never compose
BLANK, LETTER, DIGIT, MARK, APOSTROPHE, GLUE = range(6)


@lru_cache(maxsize=1)
def _plain() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of the characters below ``PLAIN``."""
    kinds, lower = np.full(PLAIN, GLUE, np.uint8), np.arange(PLAIN, dtype=np.uint32)
    for c in range(PLAIN):
        kind = _kinds()[c]
        kinds[c] = {0: GLUE, 1: LETTER, 2: DIGIT}.get(int(kind), MARK if c < 128 else GLUE)
        lower[c] = ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c
    kinds[[32, 10]], kinds[39] = BLANK, APOSTROPHE
    return kinds, lower


class _Encoder(_Pieces):
    """Ids of whole texts by the library, which sees each piece once while it is remembered.

    The vocabulary's splitting never joins characters over a blank or line feed, nor, in texts of plain characters, a
    letter to a mark behind it, a digit to anything, or a mark other than an apostrophe to the letter or digit behind it. Texts that
    hold an added token, and files that split otherwise, go to the library whole.
    """

    def __init__(self, path: str):
        self.tokenizer = _tokenizer(path)
        said = json.loads(self.tokenizer.to_str())
        splits = [s.get("pattern", {}).get("Regex") for s in (said["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.known = said["normalizer"] == NORMALIZER and splits[:1] == [SPLIT]
        self.added = [t["content"] for t in said["added_tokens"]]
        nothing = np.zeros(0, np.int64)
        self.first = np.array([0], np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), nothing.astype(np.int32)
        self.reset()

    def library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at in range(0, len(texts), 2_000):
            own = [e.ids for e in self.tokenizer.encode_batch_fast(texts[at : at + 2_000], add_special_tokens=False)]
            n = np.fromiter(map(len, own), np.int64, len(own))
            counts.append(n)
            parts.append(np.fromiter(chain.from_iterable(own), np.int32, int(n.sum())))
        return np.concatenate(parts), np.concatenate(counts)

    def encode_new(self, codes, text, starts, lengths):
        whole = codes.tobytes().decode("utf-32-le")
        return self.library([whole[a : a + n] for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)])

    def texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and how many each has."""
        own = np.array([self.known and not any(a in (t or "") for a in self.added) for t in texts], bool)
        split = [t for t, o in zip(texts, own, strict=True) if o]
        ids, n = self.split(split)
        whole_ids, whole_n = self.library([t or "" for t, o in zip(texts, own, strict=True) if not o])
        counts = np.zeros(len(texts), np.int64)
        counts[own], counts[~own] = n, whole_n
        out, begin = np.empty(int(counts.sum()), np.int32), np.cumsum(counts) - counts
        out[_ragged(begin[own], n)], out[_ragged(begin[~own], whole_n)] = ids, whole_ids
        return out, counts

    def split(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(t or "") for t in texts], np.int64)
        codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le"), np.uint32)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        owner = np.repeat(np.arange(len(texts)), sizes)
        odd = (codes >= PLAIN) | (codes == 0x130)
        plain = np.bincount(owner[odd], minlength=len(texts))[owner] == 0
        kinds, lower = _plain()
        within = np.minimum(codes, PLAIN - 1)
        kind = np.where(odd, GLUE, kinds[within])
        codes = np.where(plain, lower[within], codes).astype(np.uint32)
        a, b = kind[:-1], kind[1:]
        cut = ((a == LETTER) & (b >= DIGIT) & (b <= APOSTROPHE)) | ((a == DIGIT) & (b >= LETTER) & (b <= APOSTROPHE))
        cut |= ((a == MARK) & ((b == LETTER) | (b == DIGIT))) | ((a == APOSTROPHE) & (b == DIGIT))
        cut = (cut & plain[1:]) | (a == BLANK) | (b == BLANK) | (owner[1:] != owner[:-1])
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        lengths = np.diff(np.append(starts, len(codes)))
        filled = kind[starts] != BLANK
        starts, lengths = starts[filled], lengths[filled]
        kept = _ragged(starts, lengths)  # the blanks go
        ids, n = self.encode(codes[kept], None, np.cumsum(lengths) - lengths, lengths)
        return ids, np.bincount(owner[starts], n, len(texts)).astype(np.int64)


@lru_cache(maxsize=1)
def _encoder(path: str) -> _Encoder:
    """One for all tasks of a worker process, which so remembers the pieces of earlier tasks."""
    return _Encoder(path)


SHARD = "part int, seq int, n_tokens long, doc_ids array<long>, ends binary, width int, ids binary"


def write(docs: DataFrame, folder: str, path: str, end_id: int | None = 2) -> None:
    """Writes the shards of the whole texts to ``folder``; ``path`` names the tokenizer's file on every machine.

    Every document gets ``end_id`` appended, null and empty texts consist of it alone. Null ids come first; rows that share
    an id follow each other by a hash of their texts. Columns but doc_id and text are left out. Ids take two bytes each
    where the vocabulary allows it.
    """
    def run(batches):
        encoder = _encoder(path)
        width = 2 if max(encoder.tokenizer.get_vocab_size(), (end_id or 0) + 1) <= 1 << 16 else 4
        part, seq = TaskContext.get().partitionId(), 0
        keys: list[int | None] = []
        blobs: list[bytes] = []
        ends = [0]

        def shard():
            code = EliasFano.of(np.array(ends[1:], np.uint64)).to_bytes()
            row = [part, seq, ends[-1], keys, code, width, b"".join(blobs)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["part", "seq", "n_tokens", "doc_ids", "ends", "width", "ids"]
            )

        for whole in batches:
            for at in range(0, whole.num_rows, 250):
                batch = whole.slice(at, 250)
                ids, counts = encoder.texts(batch.column("text").to_pylist())
                flat, cuts = ids.astype(f"<u{width}").tobytes(), np.concatenate([[0], np.cumsum(counts)]) * width
                closing = b"" if end_id is None else np.array([end_id], f"<u{width}").tobytes()
                for i, key in enumerate(batch.column("doc_id").to_pylist()):
                    blob = flat[cuts[i] : cuts[i + 1]] + closing
                    if keys and ends[-1] + len(blob) // width > SHARD_TOKENS:
                        yield shard()
                        keys, blobs, ends, seq = [], [], [0], seq + 1
                    keys.append(key)
                    blobs.append(blob)
                    ends.append(ends[-1] + len(blob) // width)
        if keys:
            yield shard()

    small_batches(docs.sparkSession)
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = ordered.repartitionByRange(parts, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")
    ordered.select("doc_id", "text").mapInArrow(run, SHARD).write.option("compression", "zstd").parquet(folder)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with ``start``, the number of token ids in all shards before. Windows pass one row per part, then per shard."""
    shards = spark.read.schema(SHARD).parquet(folder)
    few = shards.count() <= FEW
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    sizes = sizes.select("part", (F.sum("size").over(whole) - F.col("size")).alias("base"))
    own = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    starts = shards.select("part", "seq", (F.sum("n_tokens").over(own) - F.col("n_tokens")).alias("before"))
    starts = starts.join(sizes, "part").select("part", "seq", (F.col("base") + F.col("before")).alias("start"))
    return shards.join(F.broadcast(starts) if few else starts, ["part", "seq"])


def documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document, through the select structures."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                ends = EliasFano.from_bytes(row["ends"]).select(np.arange(len(row["doc_ids"])))
                starts = np.concatenate([[0], ends[:-1]])
                for at in range(0, len(ends), 1000):
                    some = slice(at, at + 1000)
                    blobs = [ids[a:b].astype("<u4").tobytes() for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row["doc_ids"][some], pa.int64()), pa.array(starts[some] + row["start"]), pa.array((ends - starts)[some]), pa.array(blobs, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return shards.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def written(docs: DataFrame, path: str, end_id: int | None = 2) -> DataFrame:
    """Writes the files to a new folder under ``spark.checkpoint.dir``, which ``remove_snapshots`` deletes, and reads the documents back from them."""
    spark = docs.sparkSession
    folder = new_folder(spark, "token-files")
    write(docs, folder, path, end_id)
    return documents(read(spark, folder))
