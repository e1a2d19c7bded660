"""Repeated word sequences across documents, found on a compacted de Bruijn graph of word windows.

A window of ``WINDOW`` words is an edge between the sequences of one word less. Consecutive edges that share their
minimizer, the run of ``MINI`` words with the lowest hash, form one path, so the graph is dealt to Spark by minimizer
and a path is stored as its document, first word, length, and a 128-bit digest of its words. Joins then compact it:

1. A minimizer seen in one document only holds no repeated edge; its paths drop out.
2. Paths with equal digests are one path, owned by the smallest doc_id; all its edges are repeats in the other documents.
3. Where all paths of a minimizer are equal, the path does not branch and its owner keeps it. Only the owners' copies of
   branching paths are opened: their source coordinates give back the words, and every window is compared by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satbill.llm.batches import small_batches
from satbill.sources.snapshot import snapshot

WINDOW, MINI = 50, 8
SLICE = 300_000  # words handled at once; a longer document is handled by itself
PLACE = np.uint64((1 << 24) - 1)  # low bits of a key hold the place; longer documents are walked in pieces


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _minimizers(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each window over the word hashes: the place of its minimizer (leftmost if equal); and the hash of each run of words."""
    g = h
    for span, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        g = g[:-span] * np.uint64(factor) + g[span:]
    g = (g ^ (g >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    g ^= g >> np.uint64(32)
    key = (g & ~PLACE) | np.arange(len(g), dtype=np.uint64)
    width, low, span = WINDOW - MINI + 1, key, 1
    while span * 2 <= width:
        low, span = np.minimum(low[:-span], low[span:]), span * 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    return (low & PLACE).astype(np.int64), g


def _paths(docs: list[list[bytes]], hashes: _Hashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per document its paths: minimizer hash, digest (two longs), first word, number of windows."""
    at = 0
    while at < len(docs):
        end, n = at, 0
        while end < len(docs) and (n == 0 or n + len(docs[end]) <= SLICE):
            n, end = n + len(docs[end]), end + 1
        yield from _paths_of([docs[i] for i in range(at, end)], hashes)
        at = end


def _paths_of(docs, hashes):
    lengths = np.array([len(d) for d in docs], np.int64)
    firsts = np.cumsum(lengths) - lengths
    words = [w for d in docs for w in d]
    owner = np.repeat(np.arange(len(docs)), lengths)
    found = []  # first word, number of windows, minimizer hash
    reach = (1 << 24) - WINDOW
    for a in range(0, max(len(words) - WINDOW + 1, 0), reach):
        h = np.fromiter(map(hashes.__getitem__, words[a : a + reach + WINDOW - 1]), np.uint64)
        if len(h) < WINDOW:
            break
        place, g = _minimizers(h)
        own = owner[a : a + len(h)]
        valid = own[: len(place)] == own[WINDOW - 1 : WINDOW - 1 + len(place)]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (place[1:] != place[:-1])
        starts = np.flatnonzero(new)
        # a run ends where the next one starts or the windows stop being within one document
        ends = np.minimum(
            np.append(starts[1:], len(place)),
            np.concatenate([np.flatnonzero(~valid), [len(place)]])[np.searchsorted(np.flatnonzero(~valid), starts)],
        ) if len(starts) else starts
        found.append((starts + a, ends - starts, g[place[starts]].view(np.int64) if len(starts) else np.zeros(0, np.int64)))
    start, count, mini = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    left = np.where(start > 0, ends[start - 1] + 1, 0) if len(start) else start
    right = ends[start + count + WINDOW - 2] if len(start) else start
    digest = xxhash.xxh3_128_digest
    digests = np.frombuffer(b"".join(digest(line[a:b]) for a, b in zip(left.tolist(), right.tolist(), strict=True)), "<i8").reshape(-1, 2)
    cuts = np.searchsorted(owner[start] if len(start) else start, np.arange(len(docs) + 1))
    for i in range(len(docs)):
        part = slice(cuts[i], cuts[i + 1])
        yield mini[part], digests[part], start[part] - firsts[i], count[part]


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    values = np.concatenate(rows) if rows else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(values), kind))


def _graph(batches):
    hashes = _Hashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            docs = [(t or b"").split() for t in batch.column("text").to_pylist()]
            paths = list(_paths(docs, hashes))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("text_hash"), pa.array([len(d) for d in docs], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(d)).digest() for d in docs], pa.binary()),
                    _lists([p[0] for p in paths], pa.int64()), _lists([p[1][:, 0] for p in paths], pa.int64()),
                    _lists([p[1][:, 1] for p in paths], pa.int64()), _lists([p[2] for p in paths], pa.int32()),
                    _lists([p[3] for p in paths], pa.int32()),
                ],
                ["doc_id", "text_hash", "n_words", "words_sha", "mini", "da", "db", "first", "windows"],
            )


def _open_windows(batches):
    """Digests of the windows of the open spans, from the words at their coordinates."""
    digest = xxhash.xxh3_128_digest
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            ids, hashes, places, digests = [], [], [], []
            for key, text_hash, text, spans in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "spans")), strict=True):
                words = text.split()
                line = b" ".join(words)
                ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
                opened = sorted({p for s in spans if s["open"] for p in range(s["first"], s["first"] + s["windows"])})
                places += opened
                digests += [digest(line[(ends[p - 1] + 1 if p else 0) : ends[p + WINDOW - 1]]) for p in opened]
                ids += [key] * len(opened)
                hashes += [text_hash] * len(opened)
            pairs = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field("doc_id").type), pa.array(hashes, pa.int64()), pa.array(places, pa.int32()), pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))],
                ["doc_id", "text_hash", "first", "wa", "wb"],
            )


def _cut(batches):
    for whole in batches:
        for at in range(0, whole.num_rows, 500):
            batch = whole.slice(at, 500)
            removed, kept = [], []
            for text, spans, hits in zip(*(batch.column(c).to_pylist() for c in ("text", "spans", "hits")), strict=True):
                words = text.split()
                depth = np.zeros(len(words) + 1, np.int64)
                whole_spans = np.array([(s["first"], s["first"] + s["windows"] - 1 + WINDOW) for s in spans if not s["open"]], np.int64).reshape(-1, 2)
                single = np.array(hits or [], np.int64)
                np.add.at(depth, np.concatenate([whole_spans[:, 0], single]), 1)
                np.add.at(depth, np.concatenate([whole_spans[:, 1], single + WINDOW]), -1)
                covered = np.cumsum(depth[:-1]) > 0
                removed.append(int(covered.sum()))
                kept.append(b" ".join(w for w, gone in zip(words, covered.tolist(), strict=True) if not gone))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                ["doc_id", "text_hash", "n_removed", "kept"],
            )


def repeats(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Words that stand in a window of 50 which also starts in a document with a smaller doc_id.

    Returns (rows, cut). ``rows`` has doc_id, text_hash, n_words and words_sha (of the words joined by one space) per row of
    ``docs``. ``cut`` has doc_id, text_hash, n_removed and kept (the other words, joined) once per text that loses words.
    Windows are judged on the input. A null text has no words, a text under 50 words no window. Rows without a doc_id
    neither lose words nor take them; rows that share a doc_id don't take each other's. Columns but doc_id and text play no part.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    # the hash tells apart different texts under one doc_id
    source = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    key = ["doc_id", "text_hash"]
    base = T.StructType().add("doc_id", kind).add("text_hash", "long")
    many = lambda name: T.ArrayType(T.LongType() if name in ("mini", "da", "db") else T.IntegerType())
    schema = T.StructType([*base.fields]).add("n_words", "long").add("words_sha", "binary")
    for name in ("mini", "da", "db", "first", "windows"):
        schema = schema.add(name, many(name))
    graph = snapshot(source.mapInArrow(_graph, schema), "repeats-graph")

    paths = graph.where("doc_id IS NOT NULL").select(
        *key, F.explode(F.arrays_zip("mini", "da", "db", "first", "windows")).alias("p")
    ).select(*key, "p.*")
    minis = paths.groupBy("mini").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"),
        ((F.min("da") != F.max("da")) | (F.min("db") != F.max("db"))).alias("branching"),
    )
    minis = snapshot(minis.where("low < high").select("mini", "branching"), "repeats-minimizers")
    shared = snapshot(paths.join(minis, "mini").drop("mini"), "repeats-paths")
    owners = snapshot(shared.groupBy("da", "db").agg(F.min("doc_id").alias("owner")), "repeats-owners")
    spans = snapshot(
        shared.join(owners, ["da", "db"]).where("doc_id > owner OR branching")
        .select(*key, "first", "windows", (F.col("doc_id") == F.col("owner")).alias("open")), "repeats-spans",
    )
    by_doc = spans.groupBy(*key).agg(F.collect_set(F.struct("first", "windows", "open")).alias("spans"))  # of one text, however often it stands
    texts = snapshot(source.join(by_doc, key).dropDuplicates(key), "repeats-texts")

    opened = texts.where(F.exists("spans", lambda s: s["open"])).mapInArrow(
        _open_windows, T.StructType([*base.fields]).add("first", "integer").add("wa", "long").add("wb", "long")
    )
    opened = snapshot(opened, "repeats-windows")
    lowest = opened.groupBy("wa", "wb").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    lowest = snapshot(lowest.where("low < high").select("wa", "wb", "low"), "repeats-lowest")
    hits = opened.join(lowest, ["wa", "wb"]).where("doc_id > low")
    hits = hits.groupBy(*key).agg(F.collect_list("first").alias("hits"))
    cut = texts.join(hits, key, "left").where(F.col("hits").isNotNull() | F.exists("spans", lambda s: ~s["open"]))
    cut = cut.mapInArrow(_cut, T.StructType([*base.fields]).add("n_removed", "long").add("kept", "binary"))
    return graph.select(*key, "n_words", "words_sha"), cut


ORACLE_SQL = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
windows AS (SELECT doc_id, i, md5(array_to_string(l[i:i + 49], ' ')) AS h
            FROM (SELECT doc_id, l, unnest(range(1, len(l) - 48)) AS i FROM words)),
firsts AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (h) WHERE doc_id > low),
single AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS p, unnest(l) AS word FROM words),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM single s ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(len(l) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""
