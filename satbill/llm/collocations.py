"""Phrase collocations: exact counts of frequent two- and three-word phrases per language, scored and ranked.

Words get ids by falling frequency, so that most pairs of neighbours lie in a few tiles of a grid of ids. A task collects
pairs, sorts them by tile, counts a dense tile by direct address (numpy bincount over its cells) and a sparse one as
sorted coordinates. Frequent pairs are ranked anew and become the ids of the next round, which counts (pair, next word)
the same way. What all tasks count goes by phrase through one Spark aggregate; scores are joins of the frequent phrases with their parts.

A phrase can only be frequent if its words and pairs are. Tasks know this from bitmaps of hashes, whose size is fixed: a
hash shared by chance only adds a count that the aggregate's threshold removes. The id tables are bounded too; words
and pairs beyond them get ids of the task that meets them, and lead to the same rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from satbill.llm.batches import small_batches
from satbill.sources.snapshot import snapshot

LEAST = 10
COVER = 50  # per cent of a phrase's occurrences that a longer one must have to cover it
SCALE = 1_000_000
DENSE = 16  # a tile is dense if it holds at least one occurrence for so many cells
SIDE = 31  # bits of an id in a key
END = b"\xff"  # no byte of UTF-8: stands between pieces
SPLIT = bytes(0xFF if x in b".,;:!?\n\x0b\x0c\r" else x + 32 if 65 <= x <= 90 else x for x in range(256))
COUNTED = "lang string, phrase string, n long"


@dataclass(frozen=True)
class Sizes:
    """Bounds of what a task holds; they never change the result."""

    ranked: int = 1 << 17  # words, and pairs, that have an id everywhere
    bits: int = 26  # a bitmap has 2**bits bits (8 MB)
    tile: int = 10  # a tile has 2**tile ids a side
    buffer: int = 600_000  # words counted at once, and the document that passes it
    local: int = 1 << 17  # words beyond the ranked ones that a task remembers at once


SIZES = Sizes()


def words_of(text: bytes | None) -> list[bytes]:
    """The text's words, with ``END`` between the pieces."""
    return (text or b"").translate(SPLIT).replace(END, b" \xff ").split()


def _rows(langs, phrases, counts) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([langs, phrases.cast(pa.string()), pa.array(counts, pa.int64())], ["lang", "phrase", "n"])


def _count_words(sizes: Sizes, batches):
    """Occurrences of each word in the task, in parts of bounded size."""
    held: dict[str, Counter] = {}

    def flush():
        for lang, counts in held.items():
            counts.pop(END, None)
            yield _rows(pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.binary()), list(counts.values()))
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, held.values())) > 2 * sizes.local:
            yield from flush()
    yield from flush()


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * np.uint64(0x9E3779B97F4A7C15) + b * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _hash(lang: str, word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, xxhash.xxh32_intdigest(lang))


def _place(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """One bit for each hash of the rows' phrases (one word, or two); ``2**bits`` bits reach the driver, however many rows."""

    def run(batches):
        for batch in batches:
            places = []
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
                parts = np.array([_hash(lang, w.encode()) for w in phrase.split(" ")], np.uint64)
                places.append(parts[:1] if len(parts) == 1 else _mix(parts[:1], parts[1:2]))
            yield pa.RecordBatch.from_arrays([pa.array(_place(np.concatenate([np.zeros(0, np.uint64), *places]), bits))], ["bit"])

    bit = F.col("bit") + 1  # Spark's buckets begin at 1
    rows = phrases.select("lang", "phrase").mapInArrow(run, "bit long").groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("part")
    )
    out = np.zeros(1 << bits >> 3, np.uint8)
    for row in rows.collect():
        part = np.frombuffer(row["part"], np.uint8)
        at = (row["bucket"] - 1) * len(part)
        out[at : at + len(part)] = part[: len(out) - at]
    return out


def _has(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = _place(hashes, len(bits).bit_length() + 2)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def top(phrases: DataFrame, ranked: int) -> list[tuple[str, bytes]]:
    """At most ``ranked`` (language, phrase)s, those of the highest counts, most frequent first.

    Counts of counts, by sixteenths of a power of two, say where to cut, so no more rows than that leave the tasks.
    """
    leveled = phrases.withColumn("level", F.floor(F.log2("n") * 16))
    cut, n = None, 0
    for row in sorted(leveled.groupBy("level").count().collect(), reverse=True):
        n += row["count"]
        if n > ranked:
            break
        cut = row["level"]
    rows = leveled.where(F.col("level") >= cut).select("n", "lang", "phrase").collect() if cut is not None else []
    return [(r.lang, r.phrase.encode()) for r in sorted(rows, key=lambda r: (-r.n, r.lang, r.phrase))]


class _Words:
    """Ids of words: the ranked ones, then those the task meets; END and words that cannot be frequent are -1."""

    def __init__(self, sizes: Sizes, ranked: list[tuple[str, bytes]], hashes: list[int], bits: np.ndarray):
        self.sizes, self.bits, self.n_ranked = sizes, bits, len(ranked)
        self.langs, self.words, self.hashes = [k for k, _ in ranked], [w for _, w in ranked], list(hashes)
        self.of: dict[str, _Ids] = {}
        for i, (lang, word) in enumerate(ranked):
            self.ids(lang)[word] = i

    def ids(self, lang: str) -> _Ids:
        if lang not in self.of:
            self.of[lang] = _Ids(lang, self)
            self.of[lang][END] = -1
        return self.of[lang]

    def full(self) -> bool:
        return len(self.words) - self.n_ranked > self.sizes.local or sum(map(len, self.of.values())) > self.sizes.ranked + 2 * self.sizes.local

    def forget(self) -> None:
        """Back to the ranked words."""
        for lang, ids in self.of.items():
            kept = {w: i for w, i in ids.items() if 0 <= i < self.n_ranked}
            ids.clear()
            ids.update(kept)
            ids[END] = -1
        del self.langs[self.n_ranked :], self.words[self.n_ranked :], self.hashes[self.n_ranked :]


class _Ids(dict):
    """One language's ids; a new word gets the next one, or -1 if the bitmap lacks it."""

    def __init__(self, lang: str, table: _Words):
        super().__init__()
        self.lang, self.table = lang, table

    def __missing__(self, word: bytes) -> int:
        table, value = self.table, _hash(self.lang, word)
        at = value >> (64 - table.sizes.bits)
        if table.bits[at >> 3] >> (at & 7) & 1:
            new = len(table.words)
            table.langs.append(self.lang)
            table.words.append(word)
            table.hashes.append(value)
        else:
            new = -1
        self[word] = new
        return new


def tile_counts(a: np.ndarray, b: np.ndarray, side: int = SIZES.tile) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs (a, b) and their counts: tiles that are dense by bincount over their cells, the others sorted."""
    tile = ((a >> side) << SIDE) | (b >> side)
    order = np.argsort(tile, kind="stable")
    a, b, tile = a[order], b[order], tile[order]
    starts = np.flatnonzero(np.concatenate([[True], tile[1:] != tile[:-1]])) if len(tile) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(tile)))
    cells, found = 1 << 2 * side, []
    low = (1 << side) - 1
    dense = lengths * DENSE >= cells
    for at, n in zip(starts[dense].tolist(), lengths[dense].tolist(), strict=True):
        part = slice(at, at + n)
        counts = np.bincount(((a[part] & low) << side) | (b[part] & low), minlength=cells)
        used = np.flatnonzero(counts)
        found.append(((a[at] & ~low) | (used >> side), (b[at] & ~low) | (used & low), counts[used]))
    sparse = np.repeat(~dense, lengths)
    keys, counts = np.unique((a[sparse] << SIDE) | b[sparse], return_counts=True)
    found.append((keys >> SIDE, keys & ((1 << SIDE) - 1), counts))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _runs(batches, words: _Words) -> Iterator[np.ndarray]:
    """Ids of the words of about ``buffer`` words at a time, -1 between pieces and documents."""
    held, n = [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            own = words_of(text)
            ids = words.ids(lang)
            held.append(np.fromiter(map(ids.__getitem__, own), np.int64, len(own)))
            held.append(np.array([-1]))
            n += len(own) + 1
            if n >= words.sizes.buffer or words.full():
                yield np.concatenate(held)
                held, n = [], 0
                if words.full():
                    words.forget()
    if held:
        yield np.concatenate(held)


def _emit(words: _Words, columns: list[np.ndarray], counts: np.ndarray, size: int = 50_000) -> Iterator[pa.RecordBatch]:
    """Rows of languages, space-joined phrases and counts from columns of word ids; texts are made a part at a time."""
    table, langs = pa.array(words.words, pa.binary()), pa.array(words.langs, pa.string())
    for at in range(0, len(counts), size):
        ids = [pa.array(c[at : at + size]) for c in columns]
        yield _rows(langs.take(ids[0]), pc.binary_join_element_wise(*map(table.take, ids), b" "), counts[at : at + size])


def _count_pairs(shared, batches):
    words = _Words(*shared.value)
    for run in _runs(batches, words):
        a, b = run[:-1], run[1:]
        kept = (a >= 0) & (b >= 0)
        a, b, n = tile_counts(a[kept], b[kept], words.sizes.tile)
        yield from _emit(words, [a, b], n)


def _count_triples(shared, batches):
    *table, known_keys, pair_bits = shared.value
    words, order = _Words(*table), np.argsort(known_keys)
    for run in _runs(batches, words):
        hashes = np.array(words.hashes + [0], np.uint64)  # the last for -1
        a, b = run[:-1], run[1:]
        kept = (a >= 0) & (b >= 0)
        kept[kept] = _has(pair_bits, _mix(hashes[a[kept]], hashes[b[kept]]))
        at = np.flatnonzero(kept[:-1] & kept[1:])
        keys = (a[at] << SIDE) | b[at]
        spot = np.minimum(np.searchsorted(known_keys[order], keys), max(len(order) - 1, 0))
        hit = known_keys[order][spot] == keys if len(order) else np.zeros(len(keys), bool)
        own, back = np.unique(keys[~hit], return_inverse=True)
        ids = np.empty(len(keys), np.int64)
        ids[hit], ids[~hit] = order[spot[hit]] if len(order) else 0, len(order) + back
        pair, word, n = tile_counts(ids, run[at + 2], words.sizes.tile)
        back_keys = np.concatenate([known_keys, own])[pair]
        yield from _emit(words, [back_keys >> SIDE, back_keys & ((1 << SIDE) - 1), word], n)


def _pair_keys(ranked: list[tuple[str, bytes]], pairs: list[tuple[str, bytes]]) -> np.ndarray:
    """Keys of the pairs of ranked words, in order of the pairs' frequency; a key's place is the pair's id."""
    ids = {key: i for i, key in enumerate(ranked)}
    ends = (((lang, a), (lang, b)) for lang, (a, b) in ((lang, p.split(b" ")) for lang, p in pairs))
    return np.array([(ids[a] << SIDE) | ids[b] for a, b in ends if a in ids and b in ids], np.int64)


def _frequent(counted: DataFrame, name: str) -> DataFrame:
    return snapshot(counted.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST), name)


def phrases(docs: DataFrame, sizes: Sizes = SIZES) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(totals, words, pairs, triples): per lang all word occurrences, and n of each phrase of one, two, three words found
    ``LEAST`` times or more, by lang and phrase."""
    small_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))
    every = snapshot(texts.mapInArrow(lambda batches: _count_words(sizes, batches), COUNTED).groupBy("lang", "phrase").agg(F.sum("n").alias("n")), "phrases-words")
    totals = every.groupBy("lang").agg(F.sum("n").alias("total"))
    words = every.where(F.col("n") >= LEAST)
    ranked = top(words, sizes.ranked)
    table = sizes, ranked, [_hash(*w) for w in ranked], bitmap(words, sizes.bits)
    shared = context.broadcast(table)
    pairs = _frequent(texts.mapInArrow(lambda batches: _count_pairs(shared, batches), COUNTED), "phrases-pairs")
    shared_pairs = context.broadcast((*table, _pair_keys(ranked, top(pairs, sizes.ranked)), bitmap(pairs, sizes.bits)))
    triples = _frequent(texts.mapInArrow(lambda batches: _count_triples(shared_pairs, batches), COUNTED), "phrases-triples")
    return totals, words, pairs, triples


def collocations(docs: DataFrame, k: int = 2000, sizes: Sizes = SIZES) -> DataFrame:
    """Per language its ``k`` best phrases: lang, rank, phrase, a, l, r, n, score.

    Candidates are the phrases of two and three words with a >= ``LEAST``. A phrase scores floor(SCALE * a * a / (l * r)) at its
    weakest cut, the first one if equal, in decimals of 38 digits. A pair is left out if a frequent triple that holds it has
    ``COVER`` per cent of its occurrences. Texts are judged whole; a null text has no words, a null lang is ``und``, repeated rows
    count each, doc_id and further columns play no part, an empty table gives no rows. Ties go to the larger a, then the phrase first by bytes.
    """
    totals, words, pairs, triples = phrases(docs, sizes)
    piece = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    split = triples.withColumn("w", F.split("phrase", " "))
    covers = split.select("lang", F.explode(F.array(piece(1, 2), piece(2, 2))).alias("phrase"), "n")
    covers = covers.groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    left_pairs = pairs.join(covers, ["lang", "phrase"], "left").where(f"longest IS NULL OR 100 * longest < {COVER} * n")
    of_pairs = left_pairs.withColumn("w", F.split("phrase", " ")).select(
        "lang", "phrase", F.col("n").alias("a"), F.lit(1).alias("cut"), piece(1, 1).alias("first"), piece(2, 1).alias("rest")
    )
    of_triples = split.select(
        "lang", "phrase", F.col("n").alias("a"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("cut"), piece(1, c).alias("first"), piece(c + 1, 3 - c).alias("rest")) for c in (1, 2)
        ])).alias("c")
    ).select("lang", "phrase", "a", "c.*")
    parts = words.unionByName(pairs)
    side = lambda key, count: parts.select("lang", F.col("phrase").alias(key), F.col("n").alias(count))
    cuts = of_pairs.unionByName(of_triples).join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    exact = lambda c: F.col(c).cast("decimal(16,0)")
    score = F.expr(f"CAST({SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))")
    cuts = cuts.withColumn("over", score).withColumn("under", exact("l") * exact("r")).withColumn("score", F.expr("over div under"))
    weakest = F.min(F.struct("score", "cut", "a", "l", "r")).alias("c")
    scored = cuts.groupBy("lang", "phrase").agg(weakest).select("lang", "phrase", "c.score", "c.a", "c.l", "c.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


ORACLE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM lists, range(1, 4) t(k))),
f AS (SELECT lang, k, phrase, count(*) AS n FROM grams GROUP BY lang, k, phrase),
totals AS (SELECT lang, sum(n)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT c.lang, c.k, c.phrase, a, j, array_to_string(w[1:j], ' ') AS p, array_to_string(w[j + 1:], ' ') AS q
         FROM c, range(1, 3) t(j) WHERE j < c.k),
scored AS (SELECT u.lang, u.k, u.phrase, a, j, x.n AS l, y.n AS r,
                  (1000000::HUGEINT * a * a // (x.n::HUGEINT * y.n))::BIGINT AS score
           FROM cuts u JOIN f x ON x.lang = u.lang AND x.phrase = u.p JOIN f y ON y.lang = u.lang AND y.phrase = u.q),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
covers AS (SELECT lang, phrase, max(a) AS longest FROM (
             SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3)
           GROUP BY lang, phrase),
kept AS (SELECT s.* FROM weakest s LEFT JOIN covers v USING (lang, phrase) WHERE k = 3 OR longest IS NULL OR 100 * longest < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept JOIN totals t USING (lang) QUALIFY rank <= 2000
"""
