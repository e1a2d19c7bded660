"""Language identification: sparse multinomial logistic regression on TF-IDF of hashed character n-grams.

A text in lower case, with every run of other characters than letters as one blank, gives its grams of one to three
characters, each hashed to one of 2**BITS numbers. A gram weighs its share of the text's grams times its inverse document
frequency, which counts every document that may teach. Training follows the regularised leader with an elastic-net
penalty; a temperature fitted on documents kept back from training calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satbill.llm.batches import small_batches

BITS, ORDERS = 16, 3
MAX_ROWS = 8_192  # documents the model is fitted on, those of the lowest hashed doc_id; a fifth of them calibrates
SCALE = 20.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.5, 0.1, 3
SLICE = 400_000  # characters handled at once; a longer text is handled by itself
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def _grams(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's place, how many, whether each has a letter, and of each gram the text and number."""
    letter, start = _letters(), 0
    while start < len(texts):
        parts, n, end = [], 0, start
        while end < len(texts) and (n < SLICE or end == start):
            parts.append(f" {(texts[end] or '').lower()} ")
            n, end = n + len(parts[-1]), end + 1
        owner = np.repeat(np.arange(end - start), [len(p) for p in parts])
        codes = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)
        is_letter = letter[codes]
        kept = np.concatenate([[True], is_letter[1:] | is_letter[:-1] | (owner[1:] != owner[:-1])])
        kept[1:] &= is_letter[1:] | is_letter[:-1] | (owner[1:] != owner[:-1])
        codes, owner = np.where(is_letter, codes, 32)[kept].astype(np.uint64), owner[kept]
        known = np.bincount(owner[codes != 32], minlength=end - start) > 0
        grams, owners, key = [], [], np.zeros(len(codes), np.uint64)
        for order in range(1, ORDERS + 1):
            key = key[: len(codes) - order + 1] * np.uint64(0x100000001B3) + codes[order - 1 :] + np.uint64(1)
            mixed = (key ^ (key >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(order)
            within = owner[: len(key)] == owner[order - 1 :]
            grams.append(((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS))[within].astype(np.int64))
            owners.append(owner[: len(key)][within])
        yield start, end - start, known, np.concatenate(owners), np.concatenate(grams)
        start = end


def _frequencies(batches):
    """How many texts of the task have each gram, and how many texts there are (as number -1)."""
    counts, n, seen = np.zeros(1 << BITS, np.int64), 0, np.zeros(1 << BITS, bool)
    for batch in batches:
        for _, count, _, owner, gram in _grams(batch.column("text").to_pylist()):
            order = np.argsort(owner, kind="stable")
            for own in np.split(gram[order], np.cumsum(np.bincount(owner, minlength=count))[:-1]):
                seen[own] = True
                counts += seen
                seen[own] = False
            n += count
    some = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(counts[some], n))], ["gram", "n"])


def _counted(batches):
    for batch in batches:
        keys, langs = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        for first, count, known, owner, gram in _grams(batch.column("text").to_pylist()):
            pairs, times = np.unique((owner << BITS) | gram, return_counts=True)
            cuts = np.searchsorted(pairs >> BITS, np.arange(1, count))
            grams, counts = np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), cuts), np.split(times.astype(np.int32), cuts)
            told = np.flatnonzero(known)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[first + i] for i in told], pa.int64()), pa.array([langs[first + i] for i in told], pa.string()),
                    pa.array([grams[i] for i in told], pa.list_(pa.int32())), pa.array([counts[i] for i in told], pa.list_(pa.int32())),
                ],
                ["doc_id", "lang", "grams", "counts"],
            )


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights (2**BITS x classes) and biases from rows of (grams, values, class)."""
    z, n = np.zeros(((1 << BITS) + 1, classes)), np.zeros(((1 << BITS) + 1, classes))

    def weights(at, penalty):
        return -np.sign(z[at]) * np.maximum(np.abs(z[at]) - L1 * penalty, 0) / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * penalty)

    bias = np.array([1 << BITS])
    for _ in range(EPOCHS):
        for grams, values, y in rows:
            w, b = weights(grams, 1.0), weights(bias, 0.0)
            logits = values @ w + b[0]
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[y] -= 1.0
            for at, w_at, g in ((grams, w, np.outer(values, p)), (bias, b, p[None, :])):
                root = np.sqrt(n[at] + g * g)
                z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w_at
                n[at] += g * g
    return weights(np.arange(1 << BITS), 1.0), weights(bias, 0.0)[0]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits that makes the labels likeliest, by a search over a fine grid."""
    if not len(y):
        return 1.0

    def loss(t):
        x = logits / t
        top = x.max(axis=1, keepdims=True)
        return float((np.log(np.exp(x - top).sum(axis=1)) + top[:, 0] - x[np.arange(len(y)), y]).mean())

    return min(np.exp(np.linspace(np.log(0.05), np.log(20), 241)).tolist(), key=loss)


def _fit(idf: np.ndarray, batches):
    rows = []
    for batch in batches:
        columns = batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist()
        lists = ((x.values.to_numpy() for x in batch.column(c)) for c in ("grams", "counts"))
        for key, lang, grams, counts in zip(*columns, *lists, strict=True):
            rows.append((xxhash.xxh64_intdigest(str(key), 1), lang, np.array(grams, np.int32), (SCALE * counts / counts.sum() * idf[grams]).astype(np.float32)))
    rows.sort(key=lambda r: (r[0], r[1], r[2].tobytes()))  # one order, however the rows arrived
    langs = sorted({r[1] for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    data = [(grams, values, number[lang]) for _, lang, grams, values in rows]
    back = data[::5] if len(data) >= 50 else []
    train = [r for i, r in enumerate(data) if i % 5] if back else data
    w, b = ftrl(train, len(langs)) if langs else (np.zeros((1 << BITS, 0)), np.zeros(0))
    logits = np.array([v @ w[g] + b for g, v, _ in back]).reshape(len(back), len(langs))
    t = temperature(logits, np.array([y for _, _, y in back], np.int64))
    used = np.flatnonzero(np.abs(w).sum(axis=1)) if langs else np.zeros(0, np.int64)
    table = w[used] * idf[used, None] * SCALE / t
    kinds = [pa.list_(pa.string()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    values = [langs, (b / t).tolist(), used.tolist(), table.ravel().tolist()]
    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["langs", "bias", "grams", "weights"])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """log((1 + texts) / (1 + texts with the gram)) + 1 of each of the 2**BITS grams, over all rows."""
    counted = docs.select("text").mapInArrow(_frequencies, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counts, total = np.zeros(1 << BITS), 0
    for gram, n in counted.collect():
        if gram < 0:
            total = n
        else:
            counts[gram] = n
    return np.log((1 + total) / (1 + counts)) + 1


def fitted(docs: DataFrame, learn) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, biases and weights per gram, from documents with a lang whose doc_id meets the condition ``learn``.

    Document frequencies count all of those; the weights are fitted on ``MAX_ROWS`` of them. Null texts, texts without
    letters, and null ids teach nothing. What reaches the driver has at most 2**BITS entries per language.
    """
    small_batches(docs.sparkSession)
    told = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & learn(F.col("doc_id")))
    idf = inverse_frequencies(told)
    sample = told.select(F.col("doc_id").alias("told")).distinct().orderBy(F.xxhash64(F.col("told").cast("string")), "told").limit(MAX_ROWS)
    rows = told.join(F.broadcast(sample), F.col("doc_id") == F.col("told"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").mapInArrow(
        _counted, "doc_id long, lang string, grams array<int>, counts array<int>"
    )
    (model,) = rows.repartition(1).mapInArrow(
        lambda batches: _fit(idf, batches), "langs array<string>, bias array<double>, grams array<int>, weights array<double>"
    ).collect()
    weights = np.zeros((1 << BITS, len(model["langs"])), np.float32)
    weights[np.array(model["grams"], np.int64)] = np.array(model["weights"]).reshape(-1, len(model["langs"]) or 1)[:, : len(model["langs"])]
    return model["langs"], np.array(model["bias"]), weights


def predicted(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, lang_pred and score, its calibrated probability, of every whole text.

    A text that is null or has no letter, and every text where nothing was learned, is ``und`` with score 0. Ties go to the
    language first by code point. Repeated rows and null ids are predicted like others; further columns are left out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs, bias, weights = shared.value
        names = np.array([*langs, UNKNOWN], object)
        for batch in batches:
            best, score = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
            for first, count, known, owner, gram in _grams(batch.column("text").to_pylist()) if langs else ():
                sums = np.stack([np.bincount(owner, weights[gram, c], count) for c in range(len(langs))], axis=1)
                x = sums / np.maximum(np.bincount(owner, minlength=count), 1)[:, None] + bias
                p = np.exp(x - x.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best[first : first + count] = np.where(known, p.argmax(axis=1), len(langs))
                score[first : first + count] = np.where(known, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names[best].tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"]
            )

    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(run, schema)
