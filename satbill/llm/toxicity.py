"""Toxicity scores by logistic regression, trained with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are the words, the pairs of neighbours, and the pairs with one word between (lower case, without outer
punctuation), each hashed to one of 2**BITS numbers and counted once. FTRL keeps a learning rate per feature and its L1
penalty leaves most weights at zero, so the model is a short list of (feature, weight).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satbill.llm.batches import small_batches

BITS = 20
MAX_ROWS = 16_384  # labelled rows the model is fitted on, those of the lowest hashed doc_id
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 5.0, 0.0, 3
SLICE = 300_000  # words handled at once


class _Words(dict):
    """Hash of each word, once while it is remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        bare = word.strip(".,;:!?\"'()[]{}<>*_-|#~`…«»„“”¡¿")
        value = self[word] = xxhash.xxh64_intdigest(bare or word)
        return value


def _features(texts: list[str | None], words: _Words) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """For runs of texts: the first one's place, how many they are, and of each feature occurrence the text (within the run) and the number."""
    start = 0
    while start < len(texts):
        hashes, owners, end, n = [], [], start, 0
        while end < len(texts) and (n < SLICE or end == start):
            own = (texts[end] or "").lower().split()
            hashes.append(np.fromiter(map(words.__getitem__, own), np.uint64, len(own)))
            owners.append(np.full(len(own), end - start, np.int64))
            n, end = n + len(own), end + 1
        h, owner = np.concatenate(hashes), np.concatenate(owners)
        parts, of = [h * np.uint64(0x9E3779B97F4A7C15)], [owner]
        for gap, left, right in ((1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (2, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
            a, b = h[:-gap], h[gap:]
            same = owner[:-gap] == owner[gap:]
            mixed = (a[same] * np.uint64(left)) ^ ((b[same] + np.uint64(gap)) * np.uint64(right))
            parts.append((mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15))
            of.append(owner[:-gap][same])
        yield start, end - start, np.concatenate(of), (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int64)
        start = end


def _rows_features(batches):
    words = _Words()
    for batch in batches:
        texts, y = batch.column("text").to_pylist(), batch.column("toxic").to_pylist()
        keys = batch.column("doc_id").to_pylist()
        for first, count, owner, feature in _features(texts, words):
            pairs = np.unique((owner << BITS) | feature)
            own = np.split((pairs & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(pairs >> BITS, np.arange(1, count)))
            last = first + count
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[first:last], pa.int64()), pa.array(y[first:last], pa.int32()), pa.array(list(own), pa.list_(pa.int32()))],
                ["doc_id", "toxic", "features"],
            )


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """Features with a weight, their weights, and the bias (an unpenalised feature of its own)."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        w[np.abs(z[at]) <= L1] = 0.0
        if len(at) and at[-1] == size:
            w[-1] = -z[size] / ((BETA + np.sqrt(n[size])) / ALPHA)
        return w

    for _ in range(epochs):
        for own, y in rows:
            at = np.append(own, size)
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            root = np.sqrt(n[at] + g * g)
            z[at] += g - (root - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    w = weights(np.arange(size + 1))
    kept = np.flatnonzero(w[:-1])
    return kept.astype(np.int32), w[kept], float(w[-1])


def _fit(batches):
    rows = [
        (key, np.array(own, np.int32), y)
        for batch in batches
        for key, y, own in zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist(), (x.values.to_numpy() for x in batch.column("features")), strict=True)
    ]
    # the order of the updates is a hash of the key, then the features, however the rows arrived
    rows.sort(key=lambda row: (xxhash.xxh64_intdigest(str(row[0]), 1), row[1].tobytes(), row[2]))
    features, weights, bias = ftrl([(own, y) for _, own, y in rows]) if rows else (np.zeros(0, np.int32), np.zeros(0), 0.0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([len(rows)], pa.int64()), pa.array([bias]), pa.array([features.tolist()], pa.list_(pa.int32())), pa.array([weights.tolist()], pa.list_(pa.float64()))],
        ["n", "bias", "features", "weights"],
    )


def fitted(docs: DataFrame, labels: DataFrame, learn) -> tuple[float, np.ndarray] | None:
    """Bias and weights, learned from ``MAX_ROWS`` labelled documents at most whose doc_id meets the condition ``learn``.

    A document labelled several times counts as toxic if one label says so; null labels and null ids teach nothing. None
    if no row teaches. The model has 2**BITS weights (4 MB) at most.
    """
    small_batches(docs.sparkSession)
    told = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & learn(F.col("doc_id")))
    told = told.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    told = told.orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(MAX_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(told.withColumnRenamed("doc_id", "told")), F.col("doc_id") == F.col("told"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").mapInArrow(
        _rows_features, "doc_id long, toxic int, features array<int>"
    )
    (model,) = rows.repartition(1).mapInArrow(_fit, "n long, bias double, features array<int>, weights array<double>").collect()
    if not model["n"]:
        return None
    weights = np.zeros(1 << BITS, np.float32)
    weights[np.array(model["features"], np.int64)] = model["weights"]
    return model["bias"], weights


def scored(docs: DataFrame, model: tuple[float, np.ndarray] | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``score``, the probability that the whole text is toxic.

    A text without words, or null, gets the model's bias alone; without a model every score is 0. Repeated rows and null
    ids are scored like others, and further columns are left out.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        words = _Words()
        for batch in batches:
            texts = batch.column("text").to_pylist()
            sums = np.zeros(len(texts))
            if shared.value is not None:
                bias, weights = shared.value
                for first, _, owner, feature in _features(texts, words):
                    heavy = np.flatnonzero(weights[feature])
                    pairs = np.unique((owner[heavy] << BITS) | feature[heavy])
                    np.add.at(sums, first + (pairs >> BITS), weights[pairs & ((1 << BITS) - 1)])
                sums = 1.0 / (1.0 + np.exp(-np.clip(sums + bias, -35, 35)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f"k{i}") for i in range(len(keep))), pa.array(sums)], [*keep, "score"])

    fields = [T.StructField(c, docs.schema[c].dataType) for c in keep]
    chosen = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], "text")
    return chosen.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))
