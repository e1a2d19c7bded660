"""Training and scores of operator 10 against plain Python, weight by weight."""

from __future__ import annotations

import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from satbill.llm import toxicity

MASK = (1 << 64) - 1
OUTER = ".,;:!?\"'()[]{}<>*_-|#~`…«»„“”¡¿"


def features(text):
    """The set of hashed words, pairs of neighbours and pairs with one word between, one at a time."""
    h = [xxhash.xxh64_intdigest(w.strip(OUTER) or w) for w in (text or "").lower().split()]
    found = {(x * 0x9E3779B97F4A7C15 & MASK) >> (64 - toxicity.BITS) for x in h}
    for gap, left, right in ((1, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), (2, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)):
        for a, b in zip(h, h[gap:]):
            x = (a * left & MASK) ^ ((b + gap & MASK) * right & MASK)
            found.add(((x ^ (x >> 31)) * 0x9E3779B97F4A7C15 & MASK) >> (64 - toxicity.BITS))
    return found


def train(rows):
    """FTRL-proximal with dictionaries: (features, label) in order, the bias without penalty."""
    z, n = {}, {}

    def weight(i):
        zi, rate = z.get(i, 0.0), (toxicity.BETA + math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
        if i == "bias":
            return -zi / rate
        return 0.0 if abs(zi) <= toxicity.L1 else -(zi - math.copysign(toxicity.L1, zi)) / (rate + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for own, y in rows:
            w = {i: weight(i) for i in [*own, "bias"]}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for i, wi in w.items():
                old = n.get(i, 0.0)
                n[i] = old + g * g
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n[i]) - math.sqrt(old)) / toxicity.ALPHA * wi
    return {i: weight(i) for i in z}


def test_weights_and_scores_equal_plain_python(spark, docs, prose):
    rows = [(i, prose(i, 15 + i % 40) + (" You utter, FOOL (idiot)!" if i % 3 == 0 else " kind regards"), "en", "s", 1) for i in range(300)]
    rows += [(400, None, "en", "s", 1), (401, "", "en", "s", 1)]
    df = docs(rows)
    labels = spark.createDataFrame([(r[0], int(r[0] % 3 == 0)) for r in rows], "doc_id long, toxic int")
    bias, weights = toxicity.fitted(df, labels, lambda key: key % 4 != 2)

    taught = [(r[0], features(r[1]), int(r[0] % 3 == 0)) for r in rows if r[0] % 4 != 2]
    taught.sort(key=lambda t: xxhash.xxh64_intdigest(str(t[0]), 1))
    want = train([(own, y) for _, own, y in taught])
    assert bias == pytest.approx(want.pop("bias"), rel=1e-6)
    heavy = {i: w for i, w in want.items() if w}
    assert heavy and set(np.flatnonzero(weights).tolist()) == set(heavy)
    assert all(weights[i] == pytest.approx(w, rel=1e-4) for i, w in heavy.items())

    got = {r.doc_id: r.score for r in toxicity.scored(df, (bias, weights)).collect()}
    for r in rows:
        x = bias + sum(heavy.get(i, 0.0) for i in features(r[1]))
        assert got[r[0]] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-5)
    assert df.filter(F.col("text").isNull()).count() == 1
