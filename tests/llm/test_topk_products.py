"""Operator 3: pairs the bounds cannot rule out cost one matrix product, and few of them are ranked."""

from __future__ import annotations

import numpy as np
import pytest

from satbill.llm import topk


def brute(q_ids, q, v_ids, v, k):
    rows = set()
    for name, a in zip(q_ids.tolist(), q.tolist(), strict=True):
        scored = [(-sum(int(x) * int(y) for x, y in zip(a, b, strict=True)), i) for i, b in zip(v_ids.tolist(), v.tolist(), strict=True) if i != name]
        rows |= {(name, i, -s) for s, i in sorted(scored)[:k]}
    return rows


@pytest.mark.parametrize("top", [3, 200, 2**28])
def test_bounds_that_rule_out_nothing(monkeypatch, top):
    rng = np.random.default_rng(7)
    v = rng.integers(-top, top + 1, (300, 64)).astype(float)
    v[40:60] = v[40]  # ties
    ids = rng.permutation(300)
    ranked = []
    first_k = topk._first_k
    monkeypatch.setattr(topk, "_first_k", lambda rows, *rest: ranked.append(len(rows)) or first_k(rows, *rest))
    found = topk.block_best(ids[:130], v[:130], ids, v, 5)
    assert {(int(n), int(i), int(s)) for part in found for n, i, s in zip(*part, strict=True)} == brute(ids[:130], v[:130], ids, v, 5)
    if top == 200:
        assert sum(ranked) < 130 * 30  # 5 each and their ties, not all 299


def test_fewer_vectors_than_asked_for():
    ids, v = np.arange(3), np.array([[1.0], [2.0], [-1.0]])
    found = topk.block_best(ids, v, ids, v, 5)
    assert {(int(n), int(i), int(s)) for part in found for n, i, s in zip(*part, strict=True)} == brute(ids, v, ids, v, 5)
