from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from satbill.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def some(n, dim, seed, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(10, dim))
    x = centres[rng.integers(0, 10, n)] + spread * rng.normal(size=(n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def usable(rows, nonzero):
    out = []
    for vec_id, v, _ in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v) or (nonzero and not any(v)):
            continue
        out.append((vec_id, np.array(v, np.float32).astype(np.float64)))
    return out


def plain(rows, every, k, measure, sign, nonzero):
    good, want = usable(rows, nonzero), set()
    for q_id in {q for q, _ in good if q % every == 0}:
        scores = {}
        for a, q in good:
            for b, v in good:
                if a == q_id and b != q_id and len(q) == len(v):
                    s = measure(q, v)
                    scores[b] = s if b not in scores else (min if sign > 0 else max)(scores[b], s)
        for rank, (b, s) in enumerate(sorted(scores.items(), key=lambda x: (sign * x[1], x[0]))[:k], 1):
            want.add((q_id, rank, b, s))
    return want


ODD = [
    (None, [1.0] * 8, 0), (9000, None, 0), (9050, [1.0, None] * 4, 0), (9100, [float("nan")] * 8, 0), (9150, [float("inf")] + [0.0] * 7, 0),
    (9200, [0.0] * 8, 0), (9250, [], 0), (9251, [], 0), (9300, [1.0, 2.0], 0), (9301, [2.0, 1.0], 0), (9350, [0.5] * 8, 0), (9350, [-0.5] * 8, 0),
    (9400, [0.25] * 8, 0), (9400, [0.25] * 8, 0), (9401, [0.25] * 8, 0), (9402, [0.25] * 8, 0), (9403, [0.25] * 8, 0),
]


def whole(q, v):
    return sum(math.floor(256 * a) * math.floor(256 * b) for a, b in zip(q.tolist(), v.tolist(), strict=True))


def test_topk_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(some(500, 8, 1))] + ODD
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("score", F.lit("clash")).withColumn("dim", F.lit(1))
    got = topk.search(df, lambda key: key % 50 == 0, 5).collect()
    assert {tuple(r) for r in got} == plain(rows, 50, 5, whole, -1, False) and len(got) == len(set(got))
    assert topk.search(df.limit(0), lambda key: key % 50 == 0, 5).count() == 0


def test_topk_of_long_vectors_and_huge_components(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(some(300, 70, 2))]
    rows += [(1000, [1e6] * 70, 0), (1001, [-1e6] * 70, 0), (1050, [3e5, -1e4] * 35, 0)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA), lambda key: key % 50 == 0, 5).collect()
    assert {tuple(r) for r in got} == plain(rows, 50, 5, whole, -1, False)


def test_bounds_hold():
    rng = np.random.default_rng(3)
    for dim in (1, 3, 16, 50):
        a, b = np.floor(rng.normal(size=(40, dim)) * 99), np.floor(rng.normal(size=(60, dim)) * 99)
        before = np.inf
        for n in (x for x in topk.LEVELS if x <= dim):
            bound = topk.statistics(a, n) @ topk.statistics(b, n).T
            assert (bound >= a @ b.T - 1e-6).all()
            assert bound.mean() <= before + 1e-9  # finer segments bound more tightly
            before = bound.mean()


def distance(q, v):
    return float(np.sqrt(((q - v) ** 2).sum()))


def test_hnsw_finds_nearly_all(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 1500)
    x = some(4000, 32, 4)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = ann.search(ann.index(df), df.where("vec_id % 100 = 0"), 10).collect()
    x = x.astype(np.float64)
    hits = 0
    for q in range(0, 4000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        near = set(np.argsort(np.where(np.arange(len(x)) == q, np.inf, d), kind="stable")[:10].tolist())
        own = [r for r in got if r.query_id == q]
        assert [r.rank for r in sorted(own, key=lambda r: (r.score, r.vec_id))] == list(range(1, 11))
        assert all(r.score == pytest.approx(d[r.vec_id], rel=1e-12) for r in own)
        hits += len(near & {r.vec_id for r in own})
    assert hits / 400 >= 0.95


def test_hnsw_of_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("node_of", F.lit("clash"))
    got = ann.search(ann.index(df), df.where("vec_id % 50 = 0"), 10)
    want = plain(ODD, 50, 10, distance, 1, True)
    assert {(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got.collect()} == {(*w[:3], round(w[3], 9)) for w in want}
    assert ann.search(ann.index(df.limit(0)), df, 10).count() == 0


def test_hnsw_of_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0], 0) for i in range(3000)] + [(5000 + i, [float(i), 1.0], 0) for i in range(50)]
    got = ann.search(ann.index(spark.createDataFrame(rows, SCHEMA)), spark.createDataFrame(rows[:301], SCHEMA).where("vec_id % 100 = 0"), 10).collect()
    for q in (0, 100, 200, 300):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert own == [(i + 1, v, 0.0) for i, v in enumerate([v for v in range(12) if v != q][:10])]


def test_topk_of_repeated_query_rows_in_one_shard(spark):
    rows = [(i, v.tolist(), 0) for i, v in enumerate(some(60, 8, 5))] + [(1000, [0.5] * 8, 0)] * 150
    rows += [(1050, v.tolist(), 0) for v in some(6, 8, 6)]
    got = topk.search(spark.createDataFrame(rows, SCHEMA).coalesce(1), lambda key: key % 50 == 0, 5).collect()
    assert {tuple(r) for r in got} == plain(rows, 50, 5, whole, -1, False) and len(got) == len(set(got))


def test_hnsw_of_repeated_vec_ids(spark):
    x = some(300, 8, 7)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] * 3  # a table appended thrice
    rows += [(1000, [0.5] * 8, 0)] * 30 + [(1001, [0.5] * 8, 0), (1002, [0.5] * 8, 0)]
    rows += [(2000, [5.0 + i / 1000] * 8, 0) for i in range(400)] + [(2001 + i, [9.0 + i] * 8, 0) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    queries = spark.createDataFrame([*rows[:300:100], rows[900], rows[932]], SCHEMA)
    got = {(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in ann.search(ann.index(df), queries, 10).collect()}
    good, want = list(dict(((i, tuple(v)), np.array(v, np.float32).astype(float)) for i, v, _ in rows).items()), set()
    for q_id, v, _ in [*rows[:300:100], rows[900], rows[932]]:
        q, near = np.array(v, np.float32).astype(float), {}
        for (i, _), c in good:
            if i != q_id:
                near[i] = min(near.get(i, np.inf), distance(q, c))
        order = sorted(near.items(), key=lambda item: (item[1], item[0]))[:10]
        want |= {(q_id, rank, i, round(d, 6)) for rank, (i, d) in enumerate(order, 1)}
    assert got == want
