"""Operators 3 and 6: blocks of queries and shards are dealt over a grid, none is broadcast, and a shard moves once per line."""

from __future__ import annotations

import numpy as np
import pytest

from satbill.llm import ann, topk, vectors

SCHEMA = "vec_id long, embedding array<double>"


def table(spark, n, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], SCHEMA).repartition(4)


def brute(x, ids, k, score, best):
    rows = set()
    for q in ids:
        s = score(x[q], x)
        order = sorted((i for i in range(len(x)) if i != q), key=lambda i: (best * s[i], i))[:k]
        rows |= {(q, rank, i, round(float(s[i]), 9)) for rank, i in enumerate(order, 1)}
    return rows


def whole(q, x):
    return np.floor(256 * x) @ np.floor(256 * q)


def distance(q, x):
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def got(df):
    return sorted((r.query_id, r.rank, r.vec_id, round(float(r.score), 9)) for r in df.collect())


@pytest.mark.parametrize("search", ["topk", "ann"])
def test_no_block_is_broadcast(spark, search):
    _, df = table(spark, 300)
    found = topk.search(df, lambda key: key % 50 == 0, 5) if search == "topk" else ann.search(ann.index(df), df.where("vec_id % 50 = 0"), 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan  # blocks times shards would pass the driver


@pytest.mark.parametrize("held", [1, 700, 1 << 20])
def test_any_grid_gives_the_same_rows(spark, monkeypatch, held):
    monkeypatch.setattr(vectors, "HELD", held)
    monkeypatch.setattr(vectors, "SPAN", 1)
    monkeypatch.setattr(topk, "BLOCK", 32)
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "SHARD", 40)
    x, df = table(spark, 200)
    ids = range(0, 200, 5)
    assert got(topk.search(df, lambda key: key % 5 == 0, 5)) == sorted(brute(x, ids, 5, whole, -1))
    assert got(ann.search(ann.index(df), df.where("vec_id % 5 = 0"), 5)) == sorted(brute(x, ids, 5, distance, 1))


def test_a_shard_moves_once_per_line(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SPAN", 2)
    _, df = table(spark, 400)
    queries, shards = vectors.packed(df.where("vec_id < 40").repartition(4), 10).persist(), vectors.packed(df, 20).persist()
    n, m = queries.count(), shards.count()
    size = sum(len(r.ids) + len(r.cells) for r in queries.collect())
    monkeypatch.setattr(vectors, "HELD", size // 2 + 1)
    lines, columns = vectors.grid(queries, shards)
    assert lines == 2 and columns == -(-m // max(2, -(-n // 2)))

    def seen(held, row):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([len(held)]), pa.array([len(row["ids"]) // 8])], ["blocks", "vectors"])

    rows = vectors.meet(queries, shards, ["ids", "cells"], seen, "blocks long, vectors long").collect()
    assert len(rows) <= m * lines and sum(r.blocks for r in rows) == n * m  # every pair, and no row per pair


def test_k_th_best_is_carried_to_the_next_shard(monkeypatch):
    rng = np.random.default_rng(3)
    q, near, far = (np.floor(256 * rng.normal(size=(50, 16))) for _ in range(3))
    known, measured = np.full(50, -np.inf), []
    first_k = topk._first_k
    monkeypatch.setattr(topk, "_first_k", lambda rows, *rest: measured.append(len(rows)) or first_k(rows, *rest))
    list(topk.block_best(np.arange(50), q, np.arange(100, 150), near, 5, known))
    assert sum(measured) == 250 and np.isfinite(known).all()
    list(topk.block_best(np.arange(50), q, np.arange(200, 250), far, 5, known))
    assert sum(measured) < 500  # only what beats or equals the k-th best so far
    best = np.sort(q @ near.T, axis=1)[:, -5]
    assert (known >= best).all()


def test_packing_keeps_every_number():
    for cells in (np.array([[0.5, -0.0, 1e30]]), np.array([[0.1, 1e300, 5e-324]]), np.zeros((3, 0)), np.array([[1e-46, 1.0]])):
        back = vectors.from_bytes(vectors.to_bytes(cells), *cells.shape)
        assert back.shape == cells.shape and back.tobytes() == cells.tobytes()
