"""Exact top-k by inner product of whole-number vectors, pruned by multi-resolution segment statistics.

A vector is cut into 1, 4, then 16 segments. For a segment of m components with means a, b and deviations s, t, the part
of the squared distance is at least m ((a - b)^2 + (s - t)^2), which is the same as saying that the part of the inner
product is at most m (a b + s t). From coarse to fine these bounds discard what cannot reach the k best found so far; the
survivors' inner products are computed exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from satbill.llm.vectors import best, meet, packed, sound, unpacked
from satbill.sources.snapshot import snapshot

BLOCK = 2_048  # vectors per shard and queries per block
CHUNK = 128  # queries scored at once
LEVELS = (1, 4, 16)


def statistics(cells: np.ndarray, segments: int) -> np.ndarray:
    """Per segment the mean and the deviation, times the root of its length: inner products of these bound the vectors'."""
    cuts = np.linspace(0, cells.shape[1], segments + 1).astype(int)[:-1]
    length = np.diff(np.append(cuts, cells.shape[1]))
    mean = np.add.reduceat(cells, cuts, axis=1) / length
    spread = cells - np.repeat(mean, length, axis=1)
    deviation = np.sqrt(np.add.reduceat(spread * spread, cuts, axis=1) / length)
    return np.concatenate([mean, deviation], axis=1) * np.sqrt(np.concatenate([length, length]))


def _whole(q: np.ndarray, v: np.ndarray) -> bool:
    """Whether no inner product of the rows, nor any part of one, loses a digit in double precision."""
    return np.abs(q).max(initial=0.0) * np.abs(v).max(initial=0.0) * q.shape[1] < 2**53


def exact(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; whole numbers, cut off at the range of a long."""
    if _whole(q, v):
        return np.einsum("ij,ij->i", q, v).astype(np.int64)
    sums = [sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q.tolist(), v.tolist(), strict=True)]
    return np.array([min(max(s, -(2**63)), 2**63 - 1) for s in sums], np.int64)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th best of each row, or minus infinity if it has fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), -np.inf)
    return -np.partition(-scores, k - 1, axis=1)[:, k - 1]


def block_best(q_ids, q, v_ids, v, k: int, known: np.ndarray | None = None):
    """(query id, vector id, score) of each query row's k best in the shard; the shard's ids differ from each other.

    ``known`` holds a k-th best score of each query row, in this shard or another; what stays below it is left out, and
    it is raised in place.
    """
    levels = [n for n in LEVELS if n <= v.shape[1]]  # none for vectors without components: all survive, at 0
    own = [(statistics(q, n), statistics(v, n)) for n in levels]
    scale = np.linalg.norm(q, axis=1).max(initial=0.0) * np.linalg.norm(v, axis=1).max(initial=0.0)
    slack = 1e-9 * scale + 1e-6
    known = np.full(len(q), -np.inf) if known is None else known
    out = []
    for at in range(0, len(q), CHUNK):
        some = slice(at, at + CHUNK)
        qs, names = q[some], q_ids[some]
        columns = np.arange(len(v))
        alive = names[:, None] != v_ids[None, :]
        floor = known[some].copy()
        for a, b in own:
            bound = a[some] @ b[columns].T
            alive &= bound >= floor[:, None] - slack
            kept = alive.any(axis=0)
            columns, alive, bound = columns[kept], alive[:, kept], bound[:, kept]
            if not len(columns):
                break
            bound[~alive] = -np.inf
            seeds = np.argpartition(-bound, min(4 * k, bound.shape[1]) - 1, axis=1)[:, : 4 * k]
            pairs = np.repeat(np.arange(len(qs)), seeds.shape[1]), columns[seeds.ravel()]
            scores = exact(qs[pairs[0]], v[pairs[1]]).reshape(seeds.shape).astype(np.float64)
            scores[~np.take_along_axis(alive, seeds, axis=1)] = -np.inf
            floor = np.maximum(floor, _kth(scores, k))
            alive &= bound >= floor[:, None] - slack
            kept = alive.any(axis=0)
            columns, alive = columns[kept], alive[:, kept]
            if not len(columns):
                break
        if len(columns) and _whole(qs, v[columns]):
            # one product of the rows still in question; only pairs that reach a row's k-th best are ranked
            products = qs @ v[columns].T
            products[~alive] = -np.inf
            floor = np.maximum(floor, _kth(products, k))
            alive &= products >= floor[:, None]
        known[some] = floor
        row, column = np.nonzero(alive)
        for first in range(0, len(row), 1 << 16):  # in portions, each cut to its k best per query row
            r, c = row[first : first + (1 << 16)], columns[column[first : first + (1 << 16)]]
            r, found, products = _first_k(r, v_ids[c], exact(qs[r], v[c]), k)
            out.append((names[r], found, products))
    return out


def _first_k(rows, ids, scores, k):
    order = np.lexsort((ids, ~scores, rows))  # ~x falls as x rises and never overflows
    rows, ids, scores = rows[order], ids[order], scores[order]
    new = np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)
    place = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(rows) else np.zeros(0, int)
    return rows[place < k], ids[place < k], scores[place < k]


def _without_repeats(ids: np.ndarray, cells: np.ndarray):
    """The rows in groups without an id twice; equal rows count once."""
    order = np.lexsort((*cells.T[::-1], ids))
    ids, cells = ids[order], cells[order]
    same = (ids[1:] == ids[:-1]) & (cells[1:] == cells[:-1]).all(axis=1)
    kept = np.concatenate([[True], ~same])[: len(ids)]
    ids, cells = ids[kept], cells[kept]
    new = np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)]
    turn = np.arange(len(ids)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    for t in range(int(turn.max(initial=-1)) + 1):
        yield ids[turn == t], cells[turn == t]


def search(vectors: DataFrame, is_query, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose vec_id meets ``is_query``, the k highest integer inner products.

    Components x count as floor(256 x). All rows but those of the query's own vec_id are candidates, as long as their
    dimension is the query's; ties go to the smaller vec_id. Rows with a null id, a null vector, or a component that is
    null or not finite take no part. Rows that share a vec_id are one item with the best of their scores. Further columns play no part.
    """
    def scored(held, row):
        ids, v = unpacked(row["dim"], row["ids"], row["cells"])
        for v_ids, cells in _without_repeats(ids, np.floor(256 * v)):
            for q_ids, q, notes in held:
                if not notes:
                    notes.update(whole=np.floor(256 * q), known=np.full(len(q), -np.inf))  # carried from shard to shard
                for names, found, scores in block_best(q_ids, notes["whole"], v_ids, cells, k, notes["known"]):
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    rows = sound(vectors)
    wanted = rows.where(is_query(rows["vec_id"]))
    shards = snapshot(packed(rows, BLOCK), "topk-shards")
    queries = snapshot(packed(wanted.repartition(max(1, -(-wanted.count() // BLOCK))), BLOCK), "topk-queries")
    return best(meet(queries, shards, ["ids", "cells"], scored, "query_id long, vec_id long, score long"), k, lowest=False)


ORACLE_SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, max(CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT)) AS score
  FROM whole q JOIN whole c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0 GROUP BY 1, 2),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
