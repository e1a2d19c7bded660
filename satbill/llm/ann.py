"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, in flat neighbour arrays.

Vectors are indexed in shards of ``SHARD`` rows at most. In a shard, equal vectors are one node. A node's level falls off
geometrically by a hash of its vector; on each level up to its own it is linked to the nearest nodes put in before it,
chosen so that they lie in different directions, and those link back. The candidates of a node are found by exact
distances within the shard, block by block, which costs less in arrays than walking the growing graph. An index row holds
the nodes, their vectors, and per level an array of neighbours padded with -1. A search walks all queries of a block at
once: greedily down the upper levels, then with a beam on the lowest. The shards' results are merged.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from satbill.llm.vectors import best, blocks, from_bytes, meet, packed, sound, to_bytes
from satbill.sources.snapshot import snapshot

SHARD, BLOCK = 4_096, 1_024
LINKS, CANDIDATES = 16, 48  # links per node and level (twice on the lowest), nearest nodes they are chosen from
BEAM, STEP = 128, 4  # nodes kept by a search, and opened at a time


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances, by the scalar product."""
    return np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * a @ b.T, 0.0)


def _spread(near: np.ndarray, distance: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of ``near``, nearest first, those nearer to the node than to any chosen before; then the nearest others up to ``most``."""
    among = squares(x[near], x[near])
    chosen, left = [], []
    closest = np.full(len(near), np.inf)  # to what is chosen
    for i in range(len(near)):
        if len(chosen) < most and distance[i] < closest[i]:
            chosen.append(i)
            closest = np.minimum(closest, among[i])
        else:
            left.append(i)
    return near[(chosen + left)[:most]]


def build(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Neighbour arrays per level, lowest first, of the distinct vectors ``x``, and the order of the nodes among them.

    The nodes of the upper levels come first, so a level's nodes are the first ones and node 0 enters the graph.
    """
    n = len(x)
    numbers = np.array([xxhash.xxh64_intdigest(row.tobytes()) + 1 for row in x], np.float64) / 2.0**64
    level = np.floor(-np.log(numbers) / np.log(LINKS)).astype(int)
    order = np.argsort(-level, kind="stable")
    level, x = level[order], x[order]
    layers = []
    for lev in range(int(level.max(initial=0)) + 1):
        size = int((level >= lev).sum())
        most = LINKS * 2 if lev == 0 else LINKS
        links: list[list[int]] = [[] for _ in range(size)]
        for at in range(0, size, 512):
            end = min(at + 512, size)
            square = squares(x[at:end], x[:end])
            for i in range(at, end):
                if not i:
                    continue
                d = square[i - at, :i]
                few = min(CANDIDATES, i)
                near = np.argpartition(d, few - 1)[:few]
                near = near[np.argsort(d[near], kind="stable")]
                links[i] = _spread(near, d[near], x, LINKS).tolist()
                for j in links[i]:
                    links[j].append(i)
                    if len(links[j]) >= most * 3 // 2:
                        links[j] = _nearest(j, links[j], x, most)
        table = np.full((size, most), -1, np.int32)
        for i, own in enumerate(links):
            own = own if len(own) <= most else _nearest(i, own, x, most)
            table[i, : len(own)] = own
        layers.append(table)
    return layers, order


def _nearest(i: int, own: list[int], x: np.ndarray, most: int) -> list[int]:
    near = np.array(own)
    d = squares(x[i : i + 1], x[near])[0]
    order = np.argsort(d, kind="stable")
    return _spread(near[order], d[order], x, most).tolist()


def walk(x: np.ndarray, layers: list[np.ndarray], queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """For each query the nodes of its beam, -1 where it has fewer."""
    n, rows = len(x), np.arange(len(queries))
    far = lambda q, nodes: ((x[nodes] - queries[q][:, None, :]) ** 2).sum(axis=2)
    at = np.zeros(len(queries), np.int64)
    here = far(rows, at[:, None])[:, 0]
    for table in layers[:0:-1]:
        todo = rows
        while len(todo):
            nodes = table[at[todo]].astype(np.int64)
            d = np.where(nodes >= 0, far(todo, nodes), np.inf)
            first = d.argmin(axis=1)
            step = d[np.arange(len(todo)), first]
            better = step < here[todo]
            at[todo[better]] = nodes[np.flatnonzero(better), first[better]]
            here[todo[better]] = step[better]
            todo = todo[better]
    beam = min(beam, n)
    ids, dist = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), np.inf)
    opened, seen = np.zeros((len(queries), beam), bool), np.zeros((len(queries), n + 1), bool)
    seen[:, n] = True  # the place of padding
    ids[:, 0], dist[:, 0] = at, here
    seen[rows, at] = True
    todo = rows
    while len(todo):
        open_ = ~opened[todo] & (ids[todo] >= 0)
        todo, open_ = todo[open_.any(axis=1)], open_[open_.any(axis=1)]
        if not len(todo):
            break
        place = np.argsort(~open_, axis=1, kind="stable")[:, :STEP]  # the nearest unopened ones: the beam is sorted
        valid = np.take_along_axis(open_, place, axis=1)
        centre = np.where(valid, np.take_along_axis(ids[todo], place, axis=1), -1)
        opened[todo[:, None], place] = True
        nodes = np.where(centre[:, :, None] >= 0, layers[0][centre], -1).reshape(len(todo), -1)
        nodes = np.sort(np.where(nodes >= 0, nodes, n), axis=1)
        fresh = ~seen[todo[:, None], nodes]
        fresh[:, 1:] &= nodes[:, 1:] != nodes[:, :-1]
        seen[todo[:, None], nodes] = True
        q, column = np.nonzero(fresh)
        d = np.full(nodes.shape, np.inf)
        d[q, column] = ((x[nodes[q, column]] - queries[todo[q]]) ** 2).sum(axis=1)
        all_d = np.concatenate([dist[todo], d], axis=1)
        all_i = np.concatenate([ids[todo], np.where(fresh, nodes, -1)], axis=1)
        all_o = np.concatenate([opened[todo], np.zeros_like(fresh)], axis=1)
        best_ = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
        dist[todo], ids[todo], opened[todo] = (np.take_along_axis(a, best_, axis=1) for a in (all_d, all_i, all_o))
    return ids


INDEX = "dim int, ids binary, node_of binary, nodes int, cells binary, levels array<binary>"


def index(vectors: DataFrame) -> DataFrame:
    """Index rows over all rows whose vec_id is not null and whose vector is neither null nor zero and finite throughout.

    Every row is indexed; an empty table gives an empty index. Further columns are left out.
    """
    def run(batches):
        for dim, ids, cells in blocks(batches, SHARD):
            order = np.lexsort(cells.T[::-1])
            new = np.concatenate([[True], (cells[order][1:] != cells[order][:-1]).any(axis=1)])
            node = np.empty(len(ids), np.int64)
            node[order] = np.cumsum(new) - 1
            x = cells[order][new]
            node, ids = np.unique(np.stack([node, ids]), axis=1)  # a vec_id once per node
            layers, order = build(x)
            place = np.empty(len(x), np.int64)
            place[order] = np.arange(len(x))
            row = [dim, ids.tobytes(), place[node].tobytes(), len(x), to_bytes(x[order]), [t.tobytes() for t in layers]]
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.list_(pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v], k) for v, k in zip(row, kinds, strict=True)], ["dim", "ids", "node_of", "nodes", "cells", "levels"]
            )

    return snapshot(sound(vectors, nonzero=True).mapInArrow(run, INDEX), "hnsw-index")


def _nearest_ids(x, queries, names, found, ids, first, k: int):
    """(query row, vec_id, distance) of each query row's k nearest vec_ids but its own on the nodes ``found``.

    ``ids`` are those of the nodes one after another, each node's differing and ascending from place ``first``.
    """
    owner, place = np.nonzero(found >= 0)
    nodes = found[owner, place]
    score = np.sqrt(((x[nodes] - queries[owner]) ** 2).sum(axis=1))
    many = np.minimum(first[nodes + 1] - first[nodes], k + 1)  # one of them may be the query's own
    rows = np.repeat(np.arange(len(nodes)), many)
    nth = np.arange(len(rows)) - np.repeat(np.cumsum(many) - many, many)
    vec, owner, score = ids[first[nodes[rows]] + nth], owner[rows], score[rows]
    other = vec != names[owner]
    vec, owner, score = vec[other], owner[other], score[other]
    sort = np.lexsort((score, vec, owner))
    vec, owner, score = vec[sort], owner[sort], score[sort]
    new = np.concatenate([[True], (vec[1:] != vec[:-1]) | (owner[1:] != owner[:-1])])[: len(vec)]  # a vec_id's least distance
    vec, owner, score = vec[new], owner[new], score[new]
    sort = np.lexsort((vec, score, owner))
    vec, owner, score = vec[sort], owner[sort], score[sort]
    _, begin, count = np.unique(owner, return_index=True, return_counts=True)
    kept = np.arange(len(owner)) - np.repeat(begin, count) < k
    return owner[kept], vec[kept], score[kept]


def _found(names, ids, scores):
    return pa.RecordBatch.from_arrays([pa.array(names), pa.array(ids), pa.array(scores)], ["query_id", "vec_id", "score"])


def search(shards: DataFrame, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found by Euclidean distance, in double precision on the given vectors.

    Rows of the index with the query's own vec_id are no candidates, nor are vectors of other dimensions. Ties go to the
    smaller vec_id; rows that share a vec_id are one item at the least of their distances. Query rows follow the rules of
    ``index``.
    """
    def found(held, row):
        ids, node = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["node_of"], np.int64)
        x = from_bytes(row["cells"], row["nodes"], row["dim"])
        layers = [np.frombuffer(t, np.int32).reshape(-1, LINKS * (2 if not i else 1)) for i, t in enumerate(row["levels"])]
        order = np.lexsort((ids, node))  # a node's ids, smallest first
        first = np.searchsorted(node[order], np.arange(len(x) + 1))
        for q_ids, q, _ in held:
            for at in range(0, len(q), 256):
                some, names = q[at : at + 256], q_ids[at : at + 256]
                near = walk(x, layers, some, max(beam, 2 * k))
                owner, vec, score = _nearest_ids(x, some, names, near, ids[order], first, k)
                yield _found(names[owner], vec, score)
                # A beam may hold the nodes of few vec_ids: such queries look at all nodes.
                short = np.flatnonzero((np.bincount(owner, minlength=len(some)) < k) & (len(x) > (near >= 0).sum(axis=1)))
                for few in np.split(short, range(16, len(short), 16)):
                    every = np.broadcast_to(np.arange(len(x)), (len(few), len(x)))
                    owner, vec, score = _nearest_ids(x, some[few], names[few], every, ids[order], first, k)
                    yield _found(names[few][owner], vec, score)

    wanted = sound(queries, nonzero=True)
    wanted = snapshot(packed(wanted.repartition(max(1, -(-wanted.count() // BLOCK))), BLOCK), "hnsw-queries")
    found_rows = meet(wanted, shards, ["ids", "node_of", "nodes", "cells", "levels"], found, "query_id long, vec_id long, score double")
    return best(found_rows, k, lowest=True)
