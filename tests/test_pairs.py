from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from satbill.operators import pairs

SCHEMA = "vec_id long, embedding array<double>, id string, vec int"  # further columns with names used inside


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, threshold):
    lowest: dict[tuple, int] = {}
    for i, v in rows:
        sound = i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if sound:
            key = tuple(x + 0.0 for x in v)
            lowest[key] = min(lowest.get(key, i), i)
    scaled = {i: np.asarray(v) / max(map(abs, v)) for v, i in lowest.items()}
    unit = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    ids = sorted(unit)
    return {
        (a, b) for n, a in enumerate(ids) for b in ids[n + 1:] if len(unit[a]) == len(unit[b]) and float((unit[a] * unit[b]).sum()) >= threshold
    }


def clustered(n, dim, seed, spread=0.12, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[rng.integers(groups)] + rng.normal(size=dim) * spread * rng.integers(1, 6)).tolist()) for i in range(n)]


@pytest.mark.parametrize("threshold", [0.0, 0.85, 1.0])
def test_pairs_equal_brute_force(spark, monkeypatch, threshold):
    for name, value in (("BLOCK_ROWS", 16), ("PARTY_BLOCKS", 3), ("PASSING", 4)):
        monkeypatch.setattr(pairs, name, value)
    rows = clustered(300, 6, 3)
    rows += [(1000 + i, rows[i][1]) for i in range(0, 300, 3)] + [(2000, [None] * 6), (2001, []), (2002, None), (2003, [0.0] * 6), (2004, [float("nan")] * 6)]
    rows += [(None, rows[0][1]), (2005, [1.0, 2.0]), (2006, [1.0, 2.1]), (2007, [1e200] * 6), (2008, [1e-200] * 6), (5, rows[5][1])]
    got = [(r.id_a, r.id_b) for r in pairs.near_pairs(table(spark, rows), threshold).collect()]
    assert len(got) == len(set(got))
    if threshold < 1.0:  # at 1 the last digit decides
        assert set(got) == brute(rows, threshold)
        links = {r.class_id: r.links for r in pairs.near_links(table(spark, rows), threshold).collect()}
        ends = Counter(i for pair in got for i in pair)
        assert {i: n for i, n in links.items() if n} == ends
    else:
        assert set(got) <= brute(rows, 1 - 1e-9)


def test_most_equal_rows_and_links(spark):
    rows = [(i, [1.0, 0.0, -0.0]) for i in range(2000)] + [(5000, [1.0, 0.1, 0.0]), (5001, [0.0, 1.0, 0.0])]
    df = table(spark, rows)
    found = pairs.near_pairs(df)
    assert [(r.id_a, r.id_b) for r in found.collect()] == [(0, 5000)]
    got = {r.vec_id: (r.class_id, r.links) for r in pairs.near_links(df).collect()}
    assert len(got) == 2002 and all(got[i] == (0, 1) for i in range(2000)) and got[5000] == (5000, 1) and got[5001] == (5001, 0)


def test_empty(spark):
    assert pairs.near_pairs(table(spark, []).limit(0)).count() == 0
    assert pairs.near_pairs(table(spark, [(1, None)])).count() == 0


def test_bounds_leave_few_block_pairs(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK_ROWS", 16)
    reach = math.sqrt(2 - 2 * 0.95)
    vectors = pairs._distinct(table(spark, clustered(4000, 8, 5, 0.04)), "vec_id", "embedding")
    pivots = pairs._pivots(vectors)
    blocks = pairs._blocks(pairs._homes(vectors, pivots, "bigint"), pivots, reach, "bigint").cache()
    n, left = blocks.count(), pairs.block_pairs(blocks, reach).count()
    assert blocks.agg(F.sum(F.size("ids"))).first()[0] == 4000
    assert left < n * (n + 1) / 2 * 0.2
