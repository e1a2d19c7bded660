from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from satbill.llm import mixing


def check(rows, mixed, block=64):
    got = mixed.collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        share = left / sum(weight[s] for s in open_) if open_ else 0
        full = [s for s in open_ if weight[s] * share > 3 * sizes[s]]
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
            open_.discard(s)
    target |= {s: share * weight[s] for s in open_}
    by_target = sorted((r.size, r.source_size, r.target) for r in got)
    want = sorted((len((r[1] or "").split()), sizes[r[3]], target[r[3]]) for r in rows)
    for a, b in zip(by_target, want, strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2])
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    return got, target


def test_targets_and_taken(spark, docs, prose):
    rows = [(i, prose(i, 20 + i % 200), "en", f"s{i % 7}" if i % 11 else None, 1) for i in range(300)]
    rows += [(1000 + i, prose(i, 900), "en", "hot", 1) for i in range(150)]
    rows += [(2000, None, None, "empty", None), (2001, "", None, "s1", None), (None, "null id", None, "s1", 2), (None, "null id", None, "s1", 2)]
    df = docs(rows).withColumn("size", F.lit("clash")).withColumn("taken", F.lit(1))
    got, target = check(rows, mixing.mixed(df))
    taken = {}
    by_row = {}
    for r in got:
        by_row.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for (size, goal), parts in by_row.items():
        assert abs(sum(parts) - goal) <= 64 * (2 + size // mixing.SHARD_WORDS + len(parts) // mixing.SHARD_ROWS)
    again = mixing.mixed(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and not taken


def test_empty_tables(spark, docs):
    assert mixing.mixed(docs([(1, "a", None, None, None)]).limit(0)).count() == 0
    got = mixing.mixed(docs([(1, None, None, None, None), (2, " ", None, "a", None)])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in got) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_quotas_are_the_highest_quotients(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANKED", 20)  # narrows by counting first
    votes = [(0, i, 100 + 37 * i % 1000, float(100 + 37 * i % 1000)) for i in range(150)] + [(1, i, 500, 500.0) for i in range(40)]
    total = int(sum(v[3] for v in votes))
    df = spark.createDataFrame(votes, "source_no int, shard long, length long, votes double")
    got = {(r.source_no, r.shard): r.quota for r in mixing.quotas(df, total, 64).collect()}
    seats = sorted((-(v / (2 * j + 1)), s, k, j) for s, k, _, v in votes for j in range(40))[: (total + 32) // 64]
    want = {(s, k): 0 for s, k, _, _ in votes}
    for _, s, k, _ in seats:
        want[s, k] += 1
    assert got == want


def test_texts_of_the_mix(spark, docs, prose):
    rows = [(i, prose(i, 5 + i % 90).replace(" ", "\n", 3), "en", f"s{i % 5}", 1) for i in range(120)]
    rows += [(500, None, "en", "s1", None), (501, "", "en", "s1", 0)]
    taken = {r.doc_id: r.taken for r in mixing.mixed(docs(rows)).collect()}
    texts = mixing.taken_texts(docs(rows)).collect()
    words = {}
    for r in texts:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        own = dict((row[0], row[1]) for row in rows)[r.doc_id].split()
        part = r.text.split()
        assert any(own[i : i + len(part)] == part for i in range(len(own)))
    assert words == {k: v for k, v in taken.items() if v}
