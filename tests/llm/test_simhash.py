from __future__ import annotations

import random

import xxhash
from pyspark.sql import functions as F

from satbill.llm import simhash

from .conftest import edited


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{row: smallest doc_id reachable} by comparing all fingerprints."""
    fps = sorted({fp for _, fp in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    ids = {}
    for doc, fp in rows:
        if doc is not None:
            ids[find(fp)] = min(doc, ids.get(find(fp), doc))
    return sorted((str(doc), f"{fp:016x}", str(ids.get(find(fp)))) for doc, fp in rows)


def check(df, rows):
    got = sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in simhash.near_duplicates(df).collect())
    assert got == plain_components([(r[0], plain_fingerprint(r[1])) for r in rows])


def test_against_brute_force(spark, docs, prose):
    texts = [prose(i, 40 + i % 60) for i in range(30)]
    for i in range(10):  # groups of exact and near copies, chains of edits
        text = prose(100 + i, 150)
        texts += [text, text.upper(), text + " "] + [text := edited(text, j, 0.01) for j in range(5)]
    texts += ["", " \t\n", None, "one", "one two three", "ONE two\tthree", "É é", "a b c d " * 500]
    random.Random(3).shuffle(texts)
    df = docs(texts).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(1))
    check(df, [(r.doc_id, r.text) for r in df.collect()])


def test_null_ids_repeats_and_empty(spark, docs, prose):
    text = prose(1, 50)
    rows = [(5, text, None, None, None), (5, text, None, None, None), (None, text, None, None, None), (None, "alone here", None, None, None), (9, None, None, None, None)]
    check(docs(rows), rows)
    assert simhash.near_duplicates(docs(rows).limit(0)).count() == 0


def test_links_of_dense_shards(spark):
    """Thousands of fingerprints within a few bits: several trees per shard; nothing is lost."""
    rnd = random.Random(4)
    centre = rnd.getrandbits(64)
    dense = {centre}
    while len(dense) < 1500:
        dense.add(centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randrange(1, 4))))
    alone = {rnd.getrandbits(64) for _ in range(500)}
    rows = [(i, fp - (1 << 64) if fp >> 63 else fp) for i, fp in enumerate(sorted(dense | alone))]
    df = spark.createDataFrame(rows, "id long, fp long")
    got = {r.node: r.root for r in simhash.components(simhash.links(df.select("fp"))).collect()}
    signed = sorted(fp - (1 << 64) if fp >> 63 else fp for fp in dense)
    assert got == {fp: signed[0] for fp in signed[1:]}


def test_components_of_long_chains(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 999), (999, 999)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {1000: 999}
    assert simhash.components(spark.createDataFrame(chain, "u long, v long").limit(0)).count() == 0


def test_tree_search_equals_scan():
    rnd = random.Random(5)
    values = [rnd.getrandbits(64) for _ in range(50)]
    values += [v ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for v in values for _ in range(3)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for q in values:
        assert sorted(tree.within(q, 4)) == [i for i, v in enumerate(values) if (v ^ q).bit_count() <= 4]
