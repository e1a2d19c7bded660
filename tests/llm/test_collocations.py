from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from satbill.llm import collocations


def plain(rows, k=2000):
    counts, total = defaultdict(Counter), Counter()
    for _, text, lang, _, _ in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for n in (1, 2, 3):
                for i in range(len(words) - n + 1):
                    counts[lang][tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        cands = {p: a for p, a in f.items() if len(p) > 1 and a >= 10}
        scored = []
        for p, a in cands.items():
            longer = [q for q in cands if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
            if any(100 * cands[q] >= 50 * a for q in longer):
                continue
            cuts = [(1_000_000 * a * a // (f[p[:c]] * f[p[c:]]), c, f[p[:c]], f[p[c:]]) for c in range(1, len(p))]
            score, _, left, right = min(cuts)
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:k], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def texts(n, seed=1):
    rnd, rows = random.Random(seed), []
    vocabulary = [f"W{i}" if i % 3 else f"é{i}" for i in range(60)]
    for i in range(n):
        words = [vocabulary[min(int(rnd.expovariate(0.15)), 59)] for _ in range(rnd.randrange(0, 60))]
        if i % 4 == 0:
            words[2:2] = ["in", "Spite", "of"]
        text = "".join(w + rnd.choice([" "] * 12 + ["\t", ", ", ".", "\n", ";\x0b", "! ", "  "]) for w in words)
        rows.append((i, text, rnd.choice(["en", "en", "fr", None, ""]), "s", 1))
    rows += [(1000, None, "en", "s", None), (1001, "", None, None, 0), (1002, " \t.,;", "de", "s", 1), (None, "a b " * 5000, "en", "s", 1)]
    rows += [rows[4]] * 9 + [(1003, "once only here", "it", "s", 1)]
    return rows


def run(docs, rows, **options):
    df = docs(rows).withColumn("phrase", F.lit(1)).withColumn("n", F.lit("clash"))
    return sorted(tuple(r) for r in collocations.collocations(df, **options).collect())


def test_equals_brute_force(docs):
    rows = texts(500)
    got = run(docs, rows)
    assert got == plain(rows) and len(got) > 300
    assert len({r[0] for r in got}) == 4 and any(r[2] == "in spite of" for r in got)


def test_small_tables_and_buffers_lead_to_the_same_rows(docs):
    rows = texts(300, 2)
    small = collocations.Sizes(ranked=7, bits=16, tile=2, buffer=400, local=5)
    assert run(docs, rows, sizes=small) == plain(rows)


@pytest.mark.parametrize("side", [1, 3, 10])
def test_tiles_count_like_a_dictionary(side):
    rng = np.random.default_rng(1)
    a, b = rng.geometric(0.05, 5000) - 1, rng.geometric(0.01, 5000) - 1
    found = collocations.tile_counts(a, b, side)
    assert {(x, y): n for x, y, n in zip(*(f.tolist() for f in found), strict=True)} == Counter(zip(a.tolist(), b.tolist(), strict=True))
    assert len(found[0]) == len(set(zip(a.tolist(), b.tolist(), strict=True)))
    assert all(len(x) == 0 for x in collocations.tile_counts(a[:0], b[:0], side))


def test_scores_stay_exact_beyond_64_bits(spark):
    a, left, right = 9 * 10**14, 95 * 10**13, 10**15 - 1
    row = spark.createDataFrame([(a, left, right)], "a long, l long, r long").selectExpr(
        f"CAST({collocations.SCALE} AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0)) div (CAST(l AS DECIMAL(16,0)) * CAST(r AS DECIMAL(16,0))) AS s"
    ).first()
    assert row.s == 1_000_000 * a * a // (left * right)


def test_empty(docs):
    assert run(docs, []) == [] and run(docs, [(1, None, None, None, None)]) == []
