from __future__ import annotations

import random
import re
from itertools import permutations

import pytest

from satbill.llm import audit

LABELS = "doc_id long, quality int, toxic int"


def plain(rows, labels):
    """Applies every order of the filters document by document."""
    low = {}
    for key, text, _, _, _ in rows:
        if key is not None:
            low[text or ""] = min(key, low.get(text or "", key))
    docs = []
    for key, text, _, source, _ in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)), "E": key is not None and key > low[t],
        }
        good = any(k == key and q == 1 for k, q, _ in labels if k is not None)
        toxic = any(k == key and x == 1 for k, _, x in labels if k is not None)
        docs.append((source or "", fails, good, toxic))
    out = {}
    for part in {d[0] for d in docs}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left, earlier = [d for d in docs if d[0] == part], []
            for step, f in enumerate(order, 1):
                here = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                alone = sum(d[1][f] and sum(d[1].values()) == 1 for d in docs if d[0] == part)
                out[part, "".join(order), step] = [len(left), len(here), sum(d[1][f] for d in earlier), alone, sum(d[2] for d in here), sum(d[3] for d in here)]
                shapley[f] += len(here)
                earlier += here
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return out


def check(spark, docs, rows, labels):
    from pyspark.sql import functions as F

    df = docs(rows).withColumn("mask", F.lit("clash")).withColumn("part", F.lit(1)).withColumn("low", F.lit(0))
    told = spark.createDataFrame(labels, LABELS).withColumn("good", F.lit("clash"))
    got = audit.audited(df, told).collect()
    found = {(r.part, r.filter_order, r.step): [r[c] for c in audit.COUNTS] for r in got}
    assert len(found) == len(got)
    assert found == plain(rows, labels)


def test_equals_filters_applied_in_turn(spark, docs, prose):
    rnd, rows = random.Random(3), []
    for i in range(400):
        text = prose(i, rnd.choice([0, 10, 49, 50, 51, 120]), rnd.choice([5, 400]))
        if rnd.random() < 0.3:
            text = text.upper()
        if rnd.random() < 0.2:
            text += rnd.choice("#$%&*|")
        rows.append((i, text, "en", rnd.choice(["s0", "s0", "s1", "", None]), 1))
    rows += [(1000 + i, rows[7][1], "en", "s0", 1) for i in range(150)]  # copies of one text
    rows += [(2000, None, None, None, None), (2001, "", None, "s1", None), (2002, "  é　ß " * 60, "fr", "s1", 1), (2003, "w" * 200_000, "en", "s2", 1)]
    rows += [(None, rows[7][1], None, "s0", 1), (None, rows[7][1], None, "s0", 1), rows[9], rows[9]]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 500, 2)] + [(4, None, 1), (4, 1, None), (None, 1, 1), (6, 0, 0), (6, 1, 0)]
    check(spark, docs, rows, labels)


@pytest.mark.parametrize("labels", [[], [(1, 1, 1)]])
def test_single_and_empty(spark, docs, labels):
    check(spark, docs, [(1, "one", "en", None, 1)], labels)
    assert audit.audited(docs([]), spark.createDataFrame(labels, LABELS)).count() == 0


def test_removal_step_is_the_first_failing_filter():
    steps = audit.removal_steps("ABC")
    for mask in range(8):
        for o, order in enumerate(audit.orders("ABC")):
            first = [i for i, f in enumerate(order, 1) if mask >> "ABC".index(f) & 1]
            assert steps[mask, o] == (first[0] if first else 4)
