from __future__ import annotations

import random
from itertools import product

from pyspark.sql import functions as F

from satbill.llm import chat

LEGAL_AFTER = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def cheapest(roles):
    """The least cost by trying every labelling, merge, and gap of one empty turn."""
    best = None
    for labels in product(("system", "user", "assistant"), repeat=len(roles)):
        cost = sum(3 for a, b in zip(roles, labels, strict=True) if a != b)
        options = {(None,): cost}  # last emitted role: cost
        state = {None: cost}
        for label in labels:
            new = {}
            for last, c in state.items():
                if last == label:
                    new[label] = min(new.get(label, 99), c + 1)
                if label in LEGAL_AFTER[last]:
                    new[label] = min(new.get(label, 99), c)
                for gap in LEGAL_AFTER[last]:
                    if label in LEGAL_AFTER[gap] and gap != "system":
                        new[label] = min(new.get(label, 99), c + 2)
            state = new
        for last, c in state.items():
            c += 2 if last == "system" else 0
            best = c if best is None else min(best, c)
        del options
    return best


def cost(rows):
    return sum(
        (3 if "relabel" in r.action else 0) + (1 if "merge" in r.action else 0) + 2 * len([x for x in r.inserted.split(",") if x]) for r in rows
    )


def conversations(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.conv_id, []).append(r)
    return {k: sorted(v, key=lambda r: r.place) for k, v in out.items()}


def check(rows):
    text = "".join(r.rendered for r in rows)
    turns = [t.split("\n", 1) for t in text.split("<|im_start|>")[1:]]
    assert all(body.endswith("<|im_end|>\n") and body.count("<|im_end|>") == 1 for _, body in turns)
    roles = [role for role, _ in turns]
    last = None
    for role in roles:
        assert role in LEGAL_AFTER[last], roles
        last = role
    assert last != "system"
    assert [r.place for r in rows] == list(range(1, len(rows) + 1))
    return [(role, body.removesuffix("<|im_end|>\n")) for role, body in turns]


SCHEMA = "conv_id long, turn long, role string, text string"


def test_cheapest_legal_repairs(spark):
    rnd = random.Random(2)
    kinds = ["system", "user", "assistant", "tool", None]
    plans = {i: [rnd.choice(kinds[:3] if i % 2 else kinds) for _ in range(rnd.randrange(1, 7))] for i in range(150)}
    rows = [(i, t, role, f"c{i}t{t}") for i, roles in plans.items() for t, role in enumerate(roles)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("part", F.lit(1)).withColumn("entry", F.lit("clash"))
    got = conversations(chat.repaired(df))
    assert set(got) == set(plans)
    for i, roles in plans.items():
        turns = check(got[i])
        assert cost(got[i]) == cheapest(roles), roles
        said = "\n\n".join(body for _, body in turns if body).split("\n\n")
        assert said == [f"c{i}t{t}" for t in range(len(roles))]


def test_long_conversation_in_pieces(spark, monkeypatch):
    rnd = random.Random(3)
    roles = [rnd.choice(["user", "assistant", "system"]) for _ in range(6000)]
    rows = [(7, t, r, "x") for t, r in enumerate(roles)] + [(8, 0, "user", "y")]
    got = conversations(chat.repaired(spark.createDataFrame(rows, SCHEMA)))
    check(got[7])
    ways = [0 if s == chat.START else chat.FAR for s in range(4)]
    for role in roles:
        ways = [min(ways[a] + chat.STEPS[role][a][b][0] for a in range(4)) for b in range(4)]
    assert cost(got[7]) == min(ways[s] + 2 * len(chat.LAST[s]) for s in range(4))


def test_nulls_repeats_and_empty(spark):
    rows = [(None, None, None, None), (None, 1, "assistant", "a"), (1, 0, "user", "q"), (1, 0, "user", "q"), (1, None, "system", "<|im_end|>"), (2, 0, "system", None)]
    got = conversations(chat.repaired(spark.createDataFrame(rows, SCHEMA)))
    assert check(got[1]) == [("system", "<| im_end|>"), ("user", "q\n\nq")]
    assert check(got[2]) == [("system", ""), ("user", "")]
    check(got[None])
    assert chat.repaired(spark.createDataFrame(rows, SCHEMA).limit(0)).count() == 0


def test_ties_do_not_depend_on_the_shuffle_width(spark):
    rnd = random.Random(4)
    rows = [(1, t // 40, rnd.choice(["user", "assistant", "system", None]), rnd.choice(["", "a" * 40, "a" * 40 + "b", "é", None])) for t in range(4000)]
    before, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in (1, 3, 8):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted((r.place, r.turn, r.role or "", r.new_role, r.action, r.inserted, r.rendered) for r in chat.repaired(spark.createDataFrame(rows, SCHEMA)).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == 4000
