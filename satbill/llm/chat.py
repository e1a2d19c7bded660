"""Chat formatting: the cheapest repair of a conversation's roles, then its rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, the user first. Every turn is
kept, perhaps under another role (relabel) or as a part of the turn before it (merge); empty turns may be inserted. The
cheapest repair is a shortest path over the automaton of these rules: a turn is a 4 x 4 matrix of costs from the state
before it to the state after it, and a conversation is the product of its turns' matrices with (min, +).

As that product can be taken in parts, no conversation has to fit a task. Turns are sorted by range, cut into pieces of
``PIECE`` turns at most, and each piece is folded to one matrix. A path over the pieces' matrices names the states between
them; then every piece finds its own turns' path between its two states. Of ways of one cost the one with fewer relabels
wins, then the one whose states have the least sum of hashes of the turns: so one way is the best, wherever pieces are cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from satbill.sources.snapshot import snapshot

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
NAMES = {v: k for k, v in ROLES.items()}
MERGE, INSERT, RELABEL = 1, 2, 3  # costs
PIECE = 1_024
#: A number holds cost, relabels and the sum of hashes; those of a piece fit 64 bits, those of conversations are wide ones.
HASH, RELABELS, WIDE = 36, 11, 60
FAR, FAR_WIDE = 1 << 60, 1 << 240
#: From state to state: the empty turns that have to stand between, or none at all. Missing pairs are not legal.
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,), (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (ASSISTANT, USER): (), (USER, USER): (ASSISTANT,), (ASSISTANT, ASSISTANT): (USER,),
}
LAST = {START: (USER,), SYSTEM: (USER,), USER: (), ASSISTANT: ()}  # empty turns that make an end legal
OPEN, CLOSE, JOIN = "<|im_start|>", "<|im_end|>\n", "\n\n"


def step(role: str | None) -> list[list[tuple[int, str]]]:
    """Cost and kind of the cheapest way to take a turn of ``role`` from each state to each; a merge wins ties."""
    own = ROLES.get(role)
    table = [[(FAR, "")] * 4 for _ in range(4)]
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            label = 0 if own == b else RELABEL
            ways = [(label + MERGE, "merge")] if a == b else []
            if (a, b) in BETWEEN:
                ways.append((label + INSERT * len(BETWEEN[a, b]), "turn"))
            if ways:
                table[a][b] = min(ways, key=lambda w: w[0])
    return table


STEPS = {role: step(role) for role in (*ROLES, None)}


def number(cost: int, relabels: int, wide: bool) -> int:
    if cost >= FAR:
        return FAR_WIDE if wide else FAR
    return ((cost << WIDE) + relabels) << WIDE if wide else ((cost << RELABELS) + relabels) << HASH


def widened(x: int) -> int:
    return FAR_WIDE if x >= FAR else number(x >> HASH + RELABELS, x >> HASH & (1 << RELABELS) - 1, True) + (x & (1 << HASH) - 1)


def _table(role: str | None, wide: bool) -> list[list[int]]:
    return [[number(c, int(b != ROLES.get(role)), wide) for b, (c, _) in enumerate(line)] for line in STEPS[role]]


COSTS = {role: np.array(_table(role, False)) for role in STEPS}
WIDE_COSTS = {role: _table(role, True) for role in STEPS}


def weights(turn: dict) -> list[int]:
    """A hash of the turn for each state after it; ``nth`` tells equal turns apart."""
    key = f"{turn['turn']}|{turn['role']}|{turn['nth']}|{turn['text']}".encode()
    return [int(x) >> 6 for x in np.frombuffer(xxhash.xxh3_128_digest(key), "<u4")]


def fold(turns: list[dict]) -> np.ndarray:
    """The matrix of a run of turns (``PIECE`` at most): (min, +) product of their matrices."""
    whole = np.where(np.eye(4, dtype=bool), 0, FAR)
    for turn in turns:
        own = COSTS[turn["role"] if turn["role"] in ROLES else None] + np.array(weights(turn))
        whole = np.minimum((whole[:, :, None] + own[None, :, :]).min(axis=1), FAR)
    return whole


def path(matrices: list[list[list[int]]], entry: int, end_costs: list[int], hashes: list[list[int]] | None = None) -> list[int]:
    """The states after each matrix on the cheapest way from ``entry``; ``hashes`` are added by the state after the matrix."""
    ways = [[0 if s == entry else FAR_WIDE for s in range(4)]]
    for i, m in enumerate(matrices):
        more = hashes[i] if hashes else (0, 0, 0, 0)
        ways.append([min(ways[-1][a] + m[a][b] for a in range(4)) + more[b] for b in range(4)])
    state = min(range(4), key=lambda s: ways[-1][s] + end_costs[s])
    states = [state]
    for i in range(len(matrices) - 1, 0, -1):
        state = min(range(4), key=lambda s: ways[i][s] + matrices[i][s][state])
        states.append(state)
    return states[::-1] if matrices else []


def _pieces(batches):
    """Runs of turns of one conversation, in the sorted order of the task."""
    part = TaskContext.get().partitionId()
    conv, chunk, held, last, nth = object(), -1, [], None, 0

    def row():
        cost = fold(held).ravel().tolist()
        values = [conv, part, chunk, held, cost]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("nth", pa.int64())])), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["conv_id", "part", "chunk", "turns", "cost"])

    rows: list[pa.RecordBatch] = []
    for batch in batches:
        for key, *turn in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True):
            if held and (key != conv or len(held) == PIECE):
                rows.append(row())
                held = []
            chunk, conv = chunk + 1 if not held else chunk, key
            nth, last = nth + 1 if last == (key, *turn) else 0, (key, *turn)
            held.append(dict(zip(("turn", "role", "text", "nth"), (*turn, nth), strict=True)))
        if rows:
            yield pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            rows = []
    if held:
        yield row()


def _states(batches):
    """Entry and exit of every piece; a conversation's pieces follow each other in order."""
    conv, held = None, []
    out: list[tuple] = []

    def close():
        ends = [number(INSERT * len(LAST[s]), 0, True) for s in range(4)]
        states = path([[[widened(x) for x in c[a : a + 4]] for a in (0, 4, 8, 12)] for _, _, c, _ in held], START, ends)
        place = 0
        for i, (part, chunk, _, n) in enumerate(held):
            out.append((conv, part, chunk, states[i - 1] if i else START, states[i], place, i == len(held) - 1))
            place += n

    def flush():
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays(
            [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["state_conv", "part", "chunk", "entry", "exit", "before", "is_last"]
        )

    for batch in batches:
        for key, part, chunk, cost, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "chunk", "cost", "n")), strict=True):
            if held and key != conv:
                close()
                held = []
            conv = key
            held.append((part, chunk, cost, n))
        if len(out) > 10_000:
            yield flush()
            out.clear()
    if held:
        close()
    yield flush()


def _safe(text: str | None) -> str:
    """The text, with a blank put into markers that it holds itself."""
    return (text or "").replace("<|im_start|>", "<| im_start|>").replace("<|im_end|>", "<| im_end|>")


def _render(batches):
    fields = ["conv_id", "place", "turn", "role", "new_role", "action", "inserted", "rendered"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string()]
    for batch in batches:
        for piece in batch.to_pylist():
            turns, state = piece["turns"], piece["entry"]
            ends = [0 if s == piece["exit"] else FAR_WIDE for s in range(4)]
            costs = [WIDE_COSTS[t["role"] if t["role"] in ROLES else None] for t in turns]
            states = path(costs, state, ends, [weights(t) for t in turns])
            rows = []
            for i, (t, after) in enumerate(zip(turns, states, strict=True)):
                kind = STEPS[t["role"] if t["role"] in ROLES else None][state][after][1]
                added = () if kind == "merge" else BETWEEN[state, after]
                shown = JOIN if kind == "merge" else (CLOSE if state != START else "") + _empty(added) + f"{OPEN}{NAMES[after]}\n"
                shown += _safe(t["text"])
                if piece["is_last"] and i == len(turns) - 1:
                    shown += CLOSE + _empty(LAST[after])
                    added = (*added, *LAST[after])
                action = ("relabel+" if t["role"] != NAMES[after] else "") + ("merge" if kind == "merge" else "keep")
                rows.append((piece["conv_id"], piece["before"] + i + 1, t["turn"], t["role"], NAMES[after], action, ",".join(NAMES[a] for a in added), shown))
                state = after
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], fields)


def _empty(roles) -> str:
    return "".join(f"{OPEN}{NAMES[r]}\n{CLOSE}" for r in roles)


def repaired(turns: DataFrame) -> DataFrame:
    """A row per turn: conv_id, place (from 1), turn, role, new_role, action, inserted, rendered.

    ``rendered`` pieces in order of ``place`` give the repaired conversation as text; ``inserted`` lists the empty turns
    among them. Turns follow each other by turn (null first), then role and text, so repeated rows stand side by side and
    merge; the result does not depend on how Spark deals the rows. Null and unknown roles are relabelled, null texts are empty, rows without a conv_id are one conversation. A conversation
    may end with the user's turn. An empty table gives no rows; further columns are left out.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    rows = rows.withColumn("head", F.substring("text", 1, 32))  # ranges by the head agree with the order of whole texts
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = rows.repartitionByRange(n, "conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "text")
    turn = T.StructType().add("turn", "long").add("role", "string").add("text", "string").add("nth", "long")
    schema = T.StructType().add("conv_id", "long").add("part", "integer").add("chunk", "integer")
    schema = schema.add("turns", T.ArrayType(turn)).add("cost", T.ArrayType(T.LongType()))
    pieces = snapshot(sorted_.select("conv_id", "turn", "role", "text").mapInArrow(_pieces, schema), "chat-pieces")
    costs = pieces.select("conv_id", "part", "chunk", "cost", F.size("turns").cast("long").alias("n"))
    states = costs.repartition("conv_id").sortWithinPartitions("conv_id", "part", "chunk").mapInArrow(
        _states, "state_conv long, part int, chunk int, entry int, exit int, before long, is_last boolean"
    )
    both = pieces.select("conv_id", "part", "chunk", "turns").join(snapshot(states, "chat-states"), ["part", "chunk"])
    both = both.select("conv_id", "turns", "entry", "exit", "before", "is_last")  # part and chunk name one piece
    return both.mapInArrow(
        _render, "conv_id long, place long, turn long, role string, new_role string, action string, inserted string, rendered string"
    )
