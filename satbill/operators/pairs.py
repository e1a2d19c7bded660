"""All pairs of near vectors of one table: an exact threshold self-join in cells around pivots."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satbill.operators.search import _sound
from satbill.sources.snapshot import snapshot

# Functions sent to executors travel whole, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK_ROWS, BLOCK_BYTES = 2048, 16 << 20  # a block's vectors; scores of two blocks take 32 MB at most
PARTY_BLOCKS, PARTY_BYTES = 256, 32 << 20  # neighbouring blocks that a task holds while others pass by them
PASSING = 64  # blocks that pass by one copy of a party
PIVOTS, PIVOT_BYTES = 1024, 8 << 20  # pivots travel with every task
SLACK = 1e-9  # rounding of distances never loses a pair
CHECKED = 1 << 16  # pairs scored exactly at once


def _distinct(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Lowest id per distinct vector. Copies fold on the map side; zeros of either sign are one, zero vectors take no part."""
    rows = _sound(df, id_col, vec_col).select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    return rows.filter(F.exists("vec", lambda x: x != 0)).groupBy("vec").agg(F.min("id").alias("id"))


def vector_classes(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Id of every sound row that is not all zeros, and its class: the lowest id among rows with an equal vector."""
    rows = _sound(df, id_col, vec_col).select(F.col("id").alias(id_col), F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    return rows.join(_distinct(df, id_col, vec_col).withColumnRenamed("id", "class_id"), "vec").select(id_col, "class_id")


def _pivots(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Unit vectors by dimension: the rows with the lowest hashes, about the square root of all, never more than the limits."""
    rows, longest = vectors.agg(F.count(F.lit(1)), F.max(F.size("vec"))).first()
    if not rows:
        return {}
    wanted = max(1, min(PIVOTS, math.isqrt(rows), PIVOT_BYTES // (8 * longest)))
    chosen = vectors.select("vec").orderBy(F.xxhash64("id"), "id").limit(wanted).collect()
    by_dim: dict[int, list] = {}
    for (vec,) in chosen:
        by_dim.setdefault(len(vec), []).append(_unit(np.asarray([vec]))[0])
    return {dim: np.stack(some) for dim, some in by_dim.items()}


def _unit(matrix: np.ndarray) -> np.ndarray:
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)  # squares of very large or small numbers would not be finite
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _chord(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def _homes(vectors: DataFrame, pivots: dict[int, np.ndarray], kind: str) -> DataFrame:
    """Every vector with the cell of its nearest pivot and its distance from it; dimensions without a pivot are one cell."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                sizes = np.asarray(batch.column("vec").value_lengths())
                cells, starts = np.asarray(batch.column("vec").flatten()), np.cumsum(sizes) - sizes
                for dim in np.unique(sizes).tolist():
                    chosen = np.flatnonzero(sizes == dim)
                    matrix = _unit(cells[starts[chosen][:, None] + np.arange(dim)])
                    home, far = np.zeros(len(chosen), np.int32), np.zeros(len(chosen))
                    if dim in pivots:
                        near = matrix @ pivots[dim].T
                        home = near.argmax(axis=1).astype(np.int32)
                        far = _chord(near[np.arange(len(chosen)), home])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(chosen), dim, np.int32)), pa.array(home), pa.array(far), batch.column("id").take(pa.array(chosen)),
                         pa.array([row.tobytes() for row in matrix], pa.binary())],
                        ["dim", "cell", "far", "id", "unit"],
                    )

    return vectors.select("id", "vec").mapInArrow(assign, f"dim int, cell int, far double, id {kind}, unit binary")


def _blocks(homes: DataFrame, pivots: dict[int, np.ndarray], reach: float, kind: str) -> DataFrame:
    """Blocks of one cell's vectors in order of distance, and the later cells in which any of them can have a partner.

    A vector x at home with pivot p lies (x.p - x.q) / |p - q| before the plane between p and q, which no partner beyond
    that plane can undercut. ``seen`` says for such a cell q how far from q the block's vectors are that pass this test.
    The order runs over distance and id, so that a cell of any size spreads over tasks. Blocks that follow each other are
    a party, named by its first block.
    """

    def close(rows: list, party: list) -> pa.RecordBatch:
        dim, cell = rows[0][0], rows[0][1]
        matrix = np.frombuffer(b"".join(row[4] for row in rows), np.float64).reshape(-1, dim)
        seen: list[tuple[int, float, float]] = []
        if dim in pivots and cell + 1 < len(pivots[dim]):
            own, later = pivots[dim][cell], pivots[dim][cell + 1:]
            near = matrix @ later.T
            passes = (matrix @ own)[:, None] - near <= reach * np.linalg.norm(later - own, axis=1) + SLACK
            for i in np.flatnonzero(passes.any(axis=0)).tolist():
                far = _chord(near[passes[:, i], i])
                seen.append((cell + 1 + i, float(far.min()), float(far.max())))
        cells, lows, highs = (list(column) for column in zip(*seen)) if seen else ([], [], [])
        if party[0] != dim or party[2] == PARTY_BLOCKS or party[3] + matrix.nbytes > PARTY_BYTES:
            party[:] = [dim, rows[0][3], 0, 0]
        party[2:] = [party[2] + 1, party[3] + matrix.nbytes]
        ids = pa.array([row[3] for row in rows])
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([cell], pa.int32()), ids.slice(0, 1), pa.array([party[1]], ids.type), pa.array([rows[0][2]]), pa.array([rows[-1][2]]),
             pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), ids), pa.array([matrix.tobytes()], pa.binary()),
             pa.array([cells], pa.list_(pa.int32())), pa.array([lows], pa.list_(pa.float64())), pa.array([highs], pa.list_(pa.float64()))],
            ["dim", "cell", "block", "party", "low", "high", "ids", "units", "seen_cell", "seen_low", "seen_high"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        party: list = [None, None, 0, 0]  # dimension, name, blocks, bytes
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("dim", "cell", "far", "id", "unit")]):
                full = held and len(held) >= max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * row[0])))
                if held and (full or held[0][:2] != row[:2]):
                    yield close(held, party)
                    held = []
                held.append(row)
        if held:
            yield close(held, party)

    order = ["dim", "cell", "far", "id"]
    return homes.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        pack, f"dim int, cell int, block {kind}, party {kind}, low double, high double, ids array<{kind}>, units binary, "
        "seen_cell array<int>, seen_low array<double>, seen_high array<double>",
    )


def block_pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """Pairs of blocks (a, b) that can hold a near pair: same cell or one that a sees, and distances from its pivot within reach."""
    home = blocks.select("dim", "cell", F.col("block").alias("b"), F.col("low").alias("b_low"), F.col("high").alias("b_high"))
    own = blocks.select("dim", "cell", F.col("block").alias("a"), "low", "high", F.lit(True).alias("own"))
    seen = blocks.select("dim", F.col("block").alias("a"), F.explode(F.arrays_zip("seen_cell", "seen_low", "seen_high")).alias("s")).select(
        "dim", F.col("s.seen_cell").alias("cell"), "a", F.col("s.seen_low").alias("low"), F.col("s.seen_high").alias("high"), F.lit(False).alias("own")
    )
    within = (F.col("low") - reach - SLACK <= F.col("b_high")) & (F.col("b_low") - reach - SLACK <= F.col("high"))
    pairs = own.unionByName(seen).join(home, ["dim", "cell"]).filter(within & (~F.col("own") | (F.col("a") <= F.col("b"))))
    return pairs.select("dim", "a", "b")


def _meetings(blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Blocks laid out for scoring by (party, part): first the party's own, then those that pass by, with the blocks they are to meet.

    A block travels once for each party it meets something of, not once for each pair; a party is copied for every ``PASSING`` visitors.
    """
    visits = pairs.join(blocks.select(F.col("block").alias("b"), "party"), "b").groupBy("party", F.col("a").alias("block")).agg(F.collect_list("b").alias("wanted"))
    copies = visits.groupBy("party").agg(F.ceil(F.count(F.lit(1)) / PASSING).cast("int").alias("copies"))
    cells = ["dim", "block", "ids", "units"]
    passing = visits.join(copies, "party").withColumn("part", F.pmod(F.xxhash64("block"), F.col("copies")).cast("int")).join(blocks.select(*cells), "block")
    own = blocks.select("party", *cells).join(copies, "party").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    columns = ["party", "part", "visits", "wanted", *cells]
    both = own.withColumns({"visits": F.lit(False), "wanted": F.lit(None).cast(visits.schema["wanted"].dataType)}).select(*columns).unionByName(
        passing.withColumn("visits", F.lit(True)).select(*columns)
    )
    return both.repartition("party", "part").sortWithinPartitions("party", "part", "visits", "block")


def _met(df: DataFrame, threshold: float, id_col: str, vec_col: str) -> DataFrame:
    """The blocks that can hold near pairs, laid out for scoring."""
    kind = df.schema[id_col].dataType.simpleString()
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * threshold))
    vectors = snapshot(_distinct(df, id_col, vec_col), "pair-vectors")
    pivots = _pivots(vectors)
    blocks = snapshot(_blocks(_homes(vectors, pivots, kind), pivots, reach, kind), "pair-blocks")
    return _meetings(blocks, snapshot(block_pairs(blocks, reach).select("a", "b"), "block-pairs"))


def _near(one: np.ndarray, two: np.ndarray, same: bool, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and cosines of two blocks' near pairs, a bounded number at once; a block meets itself above the diagonal."""
    near = one @ two.T >= threshold - SLACK
    left, right = np.nonzero(np.triu(near, 1) if same else near)
    for at in range(0, len(left), CHECKED):
        i, j = left[at:at + CHECKED], right[at:at + CHECKED]
        # a sum of its own per pair, whatever block the two stand in
        exact = np.concatenate([(one[i[k:k + 1024]] * two[j[k:k + 1024]]).sum(axis=1) for k in range(0, len(i), 1024)])
        sure = exact >= threshold
        yield i[sure], j[sure], exact[sure]


def _parties(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Visitor by visitor, the party it passes by: name, ids, vectors and wanted blocks, and the party by name. Ends with None, and the last party."""
    key, held = None, {}
    for batch in batches:
        for n in range(batch.num_rows):
            at = {c: batch.column(c)[n] for c in batch.schema.names}
            here = at["party"].as_py(), at["part"].as_py()
            if here != key:
                yield None, held
                key, held = here, {}
            name, matrix = at["block"].as_py(), np.frombuffer(at["units"].as_buffer(), np.float64).reshape(-1, at["dim"].as_py())
            if at["visits"].as_py():
                yield (name, at["ids"].values, matrix, at["wanted"].as_py()), held
            else:  # copied, or the whole batch would stay
                held[name] = pa.array(at["ids"].as_py(), at["ids"].type.value_type), matrix.copy()
    yield None, held


def near_pairs(df: DataFrame, threshold: float = 0.85, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """All pairs of different vectors with a cosine of ``threshold`` or more: id_a < id_b and similarity.

    Equal vectors are one class, named by its lowest id (``vector_classes``), so copies make no pairs among themselves.
    Vectors of one dimension fall to the cell of their nearest pivot; the triangle inequality and the planes between pivots
    leave the pairs of blocks that can hold a result, and only those exchange vectors. Nothing is lost: where the bounds
    rule nothing out, all pairs of blocks are compared. Rows without an id, and null, empty or zero vectors or such with
    null or non-finite components take no part.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for visitor, held in _parties(batches):
            if visitor is not None:
                name, ids, matrix, wanted = visitor
                for other in wanted:
                    names, vectors = held[other]
                    for i, j, cosine in _near(matrix, vectors, name == other, threshold):
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(i)), names.take(pa.array(j)), pa.array(cosine)], ["x", "y", "similarity"])

    found = _met(df, threshold, id_col, vec_col).mapInArrow(score, f"x {kind}, y {kind}, similarity double")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def near_links(df: DataFrame, threshold: float = 0.85, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Every row that ``near_pairs`` regards, with its class and the number of different vectors near it.

    Links are counted where blocks meet, so that groups of near copies make no pairs: a block's counts leave a task once
    per party it passes by, and a party's once per copy.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def counted(ids: pa.Array, numbers: np.ndarray) -> pa.RecordBatch:
            some = np.flatnonzero(numbers)
            return pa.RecordBatch.from_arrays([ids.take(pa.array(some)), pa.array(numbers[some])], ["class_id", "links"])

        for visitor, held in _parties(batches):
            if visitor is None:
                yield from (counted(held[name][0], numbers) for name, numbers in sums.items())
                sums = {}
                continue
            name, ids, matrix, wanted = visitor
            own = np.zeros(len(matrix), np.int64)
            for other in wanted:
                vectors = held[other][1]
                theirs = sums.setdefault(other, np.zeros(len(vectors), np.int64))
                for i, j, _ in _near(matrix, vectors, name == other, threshold):
                    own += np.bincount(i, minlength=len(own))
                    theirs += np.bincount(j, minlength=len(theirs))
            yield counted(ids, own)

    links = _met(df, threshold, id_col, vec_col).mapInArrow(score, f"class_id {kind}, links long").groupBy("class_id").agg(F.sum("links").alias("links"))
    return vector_classes(df, id_col, vec_col).join(links, "class_id", "left").select(id_col, "class_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
