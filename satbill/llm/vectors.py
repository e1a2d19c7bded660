"""Vectors in blocks: what the two searches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sound(vectors: DataFrame, nonzero: bool = False) -> DataFrame:
    """vec_id and embedding of the rows whose id and vector are not null and whose components are finite numbers."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where("vec_id IS NOT NULL AND embedding IS NOT NULL").where(~F.exists("embedding", odd))
    return rows.where(F.exists("embedding", lambda x: x != 0)) if nonzero else rows


def blocks(batches, size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, ids, matrix) of ``size`` vectors at most; a task's last block of each dimension may be small."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for batch in batches:
        column = batch.column("embedding")
        lengths = np.asarray(column.value_lengths())
        ids, cells = np.asarray(batch.column("vec_id")), np.asarray(column.flatten())
        starts = np.cumsum(lengths) - lengths
        for dim in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == dim)
            matrix = cells[starts[rows][:, None] + np.arange(dim)] if dim else np.zeros((len(rows), 0))
            held.setdefault(dim, []).append((ids[rows], matrix))
            while sum(len(i) for i, _ in held[dim]) >= size:
                all_ids, all_rows = (np.concatenate(x) for x in zip(*held[dim], strict=True))
                held[dim] = [(all_ids[size:], all_rows[size:])]
                yield dim, all_ids[:size], all_rows[:size]
    for dim, parts in held.items():
        ids, rows = (np.concatenate(x) for x in zip(*parts, strict=True))
        if len(ids):
            yield dim, ids, rows


PACKED = "dim int, ids binary, cells binary"


def to_bytes(cells: np.ndarray) -> bytes:
    """The matrix row by row, in single precision where that keeps every number (not-a-number does not occur)."""
    with np.errstate(over="ignore"):
        single = cells.astype(np.float32)
    return (single if (single == cells).all() else np.ascontiguousarray(cells)).tobytes()


def from_bytes(cells: bytes, rows: int, dim: int) -> np.ndarray:
    size = np.float32 if len(cells) == 4 * rows * dim else np.float64
    return np.frombuffer(cells, size).reshape(rows, dim).astype(np.float64)


def packed(rows: DataFrame, size: int) -> DataFrame:
    """A row per block of vectors."""

    def run(batches):
        for dim, ids, cells in blocks(batches, size):
            yield pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([to_bytes(cells)], pa.binary())], ["dim", "ids", "cells"]
            )

    return rows.mapInArrow(run, PACKED)


def unpacked(dim: int, ids: bytes, cells: bytes) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(ids, np.int64)
    return keys, from_bytes(cells, len(keys), dim)


HELD = 16 << 20  # bytes of query blocks that a task holds while shards pass by
SPAN = 4  # shards per task, or more if it holds more query blocks


def grid(queries: DataFrame, shards: DataFrame) -> tuple[int, int]:
    """Lines and columns of the grid in ``meet``."""
    n, size = queries.agg(F.count(F.lit(1)), F.sum(F.octet_length("ids") + F.octet_length("cells"))).first()
    lines = max(1, min(n, -(-(size or 0) // HELD)))
    return lines, max(1, -(-shards.count() // max(SPAN, -(-n // lines))))


def meet(queries: DataFrame, shards: DataFrame, payload: list[str], score, schema: str) -> DataFrame:
    """``score(blocks, shard)`` of every shard, a row with ``payload``, and the query blocks of its dimension, (ids, matrix, notes) each.

    Both are dealt over a grid of tasks: a block of queries goes to the tasks of its line, a shard to those of its column. A
    task holds its line's blocks, about ``HELD`` bytes, and its shards pass by one at a time, so a shard moves once per line and no
    pair of a block and a shard is ever a row. Nothing is broadcast, however small the written blocks are before they are
    dealt. The notes, an empty dict at first, are the block's while its task runs.
    """
    lines, columns = grid(queries, shards)
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))  # noqa: E731  equal blocks go apart
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    q = queries.select("dim", "ids", "cells", F.lit(0).alias("side"), dealt(lines).alias("line")).withColumn("column", every(columns))
    s = shards.select("dim", *payload, F.lit(1).alias("side"), dealt(columns).alias("column")).withColumn("line", every(lines))
    cell = (F.col("line") * columns + F.col("column")).cast("int")

    def run(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["side"] == 0:
                    held.setdefault(row["dim"], []).append((*unpacked(row["dim"], row["ids"], row["cells"]), {}))
                elif row["dim"] in held:
                    yield from score(held[row["dim"]], row)

    tasks = q.unionByName(s, allowMissingColumns=True).repartitionById(lines * columns, cell).drop("line", "column")
    return tasks.sortWithinPartitions("side").mapInArrow(run, schema)


def best(found: DataFrame, k: int, lowest: bool) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of the shards' results, ties to the smaller vec_id, each vec_id once."""
    found = found.groupBy("query_id", "vec_id").agg((F.min if lowest else F.max)("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score") if lowest else F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
