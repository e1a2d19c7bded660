"""Comparing two results by hashes of buckets, so that only what differs is moved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satbill.functions.sem import nz
from satbill.operators.costs import Keep, _as_is

FAN = 1024  # children of a node of the hash tree


def _rows(df: DataFrame) -> DataFrame:
    """The columns as text, by place, and two hashes of them; NULL and every text hash apart."""
    texts = df.select(*[F.col(f"`{c}`").cast("string").alias(f"_{i}") for i, c in enumerate(df.columns)])
    marked = [x for c in texts.columns for x in (F.col(c).isNull(), F.col(c))]
    return texts.select("*", F.xxhash64(F.lit(0), *marked).alias("_h"), F.xxhash64(F.lit(1), *marked).alias("_g"))


def _node(level: int):
    """A row's node on a level: the remainder of its first hash."""
    return F.pmod(F.col("_h"), F.lit(FAN**level))


def _sums(rows: DataFrame, level: int) -> DataFrame:
    """Order-free hash of the rows below each node; folds before it is shuffled. Sums are whole numbers of 38 digits."""
    wide = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
    return rows.groupBy(_node(level).alias("_node")).agg(F.count(F.lit(1)).alias("n"), wide("_h").alias("h"), wide("_g").alias("g"))


def differing_nodes(a: DataFrame, b: DataFrame, level: int) -> DataFrame:
    """Nodes (``_node``) of a level under which the hashed rows differ, FAN to the power of ``level`` at most."""
    ours, theirs = _sums(a, level), _sums(b, level).select("_node", *[F.col(c).alias(f"r_{c}") for c in "nhg"])
    equal = F.col("n").eqNullSafe(F.col("r_n")) & F.col("h").eqNullSafe(F.col("r_h")) & F.col("g").eqNullSafe(F.col("r_g"))
    return ours.join(theirs, "_node", "full_outer").filter(~equal).select("_node")


def differing_rows(a: DataFrame, b: DataFrame, levels: int = 2, keep: Keep = _as_is) -> DataFrame:
    """Rows that occur more often in one result than in the other, once each: the columns of ``a`` as text, in_left, in_right.

    Columns pair up by place and compare as text; NULL equals NULL and nothing else. Buckets of rows are compared by counts and two
    sums of 64-bit hashes; each level reads only rows under nodes that differed on the one before, so equal tables shuffle
    nothing but a row per task and node, and at the end only rows of differing buckets meet. Nodes are at most
    ``FAN ** levels`` rows of one number (two levels: a million, 8 MB), which is what may be broadcast. Every level reads both
    sides again: ``keep`` (``snapshot``) writes the hashed rows, and the nodes of each level, so that neither is worked out anew.
    """
    if len(a.columns) != len(b.columns):
        raise ValueError("both results need the same number of columns")
    if levels not in (1, 2):
        raise ValueError("one or two levels")
    names, ours, theirs = a.columns, keep(_rows(a), "left_rows"), keep(_rows(b), "right_rows")
    for level in range(1, levels + 1):
        nodes = F.broadcast(keep(differing_nodes(ours, theirs, level), "nodes"))
        under = lambda rows: rows.withColumn("_node", _node(level)).join(nodes, "_node", "left_semi").drop("_node")  # noqa: B023,E731
        ours, theirs = under(ours), under(theirs)
    cells = [f"_{i}" for i in range(len(names))]
    side = lambda rows, left: rows.select(*cells, F.lit(left).alias("_l"), F.lit(1 - left).alias("_r"))
    both = side(ours, 1).unionByName(side(theirs, 0)).groupBy(*cells).agg(F.sum("_l").alias("in_left"), F.sum("_r").alias("in_right"))
    return both.filter("in_left <> in_right").select(*[F.col(k).alias(n) for k, n in zip(cells, names, strict=True)], "in_left", "in_right")


def same_rows_hashed(a: DataFrame, b: DataFrame, distinct: bool = True) -> DataFrame:
    """``quality.same_rows`` by way of hashes: same, only_left, only_right."""
    rows = differing_rows(a.toDF(*[f"c{i}" for i in range(len(a.columns))]), b)
    gap = F.sign("in_left") - F.sign("in_right") if distinct else F.col("in_left") - F.col("in_right")
    return rows.agg(
        nz(F.sum(F.greatest(gap, F.lit(0)))).cast("long").alias("only_left"), nz(F.sum(F.greatest(-gap, F.lit(0)))).cast("long").alias("only_right")
    ).select(((F.col("only_left") == 0) & (F.col("only_right") == 0)).alias("same"), "only_left", "only_right")
