"""Join forms the reports share, written as equi joins wherever the condition allows it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from satbill.functions.sem import moment
from satbill.operators.costs import fallback_lookup

__all__ = [
    "fallback_lookup", "flag_if_present", "in_periods", "with_day_rate", "null_safe_join", "months_in_service", "days_in_service",
    "points_in_intervals", "dimension_chain",
]


def dimension_chain(fact: DataFrame, dimensions: list[tuple[DataFrame, str]]) -> DataFrame:
    """Left joins to dimensions by their shared key; sizes, not hints, decide how each one is joined."""
    for dimension, key in dimensions:
        fact = fact.join(dimension, key, "left")
    return fact


def flag_if_present(df: DataFrame, other: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """EXISTS as a column: true where ``other`` has the row's keys."""
    present = other.select(*keys).distinct().withColumn(flag, F.lit(True))
    return df.join(present, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


# --- intervals --------------------------------------------------------------------------------

LEVELS = 17  # a node of the highest level spans 2**17 months or days; longer intervals have several of these
FIRST, LAST = "0001-01-01", "9999-12-31"  # stand for a missing bound


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def day_number(day: Column) -> Column:
    return F.datediff(day, F.lit(FIRST).cast("date"))


def dyadic_cover(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The nodes (level, node) of a binary tree over whole numbers that together are low to high, both included.

    A node stands for the numbers whose quotient by 2**level it is. At most two nodes of each level are taken, so an
    interval of n numbers has about 2 log2(n) of them; an empty one has none.
    """
    end = high + 1

    def of_level(level: int) -> Column:
        size = 1 << level
        first, stop = F.ceil(low / size).cast("long"), F.floor(end / size).cast("long")
        item = lambda node: F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"))
        if level == levels:
            return F.when(first < stop, F.transform(F.sequence(first, stop - 1), item)).otherwise(F.array())
        ends = F.array(F.when(first % 2 == 1, item(first)), F.when(stop % 2 == 1, item(stop - 1)))
        return F.when(first < stop, F.array_compact(ends)).otherwise(F.array())

    return F.flatten(F.array(*[of_level(level) for level in range(levels + 1)]))


def dyadic_path(point: Column, levels: list[int]) -> Column:
    """The nodes of the given levels that a whole number lies in; exactly one of them is in the cover of an interval that holds it."""
    return F.array(*[F.struct(F.lit(n).alias("level"), F.floor(point / (1 << n)).cast("long").alias("node")) for n in levels])


def points_in_intervals(points: DataFrame, point: Column, intervals: DataFrame, low: Column, high: Column) -> DataFrame:
    """Pairs of rows of ``points`` and ``intervals`` (columns of other names) where low <= point <= high, whole numbers not below zero.

    An equi join on tree nodes: an interval has a row per node of its cover, a point one for each level that any cover
    uses. Those levels, eighteen at most, are asked for first, so short intervals cost a point one row. Null points and bounds match nothing.
    """
    covered = intervals.withColumn("_n", F.explode(dyadic_cover(low, high))).withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    levels = sorted(r["_level"] for r in covered.select("_level").distinct().collect())
    placed = points.filter(point.isNotNull()).withColumn("_n", F.explode(dyadic_path(point, levels or [0])))
    placed = placed.withColumns({"_level": F.col("_n.level"), "_node": F.col("_n.node")}).drop("_n")
    return placed.join(covered, ["_level", "_node"]).drop("_level", "_node")


def in_periods(df: DataFrame, time_col: str, periods: DataFrame) -> DataFrame:
    """Rows whose time lies within a period's bounds, with its period_id; a missing bound is open.

    The range becomes an equi join on calendar months, covered by few nodes however long a period is, with the exact
    bounds as a residual condition.
    """
    day = lambda c, otherwise: month_number(F.coalesce(F.col(c).cast("date"), F.lit(otherwise).cast("date")))
    bounds = periods.select("period_id", F.col("start_date").alias("_start"), F.col("stop_date").alias("_stop"))
    found = points_in_intervals(df, month_number(F.col(time_col)), bounds, day("_start", FIRST), day("_stop", LAST))
    after = F.col("_start").isNull() | (F.col(time_col) >= F.col("_start"))
    before = F.col("_stop").isNull() | (F.col(time_col) < F.col("_stop") + F.expr("interval 1 day"))
    return found.filter(after & before).drop("_start", "_stop")


def with_day_rate(df: DataFrame, day_col: str, rates: DataFrame) -> DataFrame:
    """Rate in force on the row's day (``rates``: rate_day, rate); NULL on days without one."""
    return df.join(rates, F.to_date(day_col) == F.col("rate_day"), "left").drop("rate_day")


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], null_safe: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` plus ``null_safe`` keys on which NULL equals NULL."""
    names = [*keys, *null_safe]
    renamed = right.withColumnsRenamed({n: f"_r_{n}" for n in names})
    on = [F.col(n) == F.col(f"_r_{n}") for n in keys] + [F.col(n).eqNullSafe(F.col(f"_r_{n}")) for n in null_safe]
    return left.join(renamed, on, how).drop(*[f"_r_{n}" for n in names])


def months_in_service(services: DataFrame, periods: DataFrame, until: dt.date | str) -> DataFrame:
    """Every calendar month a service was alive in, up to ``until``, with the period of that month.

    A service's life is covered by a few nodes, its months arise only where periods meet them.
    """
    stop = F.least(F.coalesce("close_date", moment(until)), moment(until))
    alive = services.filter(F.col("start_date") <= stop).select(
        "service_id", month_number(F.col("start_date")).alias("_from"), month_number(stop).alias("_to")
    )
    months = periods.select("period_id", F.date_format("start_date", "yyyy-MM").alias("month"), month_number(F.col("start_date")).alias("_at"))
    return points_in_intervals(months, F.col("_at"), alive, F.col("_from"), F.col("_to")).select("service_id", "period_id", "month")


def days_in_service(services: DataFrame, days: DataFrame, day_col: str) -> DataFrame:
    """The rows of ``days`` for every service alive on that day, its first and last day included; without a last day it lives on."""
    alive = services.filter(F.col("start_date").isNotNull()).select(
        "service_id", day_number(F.col("start_date").cast("date")).alias("_from"),
        day_number(F.coalesce(F.col("close_date").cast("date"), F.lit(LAST).cast("date"))).alias("_to"),
    )
    return points_in_intervals(days, day_number(F.col(day_col).cast("date")), alive, F.col("_from"), F.col("_to")).drop("_from", "_to")
