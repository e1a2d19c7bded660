"""Intervals as nodes of a binary tree."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from satbill.operators import joins


@pytest.mark.parametrize("most", [3, 40, 5000, 3_000_000])
def test_points_meet_each_interval_once(spark, most):
    rnd = random.Random(most)
    intervals = [(i, a := rnd.randrange(most), a + rnd.randrange(-1, max(1, most // rnd.choice([1, 2, 50])))) for i in range(200)]
    intervals += [(900, None, 3), (901, 1, None), (902, 0, most), (902, 0, most)]
    points = [(100 + i, rnd.randrange(most + 3)) for i in range(300)] + [(7, None), (8, 0), (8, 0)]
    left = spark.createDataFrame(points, "p int, at long").withColumn("level", F.lit("clash"))
    right = spark.createDataFrame(intervals, "i int, low long, high long").withColumn("node", F.lit(1))
    got = sorted((r.p, r.i) for r in joins.points_in_intervals(left, F.col("at"), right, F.col("low"), F.col("high")).collect())
    want = sorted((p, i) for p, x in points for i, a, b in intervals if None not in (x, a, b) and a <= x <= b)
    assert got == want
    sizes = right.select(F.size(joins.dyadic_cover(F.col("low"), F.col("high"))).alias("n"), (F.col("high") - F.col("low") + 1).alias("wide")).collect()
    assert all(r.n <= 2 * max(1, r.wide).bit_length() + max(0, r.wide >> joins.LEVELS) for r in sizes if r.wide is not None)


def test_services_without_an_end_over_decades(spark):
    day = lambda y, m, d=1: dt.datetime(y, m, d)
    services = [(1, day(1985, 3, 31), None), (2, day(2001, 12), day(2002, 2)), (3, day(2010, 1), day(2009, 1)), (4, None, None), (5, day(2050, 1), None)]
    df = spark.createDataFrame(services, "service_id int, start_date timestamp, close_date timestamp")
    periods = [(y * 12 + m, day(y, m)) for y in range(1980, 2061) for m in range(1, 13)]
    months = spark.createDataFrame(periods, "period_id int, start_date timestamp")
    got = sorted((r.service_id, r.month) for r in joins.months_in_service(df, months, "2055-06-15").collect())
    want = []
    for s, start, close in services:
        stop = min(close or day(2055, 6, 15), day(2055, 6, 15))
        if start and start <= stop:
            want += [(s, f"{y}-{m:02d}") for y in range(1980, 2061) for m in range(1, 13) if (start.year, start.month) <= (y, m) <= (stop.year, stop.month)]
    assert got == sorted(want)
    days = spark.createDataFrame([(dt.date(1985, 3, 30) + dt.timedelta(days=7 * i),) for i in range(4000)], "day date")
    got = sorted((r.service_id, r.day) for r in joins.days_in_service(df, days, "day").collect())
    want = [(s, r.day) for s, start, close in services if start for r in days.collect() if start.date() <= r.day <= (close.date() if close else dt.date.max)]
    assert got == sorted(want)


def test_periods_without_bounds(spark):
    day = lambda y, m, d=1: dt.datetime(y, m, d)
    df = spark.createDataFrame([(1, day(2020, 5, 10)), (2, day(1999, 1, 1)), (3, None), (4, day(2020, 5, 31))], "id int, at timestamp")
    periods = [(1, day(2020, 5), day(2020, 5, 30)), (2, None, day(2000, 1)), (3, day(2020, 5, 11), None), (4, None, None)]
    df_periods = spark.createDataFrame(periods, "period_id int, start_date timestamp, stop_date timestamp")
    got = sorted((r.id, r.period_id) for r in joins.in_periods(df, "at", df_periods).collect())
    assert got == [(1, 1), (1, 4), (2, 2), (2, 4), (4, 3), (4, 4)]
    assert joins.in_periods(df, "at", df_periods.limit(0)).count() == 0
