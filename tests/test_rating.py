"""Golden rating cases and the rate tables."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from satbill.operators import rating

CASES = [
    ("SBD Tiered 1250 1K", 30000, "27.25"), ("SBD Tiered 1250 1K", 500, "0"),
    ("SBD Tiered 1250 10K", 35000, "6.50"), ("SBD Tiered 1250 10K", 6000, "0"), ("SBD Tiered 1250 10K", 60000, "10.50"),
    ("SBD Tiered 350 1K", 2180, "1.77"), ("SBD Tiered 350 1K", 5000, "6.00"), ("SBD Tiered 350 1K", 500, "0"),
    ("No such plan", 90000, "0"), (None, 90000, "0"), ("SBD Tiered 1250 1K", None, "0"),
]


@pytest.fixture(scope="module")
def usage(spark):
    rows = [(i, plan, None if b is None else D(b)) for i, (plan, b, _) in enumerate(CASES)]
    return spark.createDataFrame(rows, "i int, plan_name string, usage_bytes decimal(18,2)")


def test_overage_charge(spark, usage):
    got = {r.i: r.charge for r in rating.overage_charge(usage, rating.default_plans(spark)).collect()}
    assert got == {i: D(expected) for i, (_, _, expected) in enumerate(CASES)}


def test_breakdown_adds_up(spark, usage):
    for r in rating.overage_breakdown(usage, rating.default_plans(spark)).collect():
        assert r.charge == round(r.tier1_charge + r.tier2_charge + r.tier3_charge, 2)
        assert r.overage_kb == r.tier1_kb + r.tier2_kb + r.tier3_kb


def test_inactive_plan_is_free(spark, usage):
    plans = rating.default_plans(spark).withColumn("active", F.lit("N"))
    assert rating.overage_charge(usage, plans).agg(F.sum("charge")).first()[0] == 0


def test_any_number_of_bands(spark, usage):
    bands = rating.plan_bands(rating.default_plans(spark))
    kb = usage.withColumn("usage_kb", (F.col("usage_bytes") / 1000).cast("decimal(20,5)"))
    got = {r.i: r.charge for r in rating.rate_tiers(kb, bands).collect()}
    assert got == {i: D(expected) for i, (_, _, expected) in enumerate(CASES)}


def test_last_rate_of_day_breaks_ties_by_id(spark):
    at = dt.datetime(2025, 3, 1, 9)
    rates = spark.createDataFrame(
        [(1, 4, 1, D("60"), at), (3, 4, 1, D("62"), at), (2, 4, 1, D("61"), at), (9, 4, 2, D("99"), at), (8, 1, 1, D("98"), at)],
        "rate_id long, currency_id int, domain_id int, rate decimal(10,4), start_time timestamp",
    )
    assert [r.rate for r in rating.daily_rate(rates).collect()] == [D("62")]
