"""Scalar expressions: parsing, months, classification."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from satbill.functions import expr, sem


@pytest.mark.parametrize(("text", "value"), [
    ("3,00025E+14", 300025000000000.0), ("1,234.5", 1234.5), ("12,5", 125.0), ("$ 7.50", 7.5), ("-", None), ("", None), ("abc", None), (None, None),
])
def test_num(one, text, value):
    assert one(expr.num("x"), x=text) == value


@pytest.mark.parametrize(("text", "value"), [("$ 7.50", 7.5), ("€-3", -3.0), ("12,5", None), ("", None), ("1e3", 1000.0), ("5d", None)])
def test_amount(one, text, value):
    assert one(expr.amount("x"), x=text) == value


@pytest.mark.parametrize("text", ["02.03.2025", "2025-03-02", "2/3/2025", "2025/3/2", "02-03-2025", "2025.03.02"])
def test_any_date(one, text):
    assert one(expr.any_date("x"), x=text) == dt.date(2025, 3, 2)


@pytest.mark.parametrize("text", ["31.02.2025", "March 2025", "", "02.03.25"])
def test_no_date(one, text):
    assert one(expr.any_date("x"), x=text) is None


@pytest.mark.parametrize(("text", "strict", "lenient"), [
    ("92025", 202509, 202509), ("102025", 202510, 202510), ("202509", None, 202509), ("132025", None, None), ("91999", None, None),
])
def test_bill_month(one, text, strict, lenient):
    assert one(expr.bill_month("x", strict=True), x=text) == strict
    assert one(expr.bill_month("x"), x=text) == lenient


@pytest.mark.parametrize(("code", "month"), [(92025, "202509"), (102025, "202510"), (202509, "202509")])
def test_norm_bill_month(one, code, month):
    assert one(expr.norm_bill_month("x"), x=code) == month


@pytest.mark.parametrize(("month", "k", "moved"), [("202501", -1, "202412"), ("202512", 1, "202601"), ("202503", -15, "202312"), (None, 1, None)])
def test_shift_month(one, month, k, moved):
    assert one(expr.shift_month("x", k), x=month) == moved


@pytest.mark.parametrize(("text", "kind"), [
    (" advance charge ", "ADVANCE_CHARGE"), ("Credited", "CREDITED"), ("Credit", "CREDIT"), ("Activation fee", "ACTIVATION_FEE"),
    ("PRORATED", "PRORATED"), ("Other", "OTHER"), (None, "OTHER"),
])
def test_fee_class(one, text, kind):
    assert one(expr.fee_class("x"), x=text) == kind


@pytest.mark.parametrize(("address", "good"), [
    ("a.b@host.org", True), (".a@host.org", False), ("a..b@host.org", False), ("a@-host.org", False), ("a@host", False), ("a@b@c.org", False), (None, False),
])
def test_valid_email(one, address, good):
    assert one(expr.valid_email("x"), x=address) is good


def test_party_name_blank_is_null(one):
    cast = lambda n: F.col(n).cast("string")
    assert one(expr.party_name(cast("o"), cast("a"), cast("b"), cast("m")), o=None, a=None, b=None, m=None) is None
    assert one(expr.party_name(cast("o"), cast("a"), cast("b"), cast("m")), o=None, a="L", b=None, m="M") == "L  M"


def test_file_months(one):
    day = dt.date(2025, 1, 15)
    assert one(expr.file_bill_month("f", "d"), f="x.20250102.csv", d=day) == "202412"
    assert one(expr.file_bill_month("f", "d"), f="x.csv", d=day) == "202412"
    assert one(expr.file_period("f"), f="x.20250102.csv") == 20250102


def test_spread_nulls_never_matches_a_key(spark):
    left = spark.createDataFrame([("a", 1), (None, 2), (None, 3)], "k string, n int")
    right = spark.createDataFrame([("a",), (None,)], "j string")
    got = left.join(right, sem.spread_nulls("k", "n") == F.col("j"), "left").orderBy("n").collect()
    assert [r.j for r in got] == ["a", None, None]


def test_add_months_keeps_to_month_end():
    assert sem.add_months(dt.datetime(2025, 3, 31), -1) == dt.datetime(2025, 2, 28)
    assert sem.add_months(dt.datetime(2025, 1, 15), -3) == dt.datetime(2024, 10, 15)
