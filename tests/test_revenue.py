"""Anchors, profit and trend on hand-made rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from satbill.operators import profit, revenue

SERVICES = ("service_id long, type_id int, login string, vsat string, account_id int, customer_id int, open_date timestamp")
ITEMS = "service_id long, period_id int, account_id int"
DAY = dt.datetime(2025, 1, 1)


def svc(i, kind, login, vsat, account=1):
    return (i, kind, login, vsat, account, 5, DAY)


@pytest.fixture
def anchors(spark):
    def run(services, items=()):
        s, i = spark.createDataFrame(list(services), SERVICES), spark.createDataFrame(list(items), ITEMS)
        rows = revenue.revenue_anchors(s, i).filter(F.col("imei").isNotNull()).collect()
        return {(r.base_contract_id, r.imei, r.account_id): r.service_id for r in rows}

    return run


def test_main_service_hides_its_suspension(anchors):
    assert anchors([svc(1, 9002, "SUB-1", "D1"), svc(2, 9008, "D1", "D1")]) == {("SUB-1", "D1", 1): 1}


def test_lone_suspension_and_login_as_device(anchors):
    assert anchors([svc(2, 9008, "D1", "  ")]) == {("D1", "D1", 1): 2}


def test_companions_by_priority(anchors):
    assert anchors([svc(3, 9013, "D1", "D1"), svc(4, 9004, "D1", "D1"), svc(5, 9010, "D1", "D1")]) == {("D1", "D1", 1): 5}


def test_clone_shares_the_base_contract(anchors):
    assert anchors([svc(1, 9002, "SUB-1-clone-2", "D1"), svc(2, 9002, "SUB-1", "D1")]) == {("SUB-1", "D1", 1): 1}


def test_companion_alone_on_an_invoice(anchors):
    services = [svc(1, 9002, "SUB-1", "D1"), svc(2, 9010, "D1", "D1")]
    assert anchors(services, [(1, 7, 1), (2, 7, 1)]) == {("SUB-1", "D1", 1): 1}
    assert anchors(services, [(1, 7, 1), (2, 8, 1)]) == {("SUB-1", "D1", 1): 1, ("D1", "D1", 1): 2}


@pytest.fixture
def profits(spark):
    def run(rows, rates=()):
        report = spark.createDataFrame(
            [(p, n, k, D(c), D(0), D(0)) for p, n, k, c, _ in rows],
            "financial_period string, customer_name string, ext_code string, calculated_overage decimal(18,2), billed_amount decimal(18,2), fees_total decimal(18,2)")
        earned = spark.createDataFrame(
            [(p, n, k, D(r)) for p, n, k, _, r in rows], "period string, customer_name string, ext_code string, revenue_total decimal(18,2)")
        fx = spark.createDataFrame(list(rates), "period string, rate decimal(20,6)")
        return profit.profit_by_period(report, earned, fx)

    return run


def test_missing_rate_counts_one_and_no_code_drops(profits):
    rows = profits([("2025-01", "A", "C", "40", "100"), ("2025-01", "B", None, "40", "100"), ("2025-01", "Z", "Z", "1", "0")]).collect()
    assert [(r.customer_name, r.profit_rub, r.margin_pct, r.status) for r in rows] == [("A", D(60), 60.0, "PROFITABLE")]


def test_alert_reads_the_rounded_margin(profits):
    row = profit.unprofitable(profits([("2025-01", "A", "C", "9000.40", "10000")], [("2025-01", D(1))])).first()
    assert (row.margin_pct, row.status, row.alert_type) == (10.0, "LOW_MARGIN", "PROFITABLE")


def test_trend(profits):
    rows = profit.profit_trend(profits([("2025-01", "A", "C", "10", "110"), ("2025-02", "A", "C", "10", "60"), ("2025-03", "A", "C", "10", "60")]))
    got = [(r.period, r.profit_change, r.profit_change_pct, r.trend) for r in rows.orderBy("period").collect()]
    assert got == [("2025-01", None, None, None), ("2025-02", D(-50), -50.0, "DECREASE"), ("2025-03", D(0), 0.0, None)]


SHOWN_SERVICES = "service_id long, vsat string, login string, close_date timestamp"


def test_repeated_service_records_and_open_periods(spark):
    jan, feb = dt.datetime(2025, 1, 15), dt.datetime(2025, 2, 15)
    services = spark.createDataFrame(
        [(1, "D1", "SUB-1", jan), (1, "D1", "SUB-1", None), (2, "D2", "SUB-2", jan), (2, "D2", "SUB-2", feb)], SHOWN_SERVICES)
    assert {r.service_id: r._close for r in revenue.closing_days(services).collect()} == {1: None, 2: feb}
    items = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 1), (2, 2), (9, 1)], "service_id long, period_id int")
    periods = spark.createDataFrame([(1, dt.datetime(2025, 1, 1)), (2, dt.datetime(2025, 2, 1))], "period_id int, start_date timestamp")
    found = {r.imei: sorted(r._open_in) for r in revenue.open_periods(services, items, periods).collect()}
    assert found == {"D1": ["2025-01", "2025-02"], "D2": ["2025-01"]}


def test_display_moves_a_report_with_its_lookups_once(spark):
    cols = "service_id long, sub_contract_id string, imei string, contract_id string, period string, currency_id int, acc_currency_id int, account_id int"
    # laid out by the owner's key, as the report is
    report = spark.createDataFrame([
        (1, "SUB-1", "D1", "SUB-1", "2025-01", 1, 1, 1, True, None, None), (1, "SUB-1", "D1", "SUB-1", "2025-01", 4, 1, 1, True, None, None),
        (2, "SUB-2", "D2", "SUB-2", "2025-01", 1, 1, 1, True, dt.datetime(2025, 1, 3), True),
        (3, "SUB-3", "D3", "SUB-3", "2025-01", 1, 1, 1, True, dt.datetime(2025, 1, 3), False),
    ], cols + ", _known boolean, _close timestamp, _seen boolean").repartition(4, "contract_id", "imei", "account_id")
    services = spark.createDataFrame([], SHOWN_SERVICES)
    items = spark.createDataFrame([], "service_id long, period_id int")
    periods = spark.createDataFrame([], "period_id int, start_date timestamp")
    shown = revenue.revenue_display(report, services, items, periods)
    assert [(r.service_id, r.currency_id) for r in shown.orderBy("service_id").collect()] == [(1, 1), (2, 1)]
    assert shown.columns == [n.split()[0] for n in cols.split(", ")]
    plan = shown._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan
