"""Edge cases of the cost report on hand-made rows."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from satbill.operators import costs, dims, rating

USAGE = ("contract_id string, imei string, service string, usage_type string, usage_bytes decimal(18,2), usage_unit string, "
         "total_amount decimal(18,2), bill_month int, plan_name string, actual_usage decimal(18,2)")
FEES = ("id long, invoice_date timestamp, contract_id string, icc_id_imei string, activation_date date, transaction_date date, service string, "
        "rate_type string, plan_discount string, description string, amount decimal(18,2), source_file string")
PLAN = "SBD Tiered 1250 1K"


def use(contract, imei, month, plan=PLAN, kb=30, kind="SBD Data Usage", unit="BYTES"):
    return (contract, imei, "SBD", kind, None if kb is None else D(kb * 1000), unit, D("1.00"), month, plan, D(kb or 7))


def fee(i, contract, imei, day, what, amount, service="SBD", rate="Monthly", plan=None, spent=None):
    when = dt.datetime.fromisoformat(day)
    return (i, when, contract, imei, when.date(), spent or when.date(), service, rate, plan, what, D(amount), "f.csv")


@pytest.fixture
def make(spark):
    def run(usage=(), fees=()):
        return spark.createDataFrame(list(usage), USAGE), spark.createDataFrame(list(fees), FEES), rating.default_plans(spark)

    return run


@pytest.fixture
def info(spark):
    """Two contracts of one customer, and what a device is known under elsewhere."""
    services = spark.createDataFrame(
        [(1, "SUB-1", "D1", 9002, 5, 7, 70, 10), (2, "SUB-2", "D2", 9002, 5, 7, 70, 10), (3, "D1", "D1", 9008, 5, 7, 70, 10)],
        "service_id long, login string, vsat string, type_id int, tariff_id int, customer_id int, account_id int, status int",
    ).withColumns({
        "blank": F.lit("o"), "actual_status": F.lit(1), "create_date": F.lit("2020-01-01").cast("timestamp"),
        "start_date": F.lit("2020-01-01").cast("timestamp"), "stop_date": F.lit(None).cast("timestamp"),
    })
    accounts = spark.createDataFrame([(70, "AG-70")], "account_id int, description string")
    customers = spark.createDataFrame([(7,)], "customer_id int")
    contacts = spark.createDataFrame([(7, 23, "Org")], "customer_id int, contact_dict_id int, value string")
    names = spark.createDataFrame([(23, "description")], "contact_dict_id int, mnemonic string")
    codes = spark.createDataFrame([(7, " customers ", "C2"), (7, "CUSTOMERS", "C1"), (7, "CUSTOMERS", None)], "id int, tbl string, ext_id string")
    ext = spark.createDataFrame(
        [(1, "D9 ", None), (2, "D9", dt.datetime(2021, 1, 1))], "service_id long, value string, date_end timestamp"
    )
    return (
        dims.service_info(services, accounts, customers, contacts, names, codes, "2025-12-15"),
        dims.device_agreements(services, ext, accounts),
    )


def test_events_add_up_and_fall_back_to_actual(make):
    usage, _, plans = make([
        use("C", "D", 202509, kind="SBD Mailbox Checks", unit=" event "), use("C", "D", 202509, kind="SBD Registrations", unit="EVENT", kb=None),
        use("C", "D", 202509, kind="SBD Registrations", unit="BYTES"), use("C", "D", 202509),
    ])
    row = costs.usage_overage(usage, plans).first()
    assert (row.mailbox_events, row.registration_events, row.events_count) == (30000, 7, 30007)
    assert (row.overage_kb, row.calculated_overage, row.record_count) == (29, D("27.25"), 4)


def test_modal_plan_ties_and_blanks(make):
    usage, _, _ = make([use("C", "D", 202509, "B"), use("C", "D", 202509, "A"), use("C", "D", 202509, " "), use("C", "D", 202509, " "), use("C", "D", 202509, " ")])
    assert [tuple(r) for r in costs.modal_plan(usage, "contract_id").collect()] == [("C", "A")]


def test_null_keys_never_meet(make):
    usage, fees, plans = make([use(None, "D", 202509)], [fee(1, None, "D", "2025-09-02", "Credit", 1)])
    assert costs.consolidated(usage, fees, plans).count() == 2


def test_plan_order_usage_fee_contract_device(make):
    usage, fees, plans = make(
        [use("C1", "D1", 202509, "U"), use("C2", "D2", 202508, "M"), use("C3", "D3", 202508, "V")],
        [fee(1, "C1", "D1", "2025-09-02", "x", 1, plan="F"), fee(2, "C4", "D4", "2025-09-02", "x", 1, plan="F"),
         fee(3, "C2", "D9", "2025-09-02", "x", 1), fee(4, "C9", "D3", "2025-09-02", "x", 1), fee(5, "C8", "D8", "2025-09-02", "x", 1)],
    )
    got = {r.contract_id: r.plan_name for r in costs.consolidated(usage, fees, plans).filter("bill_month = '202509'").collect()}
    assert got == {"C1": "U", "C4": "F", "C2": "M", "C9": "V", "C8": None}
    bare = {r.contract_id: r.plan_name for r in costs.consolidated(usage, fees, plans, plan_fallback=False).filter("bill_month = '202509'").collect()}
    assert bare == {"C1": "U", "C4": "F", "C2": None, "C9": None, "C8": None}


def test_fee_copies_fold_but_different_days_stay(make):
    _, fees, _ = make(fees=[
        fee(1, "C", "D", "2025-09-02", "Advance Charge", 10), fee(2, "C", "D", "2025-09-02", " advance charge ", 10),
        fee(3, "C", "D", "2025-09-02", "Advance Charge", 10, spent=dt.date(2025, 8, 1)), fee(4, "C", "D", "2025-09-02", "Advance Charge", 10, service="broadband "),
    ])
    assert sorted(r.id for r in costs.dedup_fees(fees).collect()) == [1, 3]
    assert costs.fee_pivot(fees).first().fee_advance == 20
    assert costs.advance_by_month(fees).first().earned_month == "202508"


def test_advance_is_paid_once_when_the_device_is_swapped(make, info):
    usage, fees, plans = make(
        [use("SUB-1", "D2", 202511), use("SUB-1", "D1", 202511)], [fee(1, "SUB-1", "D7", "2025-10-02", "Advance Charge", 10)]
    )
    rows = costs.billing_report(usage, fees, plans, *info, "2025-12-15").filter("bill_month_key = '202511'").collect()
    assert {r.imei: r.fee_advance_previous for r in rows} == {"D1": D(10), "D2": D(0)}
    assert {r.financial_period for r in rows} == {"2025-10"}
    assert {r.ext_code for r in rows} == {"C1"} and {r.is_suspended for r in rows} == {"Y"}


def test_current_advance_equals_the_invoice_months(make, info):
    usage, fees, plans = make([use("SUB-1", "D1", 202510)], [fee(1, "SUB-1", "D1", "2025-10-02", "Advance Charge", 10)])
    row = costs.billing_report(usage, fees, plans, *info, "2025-12-15").first()
    assert row.fee_advance == 10 == row.fees_total


def test_advance_only_rows(make, info):
    usage, fees, plans = make([use("SUB-2", "D2", 202511)], [
        fee(1, "SUB-1", "D1", "2025-10-02", "Advance Charge", 10),   # no row in November: stands alone
        fee(2, "SUB-2", "D2", "2025-10-02", "Advance Charge", 11),   # has a row in November
        fee(3, "SUB-1", "D1", "2025-08-02", "Advance Charge", 12),   # too old
        fee(4, "SUB-1", "D1", "2025-11-02", "Credit", 13, service="BROADBAND"),
    ])
    rows = costs.billing_report(usage, fees, plans, *info, "2025-12-15").filter("branch = 'advance_only'").collect()
    assert [(r.contract_id, r.bill_month, r.financial_period, r.fee_advance_previous) for r in rows] == [("SUB-1", "2025-11", "2025-11", D(10))]


def test_advance_only_months():
    assert costs.advance_only_months("2025-12-15") == ["202510"]
    assert costs.advance_only_months("2026-01-01") == ["202510", "202511"]  # the first of October is not yet too old
    assert costs.advance_only_months("2026-01-10") == ["202511"]


def test_agreement_falls_back_by_device_only_without_a_contract(make, info):
    usage, fees, plans = make([use("SUB-9", "D9", 202509), use("SUB-1", "D9", 202509)])
    got = {r.contract_id: (r.service_id, r.agreement_number) for r in costs.billing_report(usage, fees, plans, *info, "2025-12-15").collect()}
    assert got == {"SUB-9": (None, "AG-70"), "SUB-1": (1, "AG-70")}


def test_months_in_one_pass_equal_the_consolidated_rows(make, info):
    """Missing keys, months without a fee or a plan, and contracts spelled with blanks: rows stacked by key say what the joins say."""
    usage, fees, plans = make(
        [use("S-1", "D-1", 202509), use("S-1", "D-1", 202509, plan="B"), use("S-1", "D-1", 92025, plan=" "), use("S-1", None, 202509, plan=None),
         use(None, "D-1", 202509, plan=None), use(None, None, 202509, plan=""), use("S-2 ", "D-2", 202509, plan=None), use("S-2", "D-2", 202510)],
        [fee(1, "S-1", "D-1", "2025-09-05", "Advance Charge", "5.00", plan="Z"), fee(2, "S-2", "D-2", "2025-09-05", "Advance Charge", "7.00"),
         fee(3, None, "D-1", "2025-09-06", "Credit", "2.00", plan="C"), fee(4, "S-3", "D-3", "2025-09-06", "Credit", "3.00"),
         fee(5, "S-2 ", "D-2", "2025-08-06", "Advance Charge", "4.00")],
    )
    names = ["imei", "contract_id", "bill_month_key", "plan_name", "fee_plan_monthly", "included_kb", "calculated_overage", "fee_advance",
             "fee_advance_previous", "fees_total", "service_id"]
    rows = lambda df: sorted(tuple(str(v) if v is None or isinstance(v, str) else float(v) for v in r) for r in df.select(*names).collect())
    overage, lines = costs.usage_overage(usage, plans), costs.dedup_fees(fees)
    for fallback in (True, False):
        stacked = costs.planned_rows(overage, fees, lines, fallback, costs._modal_plans(overage, None), costs._as_is, *info)
        joined = costs.billing_report_main(costs.consolidate(overage, fees, fallback), lines, *info)
        assert rows(stacked) == rows(joined)
    advances = {(r.contract_id, r.bill_month_key): (float(r.fee_advance), float(r.fee_advance_previous)) for r in joined.filter("imei = 'D-2'").collect()}
    assert advances[("S-2 ", "202509")] == (7.0, 4.0) or advances[("S-2", "202509")] == (7.0, 4.0)
    assert advances[("S-2", "202510")] == (0.0, 7.0)


def test_usage_and_fees_are_stacked(make, info):
    """They were joined, and the wide rows moved again for every lookup."""
    usage, fees, plans = make([use("S-1", "D-1", 202509)], [fee(1, "S-1", "D-1", "2025-09-05", "Advance Charge", "5.00")])
    report = costs.billing_report(usage, fees, plans, *info, "2025-12-15")
    plan = report._jdf.queryExecution().sparkPlan().toString()
    assert "FullOuter" not in plan


def test_modal_plans_at_hand_are_not_counted_again(make, info):
    usage, fees, plans = make([use("S-1", "D-1", 202509, plan="")])
    modal = {k: usage.sparkSession.createDataFrame([(v, "Named")], f"{k} string, plan_name string") for k, v in (("contract_id", "S-1"), ("imei", "D-1"))}
    report = costs.billing_report(usage, fees, plans, *info, "2025-12-15", modal=modal)
    assert [r.plan_name for r in report.collect()] == ["Named"]
