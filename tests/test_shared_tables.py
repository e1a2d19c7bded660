"""What the report's readers write: a table two operators start from once, names nobody reads not at all."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from satbill.operators import costs, rating
from satbill.plans import bind, catalog

QUERIES = catalog.load()
PLAN = "SBD Tiered 1250 1K"


@pytest.fixture
def tables(spark):
    """Two devices of a contract, one without a key, a fee alone, and no service to name them."""
    use = lambda c, i, m, plan=PLAN: (c, i, "SBD", "SBD Data Usage", D(30000), "BYTES", D(1), m, plan, D(7))
    when = dt.datetime(2021, 5, 2)
    fee = lambda n, c, i, what: (n, when, c, i, when.date(), when.date(), "SBD", "Monthly", None, what, D(5))
    made = bind.Tables(spark, "")
    made._made.update({
        "usage": spark.createDataFrame(
            [use("S-1", "D-1", 202105), use("S-1", "D-1", 202105, "B"), use("S-1", "D-2", 52021, None), use(None, "D-1", 202106, " ")],
            "contract_id string, imei string, service string, usage_type string, usage_bytes decimal(18,2), usage_unit string, "
            "total_amount decimal(18,2), bill_month int, plan_name string, actual_usage decimal(18,2)"),
        "fees": spark.createDataFrame(
            [fee(1, "S-1", "D-1", "Advance Charge"), fee(2, "S-1", "D-1", "Credit"), fee(3, "S-9", "D-9", "Credit")],
            "id long, invoice_date timestamp, contract_id string, icc_id_imei string, activation_date date, transaction_date date, "
            "service string, rate_type string, plan_discount string, description string, amount decimal(18,2)"),
        "plans": rating.default_plans(spark),
        "services": spark.createDataFrame(
            [(1, "S-1", "D-1", 9002, 5, 7, 70, 10)],
            "service_id long, login string, vsat string, type_id int, tariff_id int, customer_id int, account_id int, status int",
        ).withColumns({"blank": F.lit("o"), "actual_status": F.lit(1), **{n: F.lit(None).cast("timestamp") for n in ("create_date", "start_date", "stop_date")}}),
        "accounts": spark.createDataFrame([(70, "AG-70")], "account_id int, description string"),
        "customers": spark.createDataFrame([(7,)], "customer_id int"),
        "contacts": spark.createDataFrame([(7, 23, "Org")], "customer_id int, contact_dict_id int, value string"),
        "contact_dict": spark.createDataFrame([(23, "description")], "contact_dict_id int, mnemonic string"),
        "outer_ids": spark.createDataFrame([(7, "CUSTOMERS", "C1")], "id int, tbl string, ext_id string"),
        "services_ext": spark.createDataFrame([], "service_id long, value string, date_end timestamp"),
    })
    return made


@pytest.fixture
def written(monkeypatch):
    names, write = [], bind.snapshot
    monkeypatch.setattr(bind, "snapshot", lambda df, name="part": names.append(name) or write(df, name))
    return names


def test_fanout_works_overage_out_once(tables, written):
    rows = QUERIES["h11_fanout"].run(tables).collect()
    assert [(r.layer, r.imei, r.contract_id, r.bill_month, r.row_count) for r in rows] == [("consolidated", "D-1", "S-1", "202105", 2)]
    assert written.count("overage") == 1


@pytest.mark.parametrize("name", ["h11_fanout", "e12_report_totals", "h15_fee_coverage"])
def test_names_that_no_column_reads_are_not_joined(tables, written, name):
    df = QUERIES[name].run(tables)
    assert "info" not in written and "agreements" not in written
    assert "AG-70" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "type_id" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_totals_and_coverage_of_the_whole_report(tables):
    report = QUERIES["e10_billing_report"].run(tables)
    got = QUERIES["e12_report_totals"].run(tables).first()
    want = costs.report_totals(report).first()
    assert got == want and got.row_count == report.count()
    rows = {r.bill_month: tuple(r)[1:] for r in QUERIES["h15_fee_coverage"].run(tables).collect()}
    assert rows == {"2021-05": (3, 0, 1, 2, 0, 0), "2021-06": (1, 0, 0, 0, 0, 0)}


def test_an_overage_table_at_hand_is_not_worked_out_again(tables):
    own = costs.usage_overage(tables.usage, tables.plans)
    none = tables.usage.limit(0)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(costs.consolidated(none, tables.fees, tables.plans, overage=own)) == rows(costs.consolidated(tables.usage, tables.fees, tables.plans))
