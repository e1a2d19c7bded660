"""Bound queries against their checking SQL, and the shape of the plans.

SATBILL_ALL=1 checks every query; otherwise a cross-section of them.
"""

from __future__ import annotations

import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from satbill.operators import costs
from satbill.plans import bind, catalog, q_costs, q_revenue
from satbill.plans.bind import BASE, Tables

FOLDER = "/root/testdata/sf0.001"
SOME = [
    "a02_read_fees", "a04_insert_new", "a07_triage_files", "b09_fee_class", "c01_overage_charge", "c05_counter_discount", "d07_range",
    "d11_overlap", "e02_modal_plan_by_contract", "e03_consolidated", "e09_report_advance_only", "f01_revenue_anchors", "f03_cogs_by_source",
    "g01_charges_report", "g04_sim_report", "h05_alert_consecutive_overage", "h08_charge_duplicate_members", "j03_hub_metrics",
    "k01_replace_by_map", "k03_repair_text", "k04_article_sections", "k05_chunks_cover_sections", "k07_vector_topk", "k10_hybrid_search", "k16_collapse_repeats",
]
QUERIES = catalog.load()


@pytest.fixture(scope="module")
def check():
    con = duckdb.connect()
    for base in BASE:
        con.execute(f"CREATE VIEW {base} AS SELECT * FROM '{FOLDER}/{base}.parquet'")
    return con


def norm(value):
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("SATBILL_ALL") else SOME)
def test_query_matches_its_check(spark, check, name):
    query = QUERIES[name]
    df = query.spark(spark, FOLDER)
    rows = sorted(tuple(norm(v) for v in r) for r in df.collect())
    if query.sql is None:
        assert rows
        return
    cursor = check.execute(query.check())
    assert [d[0] for d in cursor.description] == df.columns
    assert rows == sorted(tuple(norm(v) for v in r) for r in cursor.fetchall())


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Line items feed usage, invoice lines and charges: one scan for each that a report needs. The binding of charges reads them twice.
LINE_SCANS = {"e10_billing_report": 1, "f02_revenue_report": 2, "f03_cogs": 4, "f08_profit_by_period": 3}


def test_plans_of_reports(spark, monkeypatch):
    """No cross join, and a raw table scanned once for each use, in the result's plan and those of all tables written on the way."""
    plans = {}
    written = bind.snapshot

    def noted(df, name="part"):
        plans[current].append(plan(df))
        return written(df, name)

    monkeypatch.setattr(bind, "snapshot", noted)
    for current in (*LINE_SCANS, "f03_cogs_by_source", "g01_charges_report", "d07_range", "d11_overlap", "d09_contains", "k10_hybrid_search"):
        plans[current] = []
        plans[current].append(plan(QUERIES[current].spark(spark, FOLDER)))
    for name, texts in plans.items():
        whole = "\n".join(texts)
        assert "CartesianProduct" not in whole and "BroadcastNestedLoopJoin" not in whole, name
        found = len(re.findall(rf"Location: InMemoryFileIndex[^\n]*{FOLDER}/lineitem", whole))
        assert name not in LINE_SCANS or 1 <= found <= LINE_SCANS[name], (name, found)


def test_months_reach_the_scan_and_change_no_rows(spark, tmp_path):
    tables = Tables(spark, FOLDER)
    tables.usage.write.parquet(f"{tmp_path}/usage")
    tables.fees.write.parquet(f"{tmp_path}/fees")
    usage, fees = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("usage", "fees"))
    months = costs.period_months("2015-05")
    assert months == ("201505", "201506")
    assert "PushedFilters: [In(bill_month, [201505,201506,52015,62015])]" in plan(costs.usage_of(usage, months))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    text = plan(costs.fees_of(fees, months, before=1))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "GreaterThanOrEqual(invoice_date,2015-04-01" in text and "LessThan(invoice_date,2015-07-01" in text
    whole = q_costs.report(tables).filter("bill_month_key BETWEEN '201505' AND '201506'")
    part = q_costs.report(tables, months)
    assert whole.count() > 0 and whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0
    period = 2015 * 12 + 5
    whole, part = (q_revenue.revenue_rows(tables, ids) for ids in (None, [period]))
    whole = whole.filter(F.col("period_id") == period)
    assert whole.count() > 0 and whole.exceptAll(part).count() == 0 and part.exceptAll(whole).count() == 0


def test_reports_with_other_arguments_are_other_tables(spark):
    tables = Tables(spark, FOLDER)
    early, late = (q_costs.kept_report(tables, as_of=d) for d in ("2016-03-15", "2017-03-15"))
    own = lambda df: df.filter("branch = 'advance_only'").agg(F.max("bill_month_key")).first()[0]
    assert (own(early) or "") <= "201604" and own(early) != own(late)
    assert q_costs.kept_report(tables, as_of="2016-03-15") is early


def test_charges_are_listed_once(spark):
    rows = QUERIES["g01_charges_report"].spark(spark, FOLDER)
    assert rows.count() == rows.select("aid").distinct().count()


def test_rank_limits_run_before_the_shuffle(spark):
    for name in ("k14_history", "f11_revenue_display"):
        text = plan(QUERIES[name].spark(spark, FOLDER))
        assert "WindowGroupLimit" in text, name


def test_scans_are_pruned(spark):
    text = plan(QUERIES["k14_history"].spark(spark, FOLDER).select("conv_id", "turn"))
    assert "text" not in text.split("ReadSchema:")[1].split(">")[0]


def test_every_check_reads_provided_tables(check):
    """Dropping one table's rows must be visible to the engine: the check names it as a table, not as part of a word."""
    for name, query in QUERIES.items():
        sql = query.check()
        if sql is not None:
            used = check.execute("SELECT json_serialize_sql(?)", [sql]).fetchone()[0]
            assert any(f'"table_name":"{base}"' in used for base in BASE), name


def test_bindings_by_name(spark):
    tables = Tables(spark, FOLDER)
    assert tables.plans.count() == 3
    with pytest.raises(AttributeError):
        tables.no_such_table


def test_snapshots_are_removed_on_request(spark):
    from satbill.sources.snapshot import _written, remove_snapshots, snapshot

    kept = snapshot(spark.range(3), "probe")
    assert kept.count() == 3 and _written
    assert remove_snapshots(spark) >= 1 and not _written
