"""What stays on disk while a report is made: written tables leave no shuffle files, and steps before the last are written."""

from __future__ import annotations

import time
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F
from test_read_once import tables, written  # noqa: F401

from satbill.operators import costs, revenue
from satbill.plans import catalog
from satbill.sources import snapshot as snapshots

QUERIES = catalog.load()


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    df = spark.range(5000).groupBy((F.col("id") % 1000).alias("k")).count()
    before = shuffle_files(spark)
    kept = snapshots.snapshot(df, "sums")
    for _ in range(50):  # files go in the background
        if not shuffle_files(spark) - before:
            break
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert kept.count() == 1000 and df.agg(F.sum("count")).first()[0] == 5000  # what was written can still be worked out


def test_the_session_setting_comes_back(spark):
    unset = spark.conf.get(snapshots.CLEANUP, None)
    snapshots.snapshot(spark.range(3))
    assert spark.conf.get(snapshots.CLEANUP, None) == unset
    spark.conf.set(snapshots.CLEANUP, "true")
    snapshots.snapshot(spark.range(3))
    assert spark.conf.get(snapshots.CLEANUP) == "true"
    spark.conf.unset(snapshots.CLEANUP)
    with pytest.raises(Exception):  # noqa: B017
        snapshots.snapshot(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")))
    assert spark.conf.get(snapshots.CLEANUP, None) == unset


def test_fees_are_read_once_for_all_spellings(spark):
    fees = spark.createDataFrame([("A", "D", 1), ("B", "D", 2), (None, "D", 3), ("C", None, 4)], "contract_id string, imei string, marker int")
    pairs = spark.createDataFrame([("A",), ("A ",), ("A  ",), ("A ",), ("B",), ("C ",), (None,)], "contract_id string")
    found = costs._spelled(fees, pairs)
    assert sorted(map(str, found.select("contract_id", "imei", "marker").collect())) == sorted(map(str, spark.createDataFrame(
        [("A", "D", 1), ("A ", "D", 1), ("A  ", "D", 1), ("B", "D", 2), (None, "D", 3), ("C", None, 4), ("C ", None, 4)], fees.schema).collect()))
    leaves = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LogicalRDD" in line and "marker" in line]
    assert len(leaves) == 1


def test_only_rows_without_a_plan_move_to_the_modal_plans(spark):
    use = spark.createDataFrame(
        [("S-1", "D-1", 202101, "P", D(1)), ("S-1", "D-1", 202102, None, D(2)), ("S-2", "D-2", 202101, " ", D(3)), (None, "D-1", 202103, "", D(4)),
         (None, None, 202103, None, D(5))],
        "contract_id string, imei string, bill_month int, plan_name string, n decimal(18,2)")
    overage = use.select("imei", "contract_id", "bill_month", "plan_name", *[F.col("n").alias(n) for n in costs.USAGE_SUMS],
                         F.lit(1).cast("decimal(10,4)").alias("included_kb"), F.lit(1).cast("long").alias("record_count"))
    fees = spark.createDataFrame([], "id long, invoice_date timestamp, contract_id string, icc_id_imei string, activation_date date, "
                                     "service string, rate_type string, plan_discount string")
    names = []
    found = costs.consolidate(overage, fees, keep=lambda df, name: names.append(name) or snapshots.snapshot(df, name))
    rows = lambda df: sorted(map(str, df.collect()))
    assert names == ["joined"] and rows(found) == rows(costs.consolidate(overage, fees))
    got = {(r.contract_id, r.bill_month): r.plan_name for r in found.collect()}
    assert got == {("S-1", "202101"): "P", ("S-1", "202102"): "P", ("S-2", "202101"): None, (None, "202103"): got[None, "202103"]}
    assert sorted((r.imei or "", r.plan_name or "") for r in found.collect() if r.contract_id is None) == [("", ""), ("D-1", "P")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(plan_name" in plan and "isnotnull(plan_name" in plan


@pytest.mark.parametrize("name, tables_written", [
    ("f02_revenue_report", {"pair_plans", "anchors", "line_places"}), ("e10_billing_report", {"previous", "spellings"}),
    ("e08_report_main", {"previous", "spellings", "fee_lines"}), ("e03_consolidated", {"joined"}),
])
def test_steps_before_the_last_are_written(tables, written, name, tables_written):  # noqa: F811
    QUERIES[name].run(tables)
    assert tables_written <= set(written)


def test_places_at_hand_are_not_folded_again(tables):  # noqa: F811
    keyed = revenue.keyed_services(tables.services)
    lines = revenue.invoice_sums(tables.invoice_items, tables.invoices, tables.resource_types)
    places = lines.select("service_id", "period_id", "line_account_id").distinct()
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(revenue.contract_lines(keyed, lines, places)) == rows(revenue.contract_lines(keyed, lines)) != []
