"""What a query's only reader does not ask for is neither written nor worked out, and the rows stay those of the written table."""

from __future__ import annotations

import datetime as dt

import pytest

from satbill.operators import revenue
from satbill.plans import bind, catalog, q_costs, q_revenue

QUERIES = catalog.load()


@pytest.fixture
def tables(spark):
    """Four customers with two orders of three lines each, from which all bound tables follow."""
    made = bind.Tables(spark, "")
    orders = [(n, 6 + n % 4, "F", 900.5 + n, dt.datetime(1998, 1 + n % 3, 5), f"{1 + n % 5}-X") for n in range(1, 9)]
    lines = [(o[0], 1 + (o[0] + k) % 3, k, k, 5.0 + k, 120.25 * k, 0.05 * (k - 1), "ANR"[k - 1], "FO"[k % 2], o[4] + dt.timedelta(days=20 * k))
             for o in orders for k in (1, 2, 3)]
    made._made.update({
        "customer": spark.createDataFrame([(k, f"C{k}", k % 3, 10.0 * k - 75, s) for k, s in zip((6, 7, 8, 9), ("BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"), strict=True)],
                                          "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "part": spark.createDataFrame([(k, f"P{k}", "Brand#11", "T", k, 10.5 + k) for k in (1, 2, 3)],
                                      "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"),
        "orders": spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        "lineitem": spark.createDataFrame(
            lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
            "l_returnflag string, l_linestatus string, l_shipdate timestamp"),
    })
    return made


@pytest.fixture
def written(monkeypatch):
    names, write = [], bind.snapshot
    monkeypatch.setattr(bind, "snapshot", lambda df, name="part": names.append(name) or write(df, name))
    return names


@pytest.mark.parametrize("name, unread", [
    ("h18_revenue_unique", "fees_total"), ("g14_revenue_period_list", "fees_total"), ("f03_cogs_all_months", "_by_imei"), ("f03_cogs", None),
])
def test_a_cost_table_with_one_reader_is_not_written(tables, written, name, unread):
    plan = QUERIES[name].run(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "money" not in written and "overage" in written
    assert unread is None or unread not in plan


def test_rows_are_those_of_the_written_table(tables):
    rows = lambda df: sorted(map(str, df.collect()))
    lazy, kept = q_revenue.revenue_rows(tables), q_revenue.revenue_rows(tables, plans=q_costs.money(tables))
    assert rows(lazy) == rows(kept) and lazy.count() > 0
    for made in (lambda m: revenue.cogs_all_months(m, tables.services, tables.charges, tables.invoice_items),
                 lambda m: revenue.cogs(m, tables.services, tables.charges, tables.invoice_items, tables.periods)):
        assert rows(made(q_costs.read_once_money(tables))) == rows(made(q_costs.money(tables))) != []
