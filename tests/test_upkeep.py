from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from satbill.operators import costs, rating, upkeep
from satbill.sources import loads
from tests.test_costs import FEES, USAGE, fee, info, use  # noqa: F401

FIRST = {
    "u1.csv": [use("SUB-1", "D1", 202508, "A"), use("SUB-1", "D1", 82025, "A"), use("SUB-2", "D2", 202508, " ")],
    "u2.csv": [use("SUB-1", "D1", 202509, " "), use("SUB-2", "D2", 202509, "B"), use("SUB-3", "D3", None, "N")],
    "u3.csv": [use("SUB-3", "D3", 202506, "C")],
    "f1.csv": [fee(1, "SUB-1", "D1", "2025-08-02", "Advance Charge", 10), fee(2, "SUB-2", "D2", "2025-09-02", "Credit", 3, plan="F")],
}
SECOND = {
    "u4.csv": [use("SUB-1", "D1", 202510, "A"), use("SUB-3", "D3", 202510, "C")],
    "f2.csv": [fee(3, "SUB-2", "D2", "2025-10-02", "Advance Charge", 20), fee(4, "SUB-1", "D1", "2025-10-02", "Advance Charge", 7)],
}
THIRD = {  # a file comes again with another month, and turns the plan SUB-1's rows without a plan fall back to
    "u1.csv": [use("SUB-1", "D1", 202507, "Z"), use("SUB-1", "D1", 202507, "Z"), use("SUB-2", "D2", 202508, " ")],
    "f1.csv": [fee(1, "SUB-1", "D1", "2025-08-02", "Advance Charge", 11)],
}


def test_three_deliveries_equal_one_full_run(spark, info, tmp_path):  # noqa: F811
    plans, held = rating.default_plans(spark), {}
    root, log_path = str(tmp_path / "kept"), str(tmp_path / "log")

    def deliver(files, batch, as_of):
        held.update(files)
        entries = [("fees" if name[0] == "f" else "usage", name.upper(), 1, "SUCCESS") for name in files]
        if entries:
            loads.log_load(spark.createDataFrame(entries, "table_name string, file_name string, records_loaded long, load_status string"), log_path, batch)
        log = loads.read_log(spark, log_path)
        usage = spark.createDataFrame([(*r, f) for f, rows in held.items() if f[0] == "u" for r in rows], USAGE + ", source_file string")
        fees = spark.createDataFrame([(*r[:-1], f) for f, rows in held.items() if f[0] == "f" for r in rows], FEES)
        months = upkeep.maintain_report(root, usage, fees, plans, *info, log, as_of)
        whole = costs.billing_report(usage, fees, plans, *info, as_of)
        kept = upkeep.read_report(spark, root)
        assert set(kept.columns) == set(whole.columns)
        rows = lambda df: sorted(tuple(map(str, r)) for r in df.select(*whole.columns).collect())
        assert rows(kept) == rows(whole)
        return months

    assert deliver(FIRST, 1, "2025-11-15") is None
    assert deliver(SECOND, 2, "2025-11-15") == {"202510", "202511"}
    assert deliver({}, 2, "2025-11-20") == frozenset()
    # old and new months of u1 and f1 (and the month after a fee), no others; SUB-1's plan changes in 202509 only
    assert deliver(THIRD, 3, "2025-11-20") == {"202507", "202508", "202509", "202510"}
    # lone advances of October now count, those before no longer
    assert deliver({}, 3, "2025-12-15") == {"202511", "202510"}
    assert deliver({"u3.csv": [use("SUB-3", "D3", 202505, "C")]}, 4, "2025-12-15") == {"202505", "202506"}
    assert "202506" not in {r.bill_month_key for r in upkeep.read_report(spark, root).select("bill_month_key").collect()}


def test_a_cut_off_run_is_not_seen(spark, info, tmp_path, monkeypatch):  # noqa: F811
    usage = spark.createDataFrame([(*use("SUB-1", "D1", 202508, "A"), "u.csv")], USAGE + ", source_file string")
    fees = spark.createDataFrame([], FEES)
    log = spark.createDataFrame([("usage", "u.csv", "SUCCESS", "1")], "table_name string, file_name string, load_status string, batch string")
    root, plans = str(tmp_path / "kept"), rating.default_plans(spark)
    with pytest.raises(ValueError):
        upkeep.read_report(spark, root)
    upkeep.maintain_report(root, usage, fees, plans, *info, log, "2025-11-15")
    more = usage.unionByName(usage.withColumns({"bill_month": F.lit(202509), "source_file": F.lit("v.csv")}))
    late = log.unionByName(log.withColumns({"file_name": F.lit("V.csv"), "batch": F.lit("2")}))
    with monkeypatch.context() as patch:
        patch.setattr(upkeep, "as_datetime", lambda day: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            upkeep.maintain_report(root, more, fees, plans, *info, late, "2025-11-15")
    assert upkeep.read_report(spark, root).count() == 1
    assert upkeep.maintain_report(root, more, fees, plans, *info, late, "2025-11-15") == {"202509"}
    assert upkeep.read_report(spark, root).count() == 2
