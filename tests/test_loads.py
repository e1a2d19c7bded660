"""File scans, idempotent loads and the ingestion stream."""

from __future__ import annotations

import os
from decimal import Decimal as D

import pytest

from satbill.sources import files, loads
from satbill.streaming import ingest, monitor

USAGE_HEAD = ["Contract ID", "IMEI", "Usage Type", "Usage", "Bill Month", "Plan Name"]


def put(folder, name, text, encoding="utf-8"):
    with open(os.path.join(folder, name), "wb") as f:
        f.write(text.encode(encoding))


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    return str(path)


def test_delimiters_headings_and_encodings(spark, folder):
    put(folder, "a.csv", ";".join(USAGE_HEAD) + "\nSUB-1;D1;SBD Data Usage;1,234.5;92025;Plán\n\nSUB-2;;SBD Data Usage;;;\n")
    put(folder, "b.csv", "contract_id\timei\tUSAGE TYPE\tusage\tbill-month\nSUB-3\tD3\tX\t3,00025E+14\t202510\n")
    put(folder, "c.csv", '"Plan Name","Contract ID",IMEI,"Usage Type",Usage,"Bill Month"\n"Caf\xe9, ""x""","SUB-4",D4,X,7,102025\n', "latin-1")
    put(folder, "d.csv", "nothing;to;see\n1;2;3\n")
    rows = {r.contract_id: r for r in files.read_usage(spark, folder).collect()}
    assert set(rows) == {"SUB-1", "SUB-2", "SUB-3", "SUB-4"}
    assert (rows["SUB-1"].usage_bytes, rows["SUB-1"].bill_month, rows["SUB-1"].plan_name, rows["SUB-1"].source_file) == (D("1234.50"), 202509, "Plán", "a.csv")
    assert (rows["SUB-2"].imei, rows["SUB-2"].usage_bytes, rows["SUB-2"].plan_name) == (None, None, None)
    assert (rows["SUB-3"].usage_bytes, rows["SUB-3"].bill_month) == (D("300025000000000"), 202510)
    assert (rows["SUB-4"].plan_name, rows["SUB-4"].bill_month) == ('Café, "x"', 202510)


def test_fees_in_one_packed_column(spark, folder):
    cells = ["2025-11-02", "Co", "1", "2", "F", "SUB-1 ", "3", "D1", "01.02.2025", "02.02.2025", "SBD", "Monthly", "P", "Credit", "5", "$ 7.50", "G"]
    put(folder, "x.csv", '"' + ";".join(files.FEE_HEADINGS) + '",\n"' + ";".join(cells) + '",\n"' + ";".join([*cells[:10], "broadband", *cells[11:]]) + '",\n')
    rows, skipped = files.read_fees(spark, folder)
    row = rows.collect()
    assert len(row) == 1 and row[0].amount == D("7.50") and row[0].contract_id == "SUB-1 " and row[0].prorated_days == 5
    assert [tuple(r) for r in skipped.collect()] == [("x.csv", 1)]


def test_replace_ignores_case(spark):
    old = spark.createDataFrame([("A.csv", 1), ("b.csv", 2)], "source_file string, n int")
    new = spark.createDataFrame([("a.CSV", 3)], "source_file string, n int")
    assert sorted(r.n for r in loads.replace_by_source(old, new).collect()) == [2, 3]


def test_insert_new_null_rules(spark):
    schema = "contract_id string, imei string, bill_month int, service string, usage_type string, source_file string, usage_bytes decimal(18,2), n int"
    row = lambda c, b, n: (c, "D", 202509, "S", "U", "f", None if b is None else D(b), n)
    target = spark.createDataFrame([row("C", 1, 0), row("K", None, 0)], schema)
    batch = spark.createDataFrame([row("C", 1, 1), row("C", 2, 2), row("C", 2, 3), row("K", None, 4), row(None, 1, 5), row(None, 1, 6)], schema)
    assert sorted(r.n for r in loads.insert_new(target, batch).collect()) == [2, 5, 6]


def test_stream_twice_is_once(spark, folder, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "l")
    put(folder, "a.csv", ";".join(USAGE_HEAD) + "\nSUB-1;D1;X;1;92025;P\nSUB-2;D1;X;1;92025;P\n")
    run = lambda check: ingest.stream_ingest(spark, folder, table, log, str(tmp_path / check)).awaitTermination()
    run("one")
    put(folder, "b.csv", ";".join(USAGE_HEAD) + "\nSUB-3;D1;X;1;92025;P\n")
    run("one")
    assert sorted(r.contract_id for r in spark.read.parquet(table).collect()) == ["SUB-1", "SUB-2", "SUB-3"]
    run("two")  # a lost checkpoint reads every file again
    assert spark.read.parquet(table).count() == 3
    logged = loads.read_log(spark, log)
    assert {r.file_name: r.records_loaded for r in logged.collect()} == {"a.csv": 2, "b.csv": 1}
    status = loads.load_status(
        spark.createDataFrame([("A.csv", 2), ("b.csv", 5), ("c.csv", 1)], "file_name string, records_in_file long"), logged, spark.read.parquet(table), "usage")
    assert {r.file_name: r.is_loaded for r in status.collect()} == {"A.csv": True, "b.csv": False, "c.csv": False}


def test_every_delivered_file_is_logged(spark, folder, tmp_path):
    table, log = str(tmp_path / "t"), str(tmp_path / "l")
    put(folder, "good.csv", ";".join(USAGE_HEAD) + "\nSUB-1;D1;X;1;92025;P\n\nSUB-2;D1;X;1;92025;P\n")
    put(folder, "odd.csv", "Contract;Type\nSUB-1;D1\nSUB-1;D2\n")
    ingest.stream_ingest(spark, folder, table, log, str(tmp_path / "c")).awaitTermination()
    got = {r.file_name: (r.load_status, r.records_loaded, r.error_message) for r in loads.read_log(spark, log).collect()}
    assert got == {"good.csv": ("SUCCESS", 2, None), "odd.csv": ("FAILED", 0, "no line carries the expected headings")}
    files = spark.createDataFrame([("p.csv", True, 3)], "source_file string, has_header boolean, records_in_file long")
    rows = spark.createDataFrame([("p.csv",), ("p.csv",)], "source_file string")
    import datetime as dt

    entry = loads.file_log_entries(files, rows, "usage", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1)).first()
    assert (entry.load_status, entry.records_loaded, entry.error_message) == ("PARTIAL", 2, "2 of 3 records taken")


def test_monitor_stream(spark, tmp_path):
    src, body = tmp_path / "json", '{"net_id": 5, "ts": "2025-01-01T00:00:00Z", "stations_enabled": "1 / 3", "controllers": [{"name": "AM6 E04 01", "tx_kbit_s": 1.5}, {"name": "x"}]}'
    src.mkdir()
    (src / "a.txt").write_text(body + "\n")
    lines = spark.readStream.format("text").load(str(src)).withColumnRenamed("value", "body")
    for name, df in (("net_out", monitor.net_metrics(lines)), ("hub_out", monitor.hub_metrics(lines, "e04"))):
        df.writeStream.format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    net = spark.sql("SELECT * FROM net_out").first()
    assert (net.net_id, net.stations_enabled, net.stations_total) == (5, 1, 3)
    assert [r.controller for r in spark.sql("SELECT * FROM hub_out").collect()] == ["AM6 E04 01"]


def test_log_status_is_checked(spark):
    import datetime as dt

    df = spark.createDataFrame([("a",)], "source_file string")
    with pytest.raises(ValueError, match="status"):
        loads.log_entries(df, "usage", dt.datetime(2025, 1, 1), dt.datetime(2025, 1, 1), status="ERROR")
