"""A batch's files are looked through once for headers, encodings and counts, and once to be parsed."""

from __future__ import annotations

from satbill.sources import files
from satbill.sources.loads import read_log
from satbill.streaming import ingest

HEAD = "Contract ID;IMEI;Usage Type;Usage;Total Amount;Bill Month"


def lines_of(spark, tmp_path):
    for folder, name, text in (
        ("a", "x.csv", f"{HEAD}\nS-1;D-1;Data;5;1.00;202105\n\nS-2;D-2;Data;6;2.00;52021\n".encode()),
        ("b", "x.csv", f"{HEAD}\nS-3;D-3;Café;7;3.00;202105\n".encode("latin-1")),
        ("b", "torn.csv", f'{HEAD}\nS-4;"D\n4";Data;8;4.00;202105\n'.encode()),
        ("b", "bare.csv", b"S-5;D-5\n"),
    ):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_bytes(text)
    return files.raw_lines(spark, [str(tmp_path / "a"), str(tmp_path / "b")])


def test_a_batch_looks_for_headers_once(spark, tmp_path, monkeypatch):
    lines = lines_of(spark, tmp_path)
    scans, group = [], type(lines).groupBy

    def counted(df, *keys):
        if "value" in df.columns and "file_path" in df.columns and len(keys) < 3 and "_record" not in keys and "piece" not in keys:
            scans.append(keys)
        return group(df, *keys)

    monkeypatch.setattr(type(lines), "groupBy", counted)
    ingest.load_batch(lines.filter("source_file <> 'torn.csv'"), str(tmp_path / "table"), str(tmp_path / "log"), 1)
    assert len(scans) == 1
    log = {r.file_name: (r.load_status, r.records_loaded) for r in read_log(spark, str(tmp_path / "log")).collect()}
    assert log == {"x.csv": ("SUCCESS", 3), "bare.csv": ("FAILED", 0)}


def test_facts_at_hand_change_nothing(spark, tmp_path):
    lines = lines_of(spark, tmp_path)
    facts = files.file_facts(lines, files.USAGE_MUST)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(files.usage_rows(lines, facts=facts)) == rows(files.usage_rows(lines))
    assert {r.usage_type for r in files.usage_rows(lines, facts=facts).collect()} == {"Data", "Café"}
    got = {r.source_file: (r.has_header, r.records_in_file) for r in files.file_records(lines, files.USAGE_MUST, facts).collect()}
    assert got == {"x.csv": (True, 3), "torn.csv": (True, 1), "bare.csv": (False, 1)}
