"""Records over quoted line breaks, in files read in many pieces."""

from __future__ import annotations

import csv
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from satbill.operators import text
from satbill.sources import files

HEADINGS = ["Contract ID", "Usage Type", "Bill Month", "Plan Name", "SP Name"]


def cell(rnd, sep):
    kind = rnd.random()
    if kind < 0.5:
        return rnd.choice(["plain", "x" * 30, "", "7", "é ü", 'in 5" pipe'])
    parts = [rnd.choice(["a", "long words", "\n", "\n\n", sep, '""', f'"{sep}"', "\nContract", "é", '"\n"', f'\n{sep}"']) for _ in range(rnd.randrange(1, 7))]
    return "x" + "".join(parts)


def delivered(path, seed, sep, rows, heading=HEADINGS):
    rnd = random.Random(seed)
    table = [[f"c{i}", *(cell(rnd, sep) for _ in HEADINGS[1:])] for i in range(rows)]
    with open(path, "w", encoding="utf-8", newline="") as out:
        out.write(sep.join(heading) + "\n")
        for row in table:
            out.write(sep.join(v if v == 'in 5" pipe' else '"' + v.replace('"', '""') + '"' if set(v) & {'"', "\n", sep} else v for v in row) + "\n")
    return [[v if v.strip() else None for v in row] for row in table]


@pytest.fixture
def small_pieces(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3k", "spark.sql.files.openCostInBytes": "1k"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("sep", files.DELIMITERS)
def test_records_survive_splits(spark, tmp_path, small_pieces, sep):
    want = {f"f{n}.csv": delivered(tmp_path / f"f{n}.csv", n, sep, rows) for n, rows in enumerate([900, 1, 0, 40])}
    delivered(tmp_path / "calm.csv", 9, sep, 0)
    with open(tmp_path / "calm.csv", "a") as out:
        out.writelines(f'c{i}{sep}"quoted"{sep}1{sep}in 5" pipe{sep}\n' for i in range(300))
    want["calm.csv"] = [[f"c{i}", "quoted", "1", 'in 5" pipe', None] for i in range(300)]
    lines = files.raw_lines(spark, str(tmp_path))
    assert lines.filter("source_file = 'f0.csv'").select("piece").distinct().count() > 10
    cells = files.split_lines(lines, HEADINGS, ["Contract ID", "Usage Type", "Bill Month"])
    got = {}
    for r in cells.collect():
        got.setdefault(r.source_file, []).append(list(r[1:]))
    key = lambda row: [v or "" for v in row]
    assert {k: sorted(v, key=key) for k, v in got.items()} == {k: sorted(v, key=key) for k, v in want.items() if v}
    counted = {r.source_file: (r.has_header, r.records_in_file) for r in files.file_records(lines, ["Contract ID", "Usage Type", "Bill Month"]).collect()}
    assert counted == {k: (True, len(v)) for k, v in want.items()}


def test_read_usage_equals_a_csv_reader(spark, tmp_path, small_pieces):
    path = tmp_path / "usage.csv"
    with open(path, "w", newline="") as out:
        writer = csv.writer(out, delimiter=";", lineterminator="\n")
        writer.writerow(HEADINGS)
        for i in range(500):
            writer.writerow([f"k{i}", "SBD Data Usage", "102025", f"plan\nno {i};\"big\"" if i % 3 == 0 else "plan", "one" if i % 5 else "two\n\nlines"])
    got = sorted(tuple(r) for r in files.read_usage(spark, str(path)).select("contract_id", "usage_type", "plan_name", "sp_name").collect())
    read = duckdb.sql(f"SELECT \"Contract ID\", \"Usage Type\", \"Plan Name\", \"SP Name\" FROM read_csv('{path}', delim=';', quote='\"', escape='\"', header=true, all_varchar=true)")
    assert got == sorted(read.fetchall()) and len(got) == 500


def test_an_open_quote_takes_the_rest_of_its_file_only(spark, tmp_path):
    for n in (1, 2):
        (tmp_path / f"f{n}.csv").write_text("Contract ID;Usage Type;Bill Month\n" + "a;b;c\n" * 3 + ('a;"b;c\n' if n == 1 else "a;b;c\n") + "a;b;c\n" * 3)
    rows = files.split_lines(files.raw_lines(spark, str(tmp_path)), HEADINGS, HEADINGS[:3]).groupBy("source_file").count().collect()
    assert {r.source_file: r["count"] for r in rows} == {"f1.csv": 4, "f2.csv": 7}


MAPPING = "working_index int, spare_index int, old_text string, new_text string"


@pytest.mark.parametrize("key_chars", [1 << 20, 40])
def test_keys_of_any_form(spark, key_chars):
    rnd = random.Random(7)
    word = lambda most: "".join(rnd.choice("abé ;") for _ in range(rnd.randrange(1, most)))
    keys = list({word(6) for _ in range(60)} | {"aba", "bab", "b", "a" * 50, "😀", "é😀"})
    mapping = [(i, i + 100, k, f"<{i}>") for i, k in enumerate(keys)] + [(900, 1, "b", "<again>"), (901, 1, "", "x"), (902, 1, None, "x"), (903, 1, "never there", "x")]
    texts = [(i, word(80) + rnd.choice(["", "é😀b", "a" * 60])) for i in range(200)] + [(500, None), (501, ""), (502, "ab" * 50_000)]
    df = spark.createDataFrame(texts, "i int, v string").withColumn("id", F.lit("clash")).withColumn("text", F.lit(1))
    got = {r.i: [m.working_index for m in r.matches] for r in text.contained_keys(df, "i", "v", spark.createDataFrame(mapping, MAPPING), key_chars=key_chars).collect()}
    want = {i: sorted(m[0] for m in mapping if m[2] and m[2] in v) for i, v in texts if v}
    assert got == {i: w for i, w in want.items() if w}
    prefixed = text.contained_keys(df, "i", "v", spark.createDataFrame(mapping, MAPPING), prefix="a", key_chars=key_chars)
    got = {r.i: [m.working_index for m in r.matches] for r in prefixed.collect()}
    want = {i: sorted(m[0] for m in mapping if m[2] and "a" + m[2] in v) for i, v in texts if v}
    assert got == {i: w for i, w in want.items() if w}


def test_no_keys(spark):
    df = spark.createDataFrame([(1, "a")], "i int, v string")
    assert text.contained_keys(df, "i", "v", spark.createDataFrame([], MAPPING)).count() == 0
    assert text.replace_by_map(df.limit(0), "i", "v", spark.createDataFrame([(1, 2, "a", "b")], MAPPING)).count() == 0
