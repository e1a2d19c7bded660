"""Title questions over the trigram index, and comparison by hash trees."""

from satbill.operators import compare, quality, search, titles
from satbill.sources.snapshot import snapshot

TITLES = [
    (1, "Label 3 – part 1"), (2, "label 3 - PART 10"), (3, "Other"), (4, None), (5, ""), (6, "Label 3 — part 1"), (None, "label"), (7, "ab"), (8, "a–b"),
    (9, "Отчёт за май"), (9, "Отчёт за май"),
]


def test_questions_equal_the_scan(spark):
    df = spark.createDataFrame(TITLES, "vec_id long, section_title string")
    asked = ["label 3 - part 1", " LABEL ", "a", "ab", "a-b", "b", "отчёт ЗА", "zzz", "part 1 label", "", None, "label 3 — part 1"]
    index = titles.title_index(df)
    found = titles.title_questions(index, spark.createDataFrame(list(enumerate(asked)), "question_id int, text string"), 3).collect()
    for i, text in enumerate(asked):
        rows = [tuple(r) for r in search.title_search(df.filter("vec_id IS NOT NULL"), text or "", 3).collect()]
        assert sorted((r["rank"], r["id"], r["title"]) for r in found if r["question_id"] == i) == [(k + 1, *r) for k, r in enumerate(rows)], text


def test_only_folders_of_the_questions_are_read(spark):
    df = spark.range(2000).selectExpr("id AS vec_id", "concat('title ', id, ' of many') AS section_title")
    index = titles.title_index(df)
    asked = spark.createDataFrame([(1, "e 77 o")], "question_id int, text string")
    plan = titles.title_questions(index, asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters", 1)[1]
    assert [r["id"] for r in titles.title_questions(index, asked).collect()] == [77]


def test_no_titles_no_questions(spark):
    df = spark.createDataFrame([], "vec_id long, section_title string")
    asked = spark.createDataFrame([(1, "abc"), (2, "a")], "question_id int, text string")
    assert titles.title_questions(titles.title_index(df), asked).collect() == []
    assert titles.title_questions(titles.title_index(spark.createDataFrame(TITLES, "vec_id long, section_title string")), asked.limit(0)).collect() == []


def test_comparison_equals_the_join(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, ""), (None, None)] + [(i, "same") for i in range(10, 3000)], "k long, v string")
    b = spark.createDataFrame([(1, "x"), (2, None), (3, None), (None, None), (None, None)] + [(i, "same") for i in range(10, 3000)], "k long, w string")
    for distinct in (True, False):
        assert compare.same_rows_hashed(a, b, distinct).collect() == quality.same_rows(a, b, distinct).collect()
        assert compare.same_rows_hashed(a, a.repartition(5), distinct).first()["same"]
    rows = {(r["k"], r["v"]): (r["in_left"], r["in_right"]) for r in compare.differing_rows(a, b).collect()}
    assert rows == {("1", "x"): (2, 1), ("3", ""): (1, 0), ("3", None): (0, 1), (None, None): (1, 2)}
    assert compare.differing_rows(a.limit(0), b.limit(0)).collect() == []


def test_equal_tables_differ_in_no_node(spark):
    a = spark.range(5000).selectExpr("id", "cast(id % 7 AS string) AS v")
    ours, theirs = compare._rows(a), compare._rows(a.repartition(3))
    assert compare.differing_nodes(ours, theirs, 1).collect() == []


def test_both_sides_are_worked_out_once(spark):
    """Every level used to read, join and hash both inputs anew."""
    kept = {}

    def keep(df, name):
        kept[name] = kept.get(name, 0) + 1
        return snapshot(df, name)

    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k int, v string"), spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    got = compare.differing_rows(a, b, keep=keep)
    assert kept == {"left_rows": 1, "right_rows": 1, "nodes": 2} and "ExistingRDD" not in got._jdf.queryExecution().sparkPlan().toString()
    assert sorted(tuple(map(str, r)) for r in got.collect()) == [("2", "None", "1", "0"), ("2", "y", "0", "1")]
