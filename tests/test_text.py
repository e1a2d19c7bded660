"""Encoding repair, sections, repeats and vector search against plain Python."""

from __future__ import annotations

import numpy as np
import pytest

from satbill.operators import quality, search, text

LINE = "Спутниковая связь: абонентская плата"


def repairs(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, note string")
    found = {r.i: (r.new_value, r.how) for r in text.text_repairs(df, "i", ["note"]).collect()}
    whole = {r.i: r.note for r in text.repair_text(df, ["note"]).collect()}
    assert whole == {i: found[i][0] if i in found else t for i, t in enumerate(texts)}
    return [found.get(i) for i in range(len(texts))]


def test_repair(spark):
    cases = {
        LINE.encode("utf-8").decode("cp1251"): "cp1251->utf8",
        LINE.encode("cp866").decode("cp1251"): "cp1251->cp866",
        LINE.encode("cp1251").decode("latin-1"): "latin1->cp1251",
    }
    assert repairs(spark, list(cases)) == [(LINE, how) for how in cases.values()]
    mixed = "Мар".encode().decode("cp1251") + "ина карта".encode().decode("latin-1")
    strict = "Шина шар".encode().decode("cp1251")  # holds the euro sign, a marker and a stand-in elsewhere
    assert repairs(spark, [mixed, strict]) == [("Марина карта", "cp1251->utf8"), ("Шина шар", "cp1251->utf8")]
    blank = "Район Рязань".encode().decode("cp1251").replace("\xa0", " ")
    assert repairs(spark, [blank]) == [("Район Рязань", "cp1251->utf8")]


def test_nothing_to_repair(spark):
    fine = [LINE, "plain text", "", None, "Москва", "РУСВЕТ и Ромашка", "déjà vu, très bien", "中文"]
    assert repairs(spark, fine) == [None] * len(fine)


def test_repair_runs_in_the_jvm(spark):
    plan = text.repair_text(spark.createDataFrame([(LINE,)], "note string"), ["note"])._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def sections(spark, html):
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    return [(r.title, r.text) for r in text.page_sections(pages).orderBy("idx").collect()]


def test_sections_nest_and_flatten(spark):
    html = "<h1>A &amp; B</h1><p>one</p><p>two <b>x</b></p><h2>Sub</h2><p>three</p><h1>C</h1><script>var p='</p>'</script><ul><li>i</li><li>j</li></ul>"
    assert sections(spark, html) == [("A & B", "one\ntwo \nx\n\nSub\n\nthree"), ("C", "i\nj")]


def test_text_before_the_first_heading_takes_everything(spark):
    assert sections(spark, "<p>intro</p><h1>T</h1><p>a</p>") == [("", "intro\n\nT\n\na")]


def test_page_without_blocks(spark):
    assert sections(spark, "<div>just <i>text</i></div>") == [("", "just \ntext")]
    assert sections(spark, None) == [("", "")]


def test_nothing_inside_nested_lists_and_tables_is_lost(spark):
    html = "<h1>T</h1><ul><li>a<ul><li>b</li></ul></li><li>c</li></ul><table><tr><td>1<table><tr><td>2</td></tr></table></td><td>3</td></tr></table>"
    ((title, body),) = sections(spark, html)
    assert title == "T" and [x for x in body.split("\n") if x] == ["a", "b", "c", "1", "2", "3"]
    assert sections(spark, "<p>open<h1>A</h1><p>b<h1>C</h1></ul><p>d</ul>e</p>") == [("", "open\n\nA\n\nb\n\nC\n\nd\ne")]
    assert sections(spark, "<h2>A</h2><p>b<h1>C</h1><p>d<h2>E</h2>") == [("A", "b"), ("C", "d\n\nE")]


def test_chunks_hold_the_whole_section(spark):
    texts = {1: "x" * 11_000, 2: "".join(chr(97 + i % 26) for i in range(40_001)), 3: "short", 4: ""}
    rows = [(i, "Page", f"Title {i}", t) for i, t in texts.items()]
    df = spark.createDataFrame(rows, "page_id int, page_title string, section_title string, section_text string")
    got = text.section_chunks(df, df.filter("page_id = 99").select("page_id")).orderBy("page_id", "chunk").collect()
    for i in (1, 2, 3):
        own = [r for r in got if r.page_id == i]
        assert "".join(r.content for r in own) == f"Page\n\nTitle {i}\n\n{texts[i]}"
        assert [r.chunk for r in own] == list(range(len(own)))
        assert all(r.embed_text.endswith(r.content) and len(r.embed_text) <= 15_000 for r in own)
        assert all(r.embed_text.startswith(f"Page\n\nTitle {i}") for r in own)
    assert {r.page_id for r in got} == {1, 2, 3}


def test_collapse(spark):
    long = "Уважаемые коллеги, сообщаем об изменении стоимости услуг связи с первого числа."
    cases = {"short": "short", long + long: long, "p one is long enough\n\nq\n\np one is long enough\n\nq": "p one is long enough\n\nq",
             "nothing is repeated in here": "nothing is repeated in here", long + "\n" + long[:-1] + "!": long}
    df = spark.createDataFrame([(i, body) for i, body in enumerate(cases)], "i int, body string")
    got = {r.i: r.body for r in text.collapse_repeats(df, "body").collect()}
    assert got == dict(enumerate(cases.values()))


def vectors(spark, rows, names="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, names)


def questions(spark, queries):
    return spark.createDataFrame([(q, [float(x) for x in v]) for q, v in queries], "query_id long, vector array<double>")


def test_topk_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = rng.normal(size=(300, 8)).astype(np.float32)
    rows[10] = rows[20] = rows[30]  # equal scores go by id
    df = vectors(spark, [(i, [float(x) for x in r], i % 3) for i, r in enumerate(rows)]).repartition(6)
    queries = [(q, rng.normal(size=8)) for q in range(40)] + [(99, rows[30])]
    unit = rows.astype(float) / np.linalg.norm(rows.astype(float), axis=1, keepdims=True)
    monkeypatch.setattr(search, "BLOCK", 17)
    for label in (None, 1):
        found = search.vector_topk(df, questions(spark, queries).repartition(3), 5, **({} if label is None else {"label": label}))
        got = {(r.query_id, r.rank): r.vec_id for r in found.collect()}
        for name, vector in queries:
            scores = unit @ (np.asarray(vector, float) / np.linalg.norm(vector))
            order = [i for i in sorted(range(300), key=lambda i: (-round(scores[i], 12), i)) if label is None or i % 3 == label][:5]
            assert [got[(name, k)] for k in range(1, 6)] == order


def test_topk_of_odd_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=4)], 0) for i in range(200)]
    rows += [(1000 + i, [float("nan"), 1.0, 1.0, 1.0], 0) for i in range(30)] + [(2000, [None, 1.0, 1.0, 1.0], 0), (2001, None, 0), (2002, [], 0), (None, [1.0] * 4, 0), (2003, [1.0], 0)]
    found = search.vector_topk(vectors(spark, rows), questions(spark, [(1, [1, 0, 0, 0]), (2, [float("nan")] * 4)]), 10).collect()
    assert [(r.query_id, r.rank) for r in sorted(found, key=lambda r: r.rank)] == [(1, k) for k in range(1, 11)]
    assert all(r.vec_id < 200 for r in found)


def test_near_duplicates_list_five(spark):
    df = vectors(spark, [(i, [1.0, i / 10], 0) for i in range(9)])
    got = sorted((r.rank, r.vec_id, r.is_duplicate) for r in search.near_duplicates(df, questions(spark, [(1, [1, 0])]), 0.95).collect())
    assert got == [(1, 0, True), (2, 1, True), (3, 2, True), (4, 3, True), (5, 4, False)]


def test_hybrid_keeps_untitled_rows_and_long_questions(spark):
    rows = [(1, [1.0, 0.0], "Plan A"), (2, [0.9, 0.1], None), (3, [0.8, 0.2], "Other"), (4, [0.7, 0.3], "Other"), (5, [0.6, 0.4], None)]
    df = vectors(spark, rows, "vec_id long, embedding array<float>, section_title string")
    one = questions(spark, [(1, [1, 0])])
    got = [(r.source, r.vec_id) for r in search.hybrid_search(df, ["zzz", "plan a"], one, 9).collect()]
    assert got == [("title", 1), ("semantic", 2), ("semantic", 3), ("semantic", 5)]
    got = [(r.source, r.vec_id) for r in search.hybrid_search(df, ["q" * 300], one, 9).collect()]
    assert got == [("semantic", i) for i in range(1, 6)]


def test_mappings_of_any_size(spark):
    keys = [(i, i + 1, f"00:00:00:00:{i // 100:02d}:{i % 100:02d}", f"new{i}") for i in range(1000)]
    mapping = spark.createDataFrame(keys, "working_index int, spare_index int, old_text string, new_text string")
    texts = [(1, f"mac {keys[7][2]} and mac {keys[5][2]}."), (2, f"mac {keys[9][2]}:11"), (3, f"vlan {keys[9][2]}"), (4, None)]
    got = {r.i: (r.new_value, r.changes) for r in text.replace_by_map(spark.createDataFrame(texts, "i int, v string"), "i", "v", mapping, "mac ").collect()}
    assert got == {1: ("mac new7 and mac new5.", "5->6, 7->8"), 2: ("mac new9:11", "9->10")}


def test_duplicates_keep_min_or_max_and_nulls_match(spark):
    df = spark.createDataFrame([(1, "k", None, "x"), (2, "k", None, "y"), (3, "k", 1, "z")], "id int, a string, b int, c string")
    for keep, ids in (("min", {1: "x", 3: "z"}), ("max", {2: "y", 3: "z"})):
        assert {r.id: r.c for r in quality.remove_duplicates(df, ["a", "b"], "id", keep).collect()} == ids
    assert [r.id for r in quality.remove_duplicates(df, ["a", "b"], "id", dry_run=True).collect()] == [2]
    assert sorted(r.id for r in quality.duplicate_members(df, ["a", "b"], "id").collect()) == [1, 2]


def test_same_rows(spark):
    a = spark.createDataFrame([(1, None), (2, "x"), (2, "x")], "n int, s string")
    b = spark.createDataFrame([(2, "x"), (1, None)], "n int, s string")
    assert quality.same_rows(a, b).first().same is True
    assert tuple(quality.same_rows(a, b, distinct=False).first()) == (False, 1, 0)


def test_same_rows_tells_null_from_any_text(spark):
    null = spark.createDataFrame([(None, "a")], "x string, y string")
    for text_ in ("\x02", "", "null", "\x01"):
        assert quality.same_rows(null, spark.createDataFrame([(text_, "a")], "x string, y string")).first().same is False
    assert quality.same_rows(null, null).first().same is True
    a, b = (spark.createDataFrame([rows], "x string, y string") for rows in (("a\x01", "b"), ("a", "\x01b")))
    assert tuple(quality.same_rows(a, b).first()) == (False, 1, 1)


def test_charges_that_differ_in_one_column_are_different(spark):
    base = {k: 1 for k in quality.CHARGE_KEY}
    rows = [{**base, "aid": 1}, {**base, "aid": 2}] + [{**base, k: 2, "aid": 10 + i} for i, k in enumerate(quality.CHARGE_KEY)]
    df = spark.createDataFrame(rows)
    assert len(quality.CHARGE_KEY) == 27
    assert [r.id for r in quality.duplicate_members(df, quality.CHARGE_KEY, "aid").orderBy("id").collect()] == [1, 2]
    assert quality.remove_duplicates(df, quality.CHARGE_KEY, "aid").count() == 28
