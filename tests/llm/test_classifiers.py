from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from satbill.llm import langid, toxicity

WORDS = {"en": "the of and to in that is was he for it with as his on be at by".split(),
         "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein".split(),
         "fr": "le de un à être et en avoir que pour dans ce il qui ne sur se pas".split()}


def spoken(lang, seed, n=60):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(WORDS[lang]) for _ in range(n))


def lang_rows(n, start=0):
    langs = sorted(WORDS)
    return [(start + i, spoken(langs[i % 3], start + i), langs[i % 3], "s", 1) for i in range(n)]


def test_languages_held_out(spark, docs):
    rows = lang_rows(600)
    df = docs(rows).withColumn("score", F.lit("clash")).withColumn("grams", F.lit(1))
    model = langid.fitted(df, lambda key: key % 5 != 0)
    got = {r.doc_id: r for r in langid.predicted(df, model).collect()}
    held = [r for r in rows if r[0] % 5 == 0]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) >= 0.98
    assert all(1 / 3 <= got[r[0]].score <= 1 for r in held)
    again = langid.fitted(df.orderBy(F.rand(3)).repartition(7), lambda key: key % 5 != 0)
    assert again[0] == model[0] and np.array_equal(again[2], model[2])  # the rows' order teaches nothing


def test_language_of_odd_texts(spark, docs):
    model = langid.fitted(docs(lang_rows(300)), lambda key: key % 5 != 0)
    rows = [(1, None, None, None, None), (2, "", None, None, None), (3, "123 !? _", None, None, None), (None, spoken("de", 1), None, None, None),
            (4, spoken("fr", 2).upper(), "de", None, None), (4, spoken("fr", 2).upper(), "de", None, None), (5, spoken("en", 3, 200_000), None, None, None)]
    got = sorted((str(r.doc_id), r.lang_pred, r.score > 0) for r in langid.predicted(docs(rows), model).collect())
    assert got == [("1", "und", False), ("2", "und", False), ("3", "und", False), ("4", "fr", True), ("4", "fr", True), ("5", "en", True), ("None", "de", True)]
    assert langid.predicted(docs(rows).limit(0), model).count() == 0


def test_language_without_teachers(spark, docs):
    rows = [(1, "text", None, None, None), (None, "text", "en", None, None), (2, None, "en", None, None), (3, "12", "en", None, None)]
    for df in (docs(rows), docs(rows).limit(0)):
        got = langid.predicted(docs(rows), langid.fitted(df, lambda key: key > 0)).collect()
        assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_frequencies_count_every_text(spark, docs):
    texts = [r[1] for r in lang_rows(200)] + ["", None]
    per_text = [np.unique(gram) for t in texts for _, _, _, _, gram in langid._grams([t])]
    counts = np.bincount(np.concatenate(per_text), minlength=1 << langid.BITS)
    got = langid.inverse_frequencies(docs(texts).repartition(5))
    assert np.allclose(got, np.log(203 / (1 + counts)) + 1)


def test_temperature_calibrates():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3))
    y = np.array([rng.choice(3, p=np.exp(x) / np.exp(x).sum()) for x in logits])
    assert 0.85 < langid.temperature(logits, y) < 1.18
    assert 2.6 < langid.temperature(3 * logits, y) < 3.5


def toxic_rows(n, prose):
    bad = ["moron", "scum", "trash"]
    rows, labels = [], []
    for i in range(n):
        toxic, words = i % 5 == 0, prose(i, 30 + i * 7 % 200).split()
        for w in random.Random(i).sample(bad, 2) if toxic else []:
            words.insert(random.Random(i).randrange(len(words)), w.upper() + ("!" if i % 2 else ""))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, 1, int(toxic)))
    return rows, labels


LABELS = "doc_id long, quality int, toxic int"


def test_toxic_held_out(spark, docs, prose):
    rows, labels = toxic_rows(1500, prose)
    df = docs(rows).withColumn("score", F.lit("clash")).withColumn("toxic", F.lit(0)).withColumn("k0", F.lit(1))
    told = spark.createDataFrame(labels, LABELS)
    model = toxicity.fitted(df, told, lambda key: key % 4 != 2)
    got = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    held = [(got[d], t) for d, _, t in labels if d % 4 == 2]
    assert np.mean([(s >= 0.3) == bool(t) for s, t in held]) >= 0.99
    assert (model[1] != 0).sum() < 2000  # of a million: the penalty keeps the model short
    again = toxicity.fitted(df.repartition(6).orderBy(F.rand(2)), told, lambda key: key % 4 != 2)
    assert again[0] == model[0] and np.array_equal(again[1], model[1])


def test_toxicity_of_odd_texts_and_labels(spark, docs, prose):
    rows, labels = toxic_rows(400, prose)
    labels += [(None, 1, 1), (3, 1, None), (5, 1, 0), (5, 1, 1), (10**6, 1, 1)]
    model = toxicity.fitted(docs(rows), spark.createDataFrame(labels, LABELS), lambda key: key > -1)
    odd = [(1, None, None, None, None), (2, "", None, None, None), (None, "a moron and scum", None, None, None), (4, prose(1, 400_000), None, None, None), (4, "x", None, None, None)]
    got = toxicity.scored(docs(odd), model, keep=("doc_id", "lang")).collect()
    bias = 1 / (1 + np.exp(-model[0]))
    by_id = {}
    for r in got:
        by_id.setdefault(r.doc_id, []).append(r.score)
    assert by_id[1] == by_id[2] == [bias] and len(by_id[4]) == 2 and by_id[None][0] > bias
    assert toxicity.scored(docs(odd).limit(0), model).count() == 0
    nothing = toxicity.fitted(docs(rows), spark.createDataFrame([], LABELS), lambda key: key > -1)
    assert nothing is None and {r.score for r in toxicity.scored(docs(odd), nothing).collect()} == {0.0}


def test_features_keep_to_their_text(prose):
    texts = [prose(1, 50), None, "", "one", prose(2, 30)]
    alone = [set(f.tolist()) for t in texts for _, _, _, f in toxicity._features([t], toxicity._Words())]
    ((first, count, owner, feature),) = toxicity._features(texts, toxicity._Words())
    assert (first, count) == (0, 5)
    assert [set(feature[owner == i].tolist()) for i in range(5)] == alone
