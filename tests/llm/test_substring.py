from __future__ import annotations

import hashlib
import random

from pyspark.sql import functions as F

from satbill.llm import substring


def plain(rows):
    """(doc_id, n_words, n_removed, kept_sha256) by a table of all windows."""
    first = {}
    split = [(doc, (text or "").encode().split()) for doc, text in rows]
    for doc, words in split:
        for i in range(len(words) - 49):
            w = tuple(words[i : i + 50])
            if doc is not None:
                first[w] = min(doc, first.get(w, doc))
    out = []
    for doc, words in split:
        gone = set()
        for i in range(len(words) - 49):
            if doc is not None and first[tuple(words[i : i + 50])] < doc:
                gone.update(range(i, i + 50))
        kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
        out.append((str(doc), len(words), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    rows, cut = substring.repeats(df)
    cut = cut.select("doc_id", "text_hash", "n_removed", F.sha2("kept", 256).alias("sha"))
    got = rows.join(cut, ["doc_id", "text_hash"], "left").collect()
    return sorted((str(r.doc_id), r.n_words, r.n_removed or 0, r.sha or r.words_sha.hex()) for r in got)


def test_against_brute_force(spark, docs, prose):
    rnd = random.Random(1)
    passages = [prose(1000 + i, n) for i, n in enumerate([50, 51, 60, 90, 200, 49, 400])]
    texts = []
    for i in range(60):
        parts = [prose(i, rnd.randrange(0, 120))]
        for _ in range(rnd.randrange(0, 3)):
            p = rnd.choice(passages).split(" ")
            a = rnd.randrange(0, max(1, len(p) - 40))
            parts += [" ".join(p[a : a + rnd.randrange(30, 300)]), prose(5000 + rnd.randrange(10**6), rnd.randrange(0, 20))]
        texts.append("\n".join(parts))
    texts += [texts[3], texts[5], "", None, " \t", "same " * 130, "same " * 70, "a b " * 60, "b a " * 45, passages[0], passages[0].replace(" ", "  "), passages[4].upper()]
    rnd.shuffle(texts)
    df = docs(texts).withColumn("mini", F.lit(1)).withColumn("kept", F.lit("clash"))
    assert found(df) == plain([(r.doc_id, r.text) for r in df.collect()])


def test_hot_passage_and_repeats(spark, docs, prose):
    hot = prose(7, 80)
    rows = [(i, f"{prose(i, 30)} {hot} {prose(900 + i, 30)}", None, None, None) for i in range(150)]
    rows += [(3, rows[3][1], None, None, None), (3, hot, None, None, None), (None, hot, None, None, None), (None, None, None, None, None)]
    assert found(docs(rows)) == plain([(r[0], r[1]) for r in rows])
    assert found(docs(rows).limit(0)) == []


def test_spans_do_not_grow_with_equal_rows(spark, docs, prose, monkeypatch):
    text, sizes = prose(1, 300), []
    seen = substring.snapshot

    def watched(df, name="part"):
        df = seen(df, name)
        if name == "repeats-texts":
            sizes.append(df.agg(F.max(F.size("spans"))).first()[0])
        return df

    monkeypatch.setattr(substring, "snapshot", watched)
    for copies in (1, 600):
        rows = [(1, text, None, None, None)] + [(2, f"{prose(2, 20)} {text}", None, None, None)] * copies
        assert found(docs(rows)) == plain([(r[0], r[1]) for r in rows])
    assert sizes[0] == sizes[1] > 0


def test_long_text(spark, docs, prose):
    long = prose(1, 350_000, vocabulary=50_000)
    rows = [(1, "x " + long, None, None, None), (2, long, None, None, None), (3, "short " + long[:3000], None, None, None)]
    assert found(docs(rows)) == plain([(r[0], r[1]) for r in rows])
