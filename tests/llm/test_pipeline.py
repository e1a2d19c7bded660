from __future__ import annotations

import os
import random
import sys

import public_tokenizers
import tiktoken

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
from satbill.llm import bpe, queries, stages

from .conftest import SCHEMA, edited
from .test_classifiers import LABELS, toxic_rows
from .test_substring import plain as plain_repeats

ORDER = ["toxicity", "near_duplicates", "repeated_passages", "mixing", "bpe"]


def folder(spark, path, rows, labels):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_stages_take_effect(spark, tmp_path, prose):
    rows, labels = toxic_rows(600, prose)
    rnd = random.Random(1)
    hot = prose(999, 80)
    rows = [(i, t if rnd.random() < 0.9 else f"{t} {hot}", lang, f"src{i % 4}", len(t)) for i, t, lang, _, _ in rows]
    copies = [(10_000 + i, edited(prose(50, 300), i, 0.004), "en", "src1", 1) for i in range(30)]
    rows += copies + [(20_000, None, None, None, None), (20_001, "", None, None, None), (None, hot, None, "src0", None), rows[3]]
    at = folder(spark, tmp_path, rows, labels)
    assert [name for name, _ in corpus_pipeline.STAGES] == ORDER
    docs, kept = spark.read.parquet(f"{at}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, at)
        docs.write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        kept[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == stages.COLUMNS
    toxic = {d for d, _, t in labels if t}
    ids = lambda name: [r.doc_id for r in kept[name]]
    assert not toxic & set(ids("toxicity")) and len(ids("toxicity")) >= len(rows) - len(toxic) - 5
    near = ids("near_duplicates")
    assert len(near) == len(set(near)) and sum(d is not None and 10_000 <= d < 20_000 for d in near) <= 3
    assert set(near) <= set(ids("toxicity")) and len(near) >= 480
    want = {r[0]: r for r in plain_repeats([(r.doc_id, r.text) for r in kept["near_duplicates"]])}
    assert all(len((r.text or "").split()) == want[str(r.doc_id)][1] - want[str(r.doc_id)][2] for r in kept["repeated_passages"])
    assert sum(hot in (r.text or "") for r in kept["repeated_passages"] if r.doc_id is not None) == 1
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.vocabulary(stages.RANKS).ids, special_tokens={})
    assert sorted((str(r.doc_id), r.ids) for r in kept["bpe"]) == sorted((str(r.doc_id), library.encode_ordinary(r.text or "")) for r in kept["mixing"])
    assert corpus_pipeline.run(spark, at).count() == len(kept["bpe"])


def test_empty_tables(spark, tmp_path):
    at = folder(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, at).count() == 0


def test_a_query_for_each_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)
