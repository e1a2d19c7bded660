from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from satbill.llm import tokenfile

PATH = public_tokenizers.path("word_bpe_49k.json")
ENCODER = tokenfile._Encoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 10**6), max_size=400), st.booleans())
def test_elias_fano_round_trip(gaps, cumulative):
    values = np.cumsum(gaps).astype(np.uint64) if cumulative else np.sort(np.array(gaps, np.uint64))
    code = tokenfile.EliasFano.from_bytes(tokenfile.EliasFano.of(values).to_bytes())
    places = np.random.default_rng(0).permutation(len(values))
    assert code.select(places).tolist() == values[places].astype(np.int64).tolist()


def test_elias_fano_is_small():
    values = np.arange(0, 100_000 * 300, 300, dtype=np.uint64)
    assert len(tokenfile.EliasFano.of(values).to_bytes()) * 8 / len(values) < 2 + np.log2(300) + 0.1


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("aBcst 'rvelmD\n\té1!<|>İ́&"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=6))
def test_pieces_give_what_whole_texts_give(texts):
    encoder, library = ENCODER
    assert encoder.known
    ids, counts = encoder.texts(texts)
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def plain(rows):
    library, start, out = ENCODER[1], 0, []
    for doc, text in rows:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


ODD = [None, "", " \n", "don't they'll 's", "a<|endoftext|>b", "É é ́x", "ΑΣ Σ", "x\x00y", "tab\tand nbsp", "🙂 中文 1２", "word " * 3000]


@pytest.mark.parametrize("size", [1 << 20, 50])  # small shards too
def test_files_give_back_every_document(spark, docs, prose, monkeypatch, size):
    monkeypatch.setattr(tokenfile, "SHARD_TOKENS", size)
    texts = [*ODD, *(prose(i, i * 13 % 200) for i in range(150))]
    df = docs(texts).orderBy(F.rand(1)).repartition(5).withColumn("ids", F.lit("clash")).withColumn("part", F.lit(1))
    got = tokenfile.written(df, PATH).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert sorted(map(tuple, got)) == plain(list(enumerate(texts)))


def test_shards_joined_without_broadcast(spark, docs, prose, monkeypatch):
    monkeypatch.setattr(tokenfile, "FEW", 0)
    texts = [prose(i, 30) for i in range(40)]
    got = tokenfile.written(docs(texts), PATH).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert sorted(map(tuple, got)) == plain(list(enumerate(texts)))


def test_null_ids_repeats_and_empty(spark, docs):
    rows = [(2, "b", None, None, None), (None, "n", None, None, None), (1, "a a", None, None, None), (2, "b", None, None, None)]
    got = tokenfile.written(docs(rows), PATH).orderBy("start").select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    assert list(map(tuple, got)) == plain([(None, "n"), (1, "a a"), (2, "b"), (2, "b")])
    assert tokenfile.written(docs(rows).limit(0), PATH).count() == 0
