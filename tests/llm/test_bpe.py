from __future__ import annotations

import base64
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from satbill.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "'", "'s", "x's'll 're'", " 's", "\n's", "a \n b", "  two", "\x00", "\u0085  x", "🙂👩‍👩‍👧", "a" * 3000, "ab" * 700, " " * 600, "1２³ⅷ", "नमस्ते"]


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def pieces():
    return bpe._Pieces(bpe.vocabulary(PATH))


def ids_of(texts, pieces, pattern=bpe.PATTERN):
    ids, counts = bpe.encode_texts(texts, pieces, pattern)
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pattern_is_the_vocabularys():
    assert bpe.PATTERN == public_tokenizers.PATTERN


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcdst 'rvelm\n\té1"), st.characters(exclude_categories=["Cs"])), max_size=40), min_size=1, max_size=6))
def test_equals_the_library(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))} if not hasattr(test_equals_the_library, "own") else None
    if ranks:
        test_equals_the_library.own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), bpe._Pieces(bpe.vocabulary(PATH))
    library, pieces = test_equals_the_library.own
    assert ids_of(texts, pieces) == [library.encode_ordinary(t) for t in texts]


def test_odd_and_long_texts(library, pieces, monkeypatch):
    rnd = random.Random(1)
    texts = [*ODD, "".join(rnd.choice("abcdé") for _ in range(100_000)), *("".join(rnd.choice("abcdé") for _ in range(n)) for n in (511, 512, 513))]
    want = [library.encode_ordinary(t or "") for t in texts]
    assert ids_of(texts, pieces) == want
    assert ids_of(texts, pieces, f"(?:{bpe.PATTERN})") == want  # another spelling goes through the regex library
    monkeypatch.setattr(bpe, "WIDE", 40)  # the heap's merges are the matrix's
    assert ids_of([f"{t}x" for t in ODD], bpe._Pieces(bpe.vocabulary(PATH))) == [library.encode_ordinary(f"{t}x") for t in ODD]


def test_forgetting_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50_300)
    pieces, rnd = bpe._Pieces(bpe.vocabulary(PATH)), random.Random(2)
    for _ in range(8):
        texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(9)) for _ in range(40))]
        assert ids_of(texts, pieces) == [library.encode_ordinary(t) for t in texts]


def test_round_trip_of_a_table(spark, docs, prose, library):
    texts = [*ODD, *(prose(i, i * 7 % 300) for i in range(50))]
    df = docs(texts).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit(1))
    rows = bpe.decoded(bpe.encoded(df, PATH, keep=("doc_id", "text")), PATH).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()


def test_repeats_nulls_and_empty(spark, docs):
    rows = [(1, "a b", None, None, None)] * 3 + [(None, "a b", None, None, None), (None, None, None, None, None)]
    got = bpe.encoded(docs(rows), PATH).collect()
    assert sorted(len(r.ids) for r in got) == [0, 2, 2, 2, 2]
    assert bpe.decoded(bpe.encoded(docs(rows).limit(0), PATH), PATH).count() == 0
