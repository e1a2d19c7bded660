from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows_of(texts, start=0):
    return [(start + i, t, "en", "src0", len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture
def docs(spark):
    """A documents table from texts, or from whole rows."""

    def make(texts):
        rows = [t if isinstance(t, tuple) else None for t in texts]
        return spark.createDataFrame(rows if rows and rows[0] else rows_of(texts), SCHEMA)

    return make


@pytest.fixture
def prose():
    """Random words; equal seeds give equal texts."""

    def make(seed, n, vocabulary=400):
        rnd = random.Random(seed)
        return " ".join(f"w{rnd.randrange(vocabulary)}" for _ in range(n))

    return make


def edited(text, seed, share=0.02):
    rnd = random.Random(seed)
    return " ".join(f"x{rnd.randrange(9)}" if rnd.random() < share else w for w in text.split(" "))
