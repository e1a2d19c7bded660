"""The stages of the corpus pipeline: each applies one operator's decisions to its predecessor's documents.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from satbill.llm import bpe, mixing, simhash, substring, toxicity
from satbill.sources.snapshot import snapshot

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REJECT = 0.3
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below ``REJECT``. The model learns from the labelled documents whose crc32 modulo 4 is not 2."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fitted(docs, labels, lambda key: F.crc32(key.cast("string").cast("binary")) % 4 != 2)
    scored = toxicity.scored(docs, model, keep=tuple(COLUMNS))
    return scored.where(F.col("score") < REJECT).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one row: the smallest doc_id, none last, then the text by its hash, then the first by its columns.

    Groups are the near-duplicate operator's: words in shingles of four, fingerprints linked at four bits. Every row counts by its
    own text, also where texts share a doc_id. Rows are told apart by a 128-bit hash of doc_id and text.
    """
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    docs = docs.select(*COLUMNS).withColumn("row_key", F.unhex(F.md5(named)))
    member = simhash.grouped(docs, ("doc_id", "row_key"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row_key")).alias("first")
    kept = snapshot(member.groupBy("root").agg(first).select("first.row_key"), "near-kept")
    again = Window.partitionBy("row_key").orderBy("lang", "source", "n_chars")
    rows = docs.join(kept, "row_key").withColumn("nth", F.row_number().over(again))  # equal rows only
    return rows.where("nth = 1").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of 50-word windows that a document with a smaller doc_id has too.

    A text that loses words becomes its other words joined by a space, n_chars follows; a document that loses all goes.
    """
    docs = docs.select(*COLUMNS).withColumn("text_hash", F.xxhash64("text"))
    _, cut = substring.repeats(docs)
    cut = cut.select(F.col("doc_id").alias("cut_id"), F.col("text_hash").alias("cut_hash"), F.col("kept").cast("string").alias("kept"))
    rows = docs.join(cut, (F.col("doc_id") == F.col("cut_id")) & (F.col("text_hash") == F.col("cut_hash")), "left")
    rows = rows.where("kept IS NULL OR kept <> ''")
    return rows.select(
        "doc_id", F.coalesce("kept", "text").alias("text"), "lang", "source",
        F.when(F.col("kept").isNull(), F.col("n_chars")).otherwise(F.length("kept").cast("long")).alias("n_chars"),
    )


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per pass of the mix over a document: whole texts as they are, parts as their words joined by a space.

    Documents of which the mix takes nothing go. n_chars follows the text.
    """
    return mixing.taken_texts(docs.select(*COLUMNS))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_tokens, and the digests of the ids and of the bytes they decode to, per row."""
    rows = bpe.encoded(docs, RANKS, public_tokenizers.PATTERN, keep=("doc_id", "source"))
    return bpe.decoded(rows, RANKS).select(
        "doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
