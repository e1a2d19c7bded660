"""The registered query of each operator, over its whole table, and the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from satbill.llm import ann, audit, bpe, chat, collocations, extract, langid, mixing, simhash, substring, tokenfile, topk, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BPE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def _remainder(column, n: int):
    """crc32 of the id as text, modulo n; a null id gives null."""
    return F.crc32(column.cast("string").cast("binary")) % n


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_table(spark, sf_dir, "embeddings"), lambda key: key % 50 == 0, k=5).select("query_id", "rank", "vec_id", "score")


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fitted(docs, lambda key: _remainder(key, 5) != 0)
    return langid.predicted(docs, model).select(
        "doc_id", F.coalesce(_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, cut = substring.repeats(_table(spark, sf_dir, "documents"))
    cut = cut.select("doc_id", "text_hash", F.col("n_removed").alias("removed"), F.sha2("kept", 256).alias("sha"))
    return rows.join(cut, ["doc_id", "text_hash"], "left").select(
        "doc_id", "n_words", F.coalesce("removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("sha", F.lower(F.hex("words_sha"))).alias("kept_sha256"),
    )


def op6_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    found = ann.search(ann.index(vectors), vectors.where("vec_id % 100 = 0"), k=10)
    return found.select("query_id", "rank", "vec_id", "score")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.repaired(_table(spark, sf_dir, "conversations"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(_table(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)
    return bpe.decoded(rows, BPE_RANKS).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokenfile.written(_table(spark, sf_dir, "documents"), WORD_BPE)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fitted(docs, _table(spark, sf_dir, "labels"), lambda key: _remainder(key, 4) != 2)
    return toxicity.scored(docs, model).select(
        "doc_id", F.coalesce(_remainder(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audited(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return extract.extracted(pages, extract.fitted(pages))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_mixing": op2_mixing,
    "op3_topk": op3_topk,
    "op4_langid": op4_langid,
    "op5_substring": op5_substring,
    "op6_hnsw": op6_hnsw,
    "op7_chat": op7_chat,
    "op8_bpe": op8_bpe,
    "op9_token_files": op9_token_files,
    "op10_toxicity": op10_toxicity,
    "op11_filter_audit": op11_filter_audit,
    "op12_html_extraction": op12_html_extraction,
    "op13_collocations": op13_collocations,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.ORACLE_SQL,
    "op3_topk": topk.ORACLE_SQL,
    "op5_substring": substring.ORACLE_SQL,
    "op11_filter_audit": audit.ORACLE_SQL,
    "op13_collocations": collocations.ORACLE_SQL,
}
