"""A corpus pipeline over ``documents``; each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from satbill.llm import stages
from satbill.sources.snapshot import snapshot

STAGES = [
    ("toxicity", stages.drop_toxic),
    ("near_duplicates", stages.drop_near_duplicates),
    ("repeated_passages", stages.cut_repeats),
    ("mixing", stages.mix),
    ("bpe", stages.encode),
]

ORACLE_SQL = None  # trained weights and byte-pair merges are beyond SQL; tests compare the stages with plain versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = snapshot(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
