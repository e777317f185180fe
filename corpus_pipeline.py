"""Corpus pipeline: stages applied to ``documents`` one after the other.

Each stage gets all that its predecessor kept and returns the columns of documents; the
last returns token digests. Rows that a stage rejects are gone: toxic texts, all but one
of each group of near duplicates, texts that hold a benchmark item. Live secrets are
replaced in place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from waygraph.llm import bpe, decontaminate, secrets, simhash, toxicity
from waygraph.llm.common import discard, stored, swept


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, keep=True)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs, by_fingerprint=True)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_rows(docs, bpe.vocabulary())


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("secrets", secret_stage),
    ("bpe", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again as the next one's docs.

    What a stage read goes once its result is written, and with it the stage's shuffle files.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            out = stored(out, name)
            if at:
                discard(docs)
            swept(spark)
        docs = out
    return docs


#: SQL cannot express the trained, aligned and automaton stages; tests compare with brute force.
ORACLE_SQL = None
