"""Training-data pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; ``run`` writes a stage's result to the
shared folder and reads it again for the next one. All stages but the last return the columns of ``documents``. Rows of
null and of repeated ids are judged one by one like all others, extra columns stay, empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempotext.llm import decontaminate, mixing, simhash, substring, toxicity
from tempotext.llm.common import stage


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose noisy-or of sentence probabilities is below 0.5."""
    return toxicity.drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group of near copies: SimHash neighbours and MinHash candidates, each verified (five words, similarity 0.8)."""
    return simhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a document of smaller id holds."""
    return substring.cut_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its source's target and the words the mix takes of it."""
    return mixing.mix(docs, keep=("source",))


STAGES = [("toxicity", toxicity_filter), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("decontamination", decontamination), ("mixing", mixture)]

#: The trained and the fuzzy stages have no SQL form. The tests hold near_dedup (groups), decontamination (scores) and mixing
#: (its query's SQL) against brute force, and toxicity and passage_dedup against planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
