"""Corpus pipeline: quality, near duplicates, repeated strings, benchmark leaks, then the mix.

Every stage takes (spark, docs, sf_dir) and returns rows with the columns of its
input; the last adds how many copies the mix takes. ``run`` writes each stage's
result to the shared folder and reads it again, so that a lost executor costs
one stage's work at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm import crf, decontaminate, mixing, ngram_join, suffix_dedup
from rankloom.llm.scratch import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: documents that the line model rejects go."""
    return crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: of every group of linked documents the one with the smallest id stays."""
    return ngram_join.keep_one(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: byte strings that occur earlier are cut from the texts."""
    return suffix_dedup.without_repeats(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that hold a test item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents that the mix takes, with their copies."""
    rows = docs.select("doc_id", "source", "text", F.struct("*").alias("_row"))
    name = "mix_copies" if "copies" in docs.columns else "copies"
    return mixing.mix(rows, keep=("_row",)).where("copies > 0").select("_row.*", F.col("copies").alias(name))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_leaks", benchmark_leaks),
    ("mix", mix),
]

#: the stages learn models and draw samples, which SQL doesn't express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), name)
        if k:
            scratch.drop(STAGES[k - 1][0])
    return docs
