"""A training-data pipeline over `documents`, in five stages.

Every stage works on all rows its predecessor kept and all but the last return the columns of documents. `run` writes the
result of each stage as a table in the shared folder and reads it back for the next, so a lost executor costs at most one
stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from specaudit.llm.decontamination import without_leaks
from specaudit.llm.language_id import in_known_language
from specaudit.llm.ngram_join import one_of_each_group
from specaudit.llm.packing import pack
from specaudit.llm.secret_scan import without_secrets
from specaudit.session import cut

BPE = "byte_bpe_50k.json"
NEAR_WIDTH, NEAR_PERCENT = 5, 80  # looser than the op2 query's 3 words and 90 %
BATCH_ROWS = 1000  # whole documents go through Python workers, which live from stage to stage: batches are kept small


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or in no language that the model knows."""
    _small_batches(spark)
    return in_known_language(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group linked by 5-word shingles with a Jaccard similarity of 0.8 or more."""
    _small_batches(spark)
    return one_of_each_group(docs, NEAR_WIDTH, NEAR_PERCENT)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    _small_batches(spark)
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the text by a mark, and counts the characters anew where the text has changed."""
    _small_batches(spark)
    before = docs.withColumn("n_chars", F.col("n_chars") - F.length("text"))
    clean = without_secrets(before)
    return clean.withColumn("n_chars", F.col("n_chars") + F.length("text")).select(docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2,048 tokens."""
    _small_batches(spark)
    return pack(docs, public_tokenizers.path(BPE))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmarks", benchmarks), ("secrets", secrets), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # language model, randomness tests and token ids are beyond SQL; tests compare with brute force
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
