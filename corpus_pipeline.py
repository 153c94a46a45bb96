"""From raw documents to packed sequences: quality rules, near-duplicates, decontamination, secrets, packing."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlens import session
from strainlens.llm import bbit_minhash, best_fit, queries, repetition, secret_scan, tiling


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (shingles of five words, similarity 0.8 or more)."""
    return bbit_minhash.keep(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    return tiling.keep(docs, queries.table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars is counted anew."""
    model = secret_scan.train(secret_scan.labelled_sample(docs))
    return secret_scan.redact(docs, model).withColumn("n_chars", F.length("text").cast("long"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents with their sequences."""
    return best_fit.pack(docs, *queries.vocabulary_file()).drop("row_no")


STAGES = [("quality rules", quality), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("secret scans", secrets), ("best-fit packing", packing)]

# packing needs the tokenizer's ids and an order of arrival, which SQL cannot express
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.cut_lineage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
