"""Delimited sinks, multi-table reports, nested run summaries, compaction."""
from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = ("fold string, test struct<accuracy: double, classification_report: map<string, struct<`f1-score`: double, support: double>>, "
              "confusion_matrix: array<array<bigint>>>, test_timing struct<total_time_sec: double, samples_per_sec: double>, device_info struct<name: string>")
# Fixed value: names of single profile files.
PROFILE_NAME = r"^(\w+?)_batch(\d+)_sample(\d+)_class(\d+)(?:_target(\d+)_pred(\d+))?_(attn|gxi)\.npy$"


def write_delimited(df: DataFrame, path: str, sep: str = ",", null: str = "", mode: str = "overwrite") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).option("nullValue", null).csv(path)


def read_delimited(spark: SparkSession, path: str, schema, sep: str = ",", null: str = "") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", True).option("nullValue", null).csv(path)


def write_report(tables: Mapping[str, DataFrame], root: str, parameters: Mapping | None = None) -> DataFrame:
    """One folder per table and a manifest table (name, rows, parameters)."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
    counts = None
    for name in tables:
        one = spark.read.parquet(f"{root}/{name}").agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    manifest = counts.withColumn("parameters", F.lit(json.dumps(dict(parameters or {}), sort_keys=True)))
    manifest.write.mode("overwrite").parquet(f"{root}/_manifest")
    return spark.read.parquet(f"{root}/_manifest")


def read_report(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a written report, without recomputing it."""
    return spark.read.parquet(f"{root}/{name}")


def export_report(spark: SparkSession, root: str, target: str, names: list[str], sep: str = ",") -> None:
    """Cached tables of a report as delimited text."""
    for name in names:
        write_delimited(read_report(spark, root, name), f"{target}/{name}", sep)


def read_runs(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """Run summaries (JSON lists of folds): accuracy, per-class F1 (null where a
    class is absent), confusion matrix, timing, device."""
    raw = spark.read.option("multiLine", True).schema(RUN_SCHEMA).json(path)
    report = F.col("test.classification_report")
    f1 = [F.try_element_at(report, F.lit(c))["f1-score"].alias(f"f1_{c}") for c in classes]
    keep = [c for c in raw.columns if c not in ("test", "test_timing", "device_info")]
    return raw.select(*keep, F.col("test.accuracy").alias("accuracy"), *f1, F.col("test.confusion_matrix").alias("confusion_matrix"),
                      F.col("test_timing.total_time_sec").alias("total_time_sec"), F.col("test_timing.samples_per_sec").alias("samples_per_sec"),
                      F.col("device_info.name").alias("device"))


def profile_keys(df: DataFrame, file: str = "file") -> DataFrame:
    """Subset, batch, sample, class and, for gradient scores, target and
    predicted class, from the file name; other names are dropped."""
    def part(i):
        x = F.regexp_extract(file, PROFILE_NAME, i)
        return F.when(F.length(x) > 0, x)
    rows = df.filter(F.col(file).rlike(PROFILE_NAME))
    return rows.select("*", part(1).alias("subset"), part(2).cast("bigint").alias("batch_idx"), part(3).cast("bigint").alias("sample_idx"), part(4).cast("int").alias("label"),
                       part(5).cast("int").alias("target"), part(6).cast("int").alias("pred"), part(7).alias("score_type"))


def compact_profiles(singles: DataFrame, path: str, overwrite: bool = False) -> None:
    """Per-sample profiles as one partitioned table; an existing table is kept
    unless ``overwrite``."""
    mode = "overwrite" if overwrite else "ignore"
    profile_keys(singles).write.mode(mode).partitionBy("score_type", "subset", "fold").parquet(path)
