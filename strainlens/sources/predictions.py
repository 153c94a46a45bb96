"""Prediction and profile tables: partitioned Parquet scans and sinks."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlens.session import open_files

PROFILE_SCHEMA = "sample bigint, class int, scores array<double>, valid array<boolean>, fold int"
PREDICTION_SCHEMA = "index bigint, y_true int, y_pred int, prob array<double>, protocol string, model string, fold string"


def write_profiles(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per fold; rows of a fold stay spread over several files."""
    df.write.mode(mode).partitionBy("fold").parquet(path)


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PROFILE_SCHEMA).parquet(path)


def write_predictions(df: DataFrame, path: str, n_classes: int = 4, mode: str = "overwrite") -> None:
    """index, y_true, y_pred, prob_0 .. prob_{C-1}, partitioned by run and fold."""
    probs = [F.get("prob", F.lit(c)).alias(f"prob_{c}") for c in range(n_classes)]
    # a task's rows are not sorted by folder, so its memory does not go with them
    with open_files(df.sparkSession):
        df.select("index", "y_true", "y_pred", *probs, "protocol", "model", "fold").write.mode(mode).partitionBy(
            "protocol", "model", "fold").parquet(path)


def read_predictions(spark: SparkSession, path: str, n_classes: int = 4, with_index: bool = True) -> DataFrame:
    cols = (["index bigint"] if with_index else ["ordinal bigint"]) + ["y_true int", "y_pred int"]
    cols += [f"prob_{c} double" for c in range(n_classes)] + ["protocol string", "model string", "fold string"]
    return spark.read.schema(", ".join(cols)).parquet(path).withColumn(
        "index_source", F.lit("prediction_file" if with_index else "split_file_fallback"))


def recover_index(preds: DataFrame, test_order: DataFrame, tasks: int | None = None) -> DataFrame:
    """Indices for predictions stored without them.

    ``preds`` holds (protocol, model, fold, ordinal, ...), ``test_order`` holds
    (protocol, fold, ordinal, index): the stored order of the test split.
    A length mismatch between a fold's predictions and its test list raises.
    ``tasks``: tasks of the join, where the caller knows how many rows there are.
    """
    keys = ["protocol", "fold", "ordinal"]
    n_p = preds.groupBy("protocol", "model", "fold").agg(F.count(F.lit(1)).alias("n_pred"))
    n_t = test_order.groupBy("protocol", "fold").agg(F.count(F.lit(1)).alias("n_test"))
    sizes = n_p.where("protocol IS NOT NULL AND model IS NOT NULL AND fold IS NOT NULL").join(n_t, ["protocol", "fold"], "left").select(
        F.when(F.col("n_pred") == F.col("n_test"), True).otherwise(F.raise_error(F.concat(
            F.lit("length mismatch in fold "), F.col("fold"))).cast("boolean")).alias("_same"))
    # one answer for all: joined to the predictions, the lengths would be looked up for every row
    checked = preds.where(sizes.agg(F.bool_and("_same")).scalar()).where(F.col("model").isNotNull())
    order = test_order.select(*keys, "index")
    if tasks:
        # tasks of known size hold their part of the order, so neither side is sorted
        checked, order = dealt(checked, keys, tasks), dealt(order, keys, tasks).hint("shuffle_hash")
    found = checked.join(order, keys)
    return found.select(*keys, *[c for c in preds.columns if c not in keys], "index").withColumn("index_source", F.lit("split_file_fallback"))


def dealt(df: DataFrame, keys: list[str], tasks: int) -> DataFrame:
    """Rows dealt to a stated number of tasks, which adaptive execution leaves as they are."""
    return df.repartition(tasks, *keys)


def unique_out_of_fold(preds: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per (protocol, model, index); a repeated index raises.

    Rows go to their index as they are: the aggregate holds texts, so it sorts,
    and before the exchange it would sort all rows and combine none.
    """
    keys = ["index", "protocol", "model"]
    rest = [c for c in preds.columns if c not in keys]
    spread = preds.repartition(tasks, "index") if tasks else preds.repartition("index")
    out = spread.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"), F.count(F.lit(1)).alias("_n"))
    ok = F.when(F.col("_n") == 1, F.col("index")).otherwise(F.raise_error(F.concat(
        F.lit("duplicate held-out index "), F.col("index").cast("string"))).cast("bigint"))
    return out.select("protocol", "model", ok.alias("index"), *[F.col(f"_r.{c}").alias(c) for c in rest])
