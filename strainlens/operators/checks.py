"""Validation tables.  Each returns rows that describe a problem, or a verdict
column; ``require_empty`` turns a problem table into an error."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlens import constants as C


def require_empty(problems: DataFrame, message: str) -> None:
    """Raise with a short preview when the problem table has rows."""
    preview = problems.limit(10).collect()
    if preview:
        raise ValueError(f"{message}: {[r.asDict() for r in preview]}")


def split_validity(splits: DataFrame, n_samples: int | None = None, total: DataFrame | None = None) -> DataFrame:
    """Per fold: sizes, index bounds, out-of-range and overlapping indices."""
    per_index = splits.groupBy("fold", "index").agg(
        *[F.max((F.col("split") == s).cast("int")).alias(f"in_{s}") for s in ("train", "val", "test")],
        *[F.count_if(F.col("split") == s).alias(f"n_{s}") for s in ("train", "val", "test")],
    )
    if n_samples is None:
        n = total.agg(F.count(F.lit(1)).alias("n")).scalar()
    else:
        n = F.lit(n_samples)
    per_index = per_index.withColumn("_n", n)
    out = per_index.groupBy("fold").agg(
        *[F.sum(f"n_{s}").alias(f"n_{s}") for s in ("train", "val", "test")],
        F.min("index").alias("min_index"), F.max("index").alias("max_index"),
        F.count_if((F.col("index") < 0) | (F.col("index") >= F.col("_n"))).alias("out_of_range"),
        F.count_if(F.col("in_train") + F.col("in_val") == 2).alias("overlap_train_val"),
        F.count_if(F.col("in_train") + F.col("in_test") == 2).alias("overlap_train_test"),
        F.count_if(F.col("in_val") + F.col("in_test") == 2).alias("overlap_val_test"),
    )
    ok = ((F.col("n_train") > 0) & (F.col("n_val") > 0) & (F.col("out_of_range") == 0)
          & (F.col("overlap_train_val") + F.col("overlap_train_test") + F.col("overlap_val_test") == 0))
    return out.withColumn("status", F.when(ok, "PASS").otherwise("FAIL"))


def conflicting_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that carry more than one value."""
    return (
        df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
        .filter(F.col("_lo") != F.col("_hi"))
        .select(key, F.col("_lo").alias("first_value"), F.col("_hi").alias("other_value"))
    )


def unique_mapping(df: DataFrame, key: str, value: str) -> DataFrame:
    """One value per key; keys with more than one value raise."""
    out = df.groupBy(key).agg(F.min(value).alias(value), F.max(value).alias("_hi"))
    message = F.concat(F.lit(f"more than one {value} for {key} "), F.col(key).cast("string"))
    return out.select(key, F.when(F.col(value).eqNullSafe(F.col("_hi")), F.col(value)).otherwise(
        F.raise_error(message)).alias(value))


def length_histogram(df: DataFrame, sequence: str, keys: Sequence[str] = ()) -> DataFrame:
    """Records per length; an alignment has exactly one length per key."""
    return df.groupBy(*keys, F.length(sequence).alias("length")).agg(F.count(F.lit(1)).alias("n"))


def alignment_status(df: DataFrame, sequence: str, keys: Sequence[str]) -> DataFrame:
    return (
        length_histogram(df, sequence, keys).groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("n_lengths"), F.min("length").alias("min_length"), F.max("length").alias("max_length"),
             F.sum("n").alias("n_records"))
        .withColumn("status", F.when(F.col("n_lengths") == 1, "PASS").otherwise("FAIL"))
    )


def label_or_unknown(df: DataFrame, label, name: str, drop_unknown: bool) -> DataFrame:
    """Rows without a class are dropped or kept as UNKNOWN."""
    out = df.withColumn(name, label)
    return out.filter(F.col(name).isNotNull()) if drop_unknown else out.withColumn(
        name, F.coalesce(F.col(name), F.lit("UNKNOWN")))


def minimum_length(df: DataFrame, sequence: str, expected, share: float = C.MIN_REGION_SHARE) -> DataFrame:
    """Rows at least ``share`` of the expected length."""
    return df.filter(F.length(sequence) >= expected * F.lit(share))


def minimum_length_counts(df: DataFrame, key: str, sequence: str, expected, share: float = C.MIN_REGION_SHARE) -> DataFrame:
    ok = F.length(sequence) >= expected * F.lit(share)
    return df.groupBy(key).agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("skipped_short"))


def reconcile_totals(named: Sequence[tuple[str, DataFrame]], key: str, n: str = "n") -> DataFrame:
    """Totals per key from several sources side by side with their difference."""
    rows = None
    for name, df in named:
        part = df.select(F.col(key), F.lit(name).alias("_source"), F.col(n).alias("_n"))
        rows = part if rows is None else rows.unionByName(part)
    first = named[0][0]
    out = rows.groupBy(key).agg(*[
        F.coalesce(F.sum(F.when(F.col("_source") == name, F.col("_n"))), F.lit(0)).alias(name) for name, _ in named])
    diff = F.greatest(*[F.col(name) for name, _ in named]) - F.least(*[F.col(name) for name, _ in named])
    return out.withColumn("difference", diff).withColumn(
        "status", F.when(F.col("difference") == 0, "PASS").otherwise(F.concat(F.lit("differs from "), F.lit(first))))


def missing_audit(df: DataFrame, checks: dict) -> DataFrame:
    """Rows failing each check, counted in one pass, as a long table."""
    one = df.agg(*[F.count_if(cond).alias(name) for name, cond in checks.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("check"), F.col(name).alias("n")) for name in checks])
    return one.select(F.explode(pairs).alias("p")).select("p.*")


def preview(df: DataFrame, condition, order: Sequence[str]) -> DataFrame:
    """All rows that meet a condition, in order."""
    return df.filter(condition).orderBy(*order)


def fold_alignment(df: DataFrame, model: str, fold: str, metrics: Sequence[str]) -> DataFrame:
    """Fold count, duplicates and missing values per model, and whether every
    model has the same folds."""
    per = df.groupBy(model).agg(
        F.count(F.lit(1)).alias("n_rows"), F.countDistinct(fold).alias("n_folds"),
        F.array_join(F.sort_array(F.collect_set(F.col(fold).cast("string"))), ",").alias("folds"),
        *[F.count(m).alias(f"n_{m}") for m in metrics],
    )
    same = per.agg((F.min("folds") == F.max("folds")).alias("_same"))
    complete = F.col("n_rows") == F.col("n_folds")
    for m in metrics:
        complete = complete & (F.col(f"n_{m}") == F.col("n_folds"))
    return per.withColumn("aligned", complete & same.scalar())
