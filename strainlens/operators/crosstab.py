"""Count tables by class, fold, split and group."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens.functions import text as tx


def cross_tab(df: DataFrame, row: str, column: str, columns: Sequence[str], row_order: Sequence[str] | None = None,
              drop_unknown: bool = False) -> DataFrame:
    """Counts per (row, column value): fixed columns, zero fill.

    ``row_place`` sorts the rows: the given order first, other rows by value,
    ``Unknown`` last when no order is given.  With ``row_order`` only listed
    rows stay unless ``drop_unknown`` asks for the variant that keeps extra
    rows after the listed ones and drops ``Unknown`` column values.
    """
    if drop_unknown:
        df = df.filter(F.col(column) != C.UNKNOWN)
    out = df.groupBy(row).agg(*[F.count_if(F.col(column) == c).alias(c) for c in columns])
    if row_order is not None:
        at = F.array_position(F.array(*[F.lit(x) for x in row_order]), F.col(row))
        if not drop_unknown:
            out = out.filter(at > 0)
        first = F.when(at > 0, at).otherwise(len(row_order) + 1)
    else:
        first = F.when(F.col(row) == C.UNKNOWN, 2).otherwise(1)
    # one row per distinct row value
    place = F.row_number().over(Window.orderBy(first, F.col(row)))
    return out.withColumn("row_place", place)


def with_missing_rows(table: DataFrame, row: str, values: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Listed rows that did not occur are added with zeros."""
    dim = table.sparkSession.createDataFrame([(v,) for v in values], f"{row} string")
    return dim.join(table, row, "left").select(row, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in columns])


def fold_profile(df: DataFrame, classes: Sequence[str], continents: Sequence[str], bins: Sequence[str]) -> DataFrame:
    """Totals, metadata found and missing, and counts per class, continent and
    year bin for every fold, in one aggregate."""
    def n(col, values):
        return [F.count_if(F.col(col) == v).alias(f"{v}_sequences") for v in values]
    return df.groupBy("fold").agg(
        F.count(F.lit(1)).alias("total_sequences"),
        F.sum("metadata_found").alias("metadata_found"),
        F.count_if(F.col("metadata_found") == 0).alias("metadata_missing"),
        *n("class", classes), *n("continent", continents), *n("year_bin", bins),
        F.count_if(F.col("continent") == C.UNKNOWN).alias("Unknown_continent_sequences"),
        F.count_if(F.col("year_bin") == C.UNKNOWN).alias("Unknown_year_sequences"),
    ).withColumn("fold_no", tx.fold_number(F.col("fold")))


def split_summary(splits: DataFrame) -> DataFrame:
    return splits.groupBy("fold", "split", "class").agg(F.count(F.lit(1)).alias("n"))


def class_shares(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Count and share per listed class, zero where a class is absent."""
    one = df.agg(*[F.count_if(F.col(column) == c).alias(c) for c in classes])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias(column), F.col(f"`{c}`").alias("n")) for c in classes]))
    total = sum((F.col(f"`{c}`") for c in classes[1:]), F.col(f"`{classes[0]}`"))
    return one.select(total.alias("_total"), pairs.alias("p")).select(
        f"p.{column}", "p.n", F.when(F.col("_total") > 0, F.col("p.n") / F.col("_total")).alias("share"))


def class_weights(df: DataFrame, column: str) -> DataFrame:
    """1 - n_c / N per class."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    # one row per class
    total = F.sum("n").over(Window.partitionBy())
    return counts.select(column, "n", (1 - F.col("n") / total).alias("weight"))


def subset_shapes(df: DataFrame, subset: str, column: str, classes: Sequence[int], length, channels: int) -> DataFrame:
    """Shape (N, L, E) and class-count text per subset and for ``all``."""
    per = df.groupBy(subset).agg(
        F.count(F.lit(1)).alias("n"), F.max(length).alias("l"),
        *[F.count_if(F.col(column) == c).alias(f"_c{c}") for c in classes],
    )
    whole = per.agg(F.sum("n").alias("n"), F.max("l").alias("l"), *[F.sum(f"_c{c}").alias(f"_c{c}") for c in classes])
    both = per.unionByName(whole.withColumn(subset, F.lit("all")))
    parts = [F.when(F.col(f"_c{c}") > 0, F.concat(F.lit(f"{c}: "), F.col(f"_c{c}"))) for c in classes]
    return both.select(subset, F.col("n").alias("N"), F.col("l").alias("L"), F.lit(channels).alias("E"),
                       F.concat_ws(", ", *parts).alias("class_counts"))
