"""Multiple-testing corrections over small result tables (one row per test)."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _valid(p: str):
    return F.col(p).isNotNull() & ~F.isnan(F.col(p).cast("double"))


def holm(df: DataFrame, family: Sequence[str], p: str, out: str, tie: Sequence[str]) -> DataFrame:
    """Step-down adjustment: running maximum of (m - rank) * p, at most 1."""
    fam = Window.partitionBy(*family, _valid(p))
    order = fam.orderBy(F.col(p), *tie)
    m = F.count(F.lit(1)).over(fam)
    step = (m - F.row_number().over(order) + 1) * F.col(p)
    return (
        df.withColumn("_step", step)
        .withColumn(out, F.when(_valid(p), F.least(F.lit(1.0), F.max("_step").over(
            order.rowsBetween(Window.unboundedPreceding, 0)))))
        .drop("_step")
    )


def benjamini_hochberg(df: DataFrame, scope: Sequence[str], p: str, out: str, tie: Sequence[str]) -> DataFrame:
    """Step-up adjustment: running minimum of p * m / rank from the largest p."""
    fam = Window.partitionBy(*scope, _valid(p))
    up = fam.orderBy(F.col(p), *tie)
    down = fam.orderBy(F.col(p).desc(), *[F.col(t).desc() for t in tie])
    m = F.count(F.lit(1)).over(fam)
    return (
        df.withColumn("_step", F.col(p) * m / F.row_number().over(up))
        .withColumn(out, F.when(_valid(p), F.least(F.lit(1.0), F.min("_step").over(
            down.rowsBetween(Window.unboundedPreceding, 0)))))
        .drop("_step")
    )
