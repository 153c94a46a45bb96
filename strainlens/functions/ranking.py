"""Ranks, prefix sums and exact percentiles that survive one hot group.

A plain window sends a whole group to one task.  Here rows are dealt to ranges
of (group, order) whose bounds Spark samples from the data, whatever their type
and however densely values lie; a table (group, range) gives the offset of every
range, and the window runs inside (group, range) only.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainlens.session import cut_lineage

def digest_bucket(digest: Column) -> Column:
    """Monotone bucket of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, 4), 16, 10).cast("int")


def ordered_ranges(df: DataFrame, order: Sequence[Column], name: str = "_part", parts: int | None = None) -> DataFrame:
    """``df`` written in ranges of ``order``, numbered in that order by ``name``.

    Ranges hold about as many rows each; rows of equal order stay together.
    The table is stored, so every reader sees the same ranges.
    """
    dealt = df.repartitionByRange(*([parts] if parts else []), *order)
    return cut_lineage(dealt.withColumn(name, F.spark_partition_id()), "ranges")


def with_prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[Column], weights: Mapping[str, Column], parts: int | None = None) -> DataFrame:
    """Add ``<name>_before`` (sum of the weight over rows ordered strictly
    before this one in its group) and ``<name>_total`` (sum over the group).

    Ties in ``order`` are broken arbitrarily and stay in one range, so pass a
    full order or collapse equal rows first.
    """
    keys = list(keys)
    work = df.select("*", *[w.alias(f"_w_{n}") for n, w in weights.items()])
    work = ordered_ranges(work, [*[F.col(k) for k in keys], *order], parts=parts)
    hist = work.groupBy(*keys, "_part").agg(*[F.sum(f"_w_{n}").alias(f"_s_{n}") for n in weights])
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = hist.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_part").alias("_k_part"),
        *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_off_{n}") for n in weights],
        *[F.sum(f"_s_{n}").over(whole).alias(f"{n}_total") for n in weights],
    )
    inner = Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    work = work.select("*", *[F.coalesce(F.sum(f"_w_{n}").over(inner), F.lit(0)).alias(f"_in_{n}") for n in weights])
    cond = work["_part"] == offsets["_k_part"]
    for k in keys:
        cond = cond & work[k].eqNullSafe(offsets[f"_k_{k}"])
    out = work.join(offsets, cond)
    for n in weights:
        out = out.withColumn(f"{n}_before", F.col(f"_in_{n}") + F.col(f"_off_{n}"))
    drop = ["_part", "_k_part", *[f"_k_{k}" for k in keys]]
    for n in weights:
        drop += [f"_w_{n}", f"_in_{n}", f"_off_{n}"]
    return out.drop(*drop)


def with_row_number(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rn", parts: int | None = None) -> DataFrame:
    """1-based row number per group without a whole-group window."""
    out = with_prefix_sums(df, keys, order, {"_n": F.lit(1).cast("long")}, parts)
    return out.withColumn(name, F.col("_n_before") + 1).drop("_n_before", "_n_total")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct finite values per group with their counts."""
    v = F.col(value).cast("double")
    return (
        df.filter(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, v.alias(value))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )


def ranked_values(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per group: distinct value, cnt, cnt_before, cnt_total, avg_rank.

    Ties share the mean of their ranks.  Equal values are collapsed by a
    map-side aggregate before anything is ordered.
    """
    counts = value_counts(df, keys, value)
    out = with_prefix_sums(counts, keys, [F.col(value)], {"cnt": F.col("cnt")})
    return out.withColumn("avg_rank", F.col("cnt_before") + (F.col("cnt") + 1) / 2.0)


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """Attach the average rank of ``value`` inside its group (null for missing)."""
    keys = list(keys)
    ranks = ranked_values(df, keys, value).select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], F.col(value).alias("_r_value"), F.col("avg_rank").alias(name)
    )
    cond = df[value].cast("double") == ranks["_r_value"]
    for k in keys:
        cond = cond & df[k].eqNullSafe(ranks[f"_r_{k}"])
    return df.join(ranks, cond, "left").drop("_r_value", *[f"_r_{k}" for k in keys])


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Mapping[str, float]) -> DataFrame:
    """Exact linearly interpolated percentiles per group, any group size."""
    keys = list(keys)
    ranked = ranked_values(df, keys, value)
    aggs = []
    for name, q in shares.items():
        h = (F.col("cnt_total") - 1) * F.lit(float(q))
        for part, at in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            hit = (F.col("cnt_before") <= at) & (at < F.col("cnt_before") + F.col("cnt"))
            aggs.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{part}"))
    out = ranked.groupBy(*keys).agg(F.max("cnt_total").alias("_n"), *aggs)
    cols = []
    for name, q in shares.items():
        h = (F.col("_n") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        cols.append((lo + (h - F.floor(h)) * (hi - lo)).alias(name))
    return out.select(*keys, *cols)
