"""Whole profile runs: every scope, class and overall, in one graph."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlens.operators import profiles, windows


def profile_tables(df: DataFrame, mode: str, window: int) -> DataFrame:
    """Mean profiles per (scope, profile): scopes are each fold and the data
    set, profiles are each class and Overall; with 0-1 scaled and smoothed
    values.

    The per-fold class sums are aggregated once; data-set and overall rows are
    sums of those sums, not second passes over the samples.
    """
    base = profiles.class_profile(df, ["fold", "class"], mode=mode, divide=False)
    both = base.select(
        F.explode(F.array(F.lit("dataset"), F.concat(F.lit("fold "), "fold"))).alias("scope"), "class", "pos", "value", "n_valid")
    both = both.select("scope", F.explode(F.array(F.concat(F.lit("DENV-"), F.col("class") + 1), F.lit("Overall"))).alias("profile"), "pos", "value", "n_valid")
    n = F.sum("n_valid")
    mean = both.groupBy("scope", "profile", "pos").agg(F.when(n > 0, F.sum("value") / n).alias("value"))
    out = profiles.scale_profile(mean, ["scope", "profile"], "value", "class", "scaled")
    out = out.withColumn("smoothed", windows.smooth(out, ["scope", "profile"], "pos", "value", window))
    return out.select("scope", "profile", F.col("pos").cast("bigint").alias("pos"), "value", "scaled", "smoothed")


def overall_panel(attention: DataFrame, gradient: DataFrame, window: int, genome_end: int, keys: Sequence[str] = ()) -> DataFrame:
    """Attention and gradient profiles, smoothed, re-scaled, cut to the common
    length of both; one panel, or one per ``keys`` (class, strategy)."""
    keys = list(keys)
    a = profiles.class_profile(attention, keys).select(*keys, F.lit("attention").alias("signal"), "pos", "value")
    g = profiles.class_profile(gradient, keys, mode="abs_sum1").select(*keys, F.lit("gradient").alias("signal"), "pos", "value")
    both = a.unionByName(g)
    lengths = both.groupBy(*keys, "signal").agg((F.max("pos") + 1).cast("bigint").alias("length"))
    cut = profiles.common_cut(lengths, genome_end, keys)
    both = both.withColumn("value", windows.smooth(both, [*keys, "signal"], "pos", "value", window, strict_odd=True))
    both = profiles.scale_profile(both, [*keys, "signal"], "value", "class")
    both = both.join(cut, keys) if keys else both.withColumn("cut", cut.scalar())
    return both.filter(F.col("pos") < F.col("cut")).select(*keys, "signal", F.col("pos").cast("bigint").alias("pos"), "value")
