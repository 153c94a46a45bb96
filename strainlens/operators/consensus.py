"""Consensus of region tests over several split strategies.

Inputs hold one row per (strategy, region[, comparison]): small result tables.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainlens.functions import annotate


def used_p(df: DataFrame, strategy: str = "strategy") -> DataFrame:
    """The adjusted p of a strategy if it has any, else its raw p."""
    w = Window.partitionBy(strategy)
    return df.withColumn("p_use", F.when(F.count("p_fdr").over(w) > 0, F.col("p_fdr")).otherwise(F.col("p")))


def _of(strategy: str, ids: Sequence, col: str) -> list[Column]:
    return [F.first(F.when(F.col(strategy) == s, F.col(col)), ignorenulls=True) for s in ids]


def widen(df: DataFrame, keys: Sequence[str], ids: Sequence, columns: Sequence[str], strategy: str = "strategy") -> DataFrame:
    """One row per key with ``<column>_<strategy>``; replaces a chain of outer
    merges by one conditional aggregate."""
    return df.groupBy(*keys).agg(*[a.alias(f"{c}_{s}") for c in columns for s, a in zip(ids, _of(strategy, ids, c))])


def kruskal_consensus(kw: DataFrame, ids: Sequence, alpha: float = 0.05) -> DataFrame:
    """Region verdict: available, significant, worst p and star, weakest effect."""
    wide = widen(used_p(kw), ["region"], ids, ["p_use", "epsilon_squared_R"])
    p = [F.col(f"p_use_{s}") for s in ids]
    e = F.filter(F.array(*[F.col(f"epsilon_squared_R_{s}") for s in ids]), lambda x: x.isNotNull())
    available = F.lit(True)
    for x in p:
        available = available & x.isNotNull()
    worst = F.when(available, F.greatest(*p) if len(p) > 1 else p[0])
    out = wide.withColumn("kw_all_available", available).withColumn("kw_p_worst", worst)
    out = out.withColumn("kw_all_significant", F.coalesce(F.col("kw_p_worst") < alpha, F.lit(False)))
    out = (
        out.withColumn("kw_neg_log10_worst_p", annotate.neg_log10(F.col("kw_p_worst")))
        .withColumn("kw_consensus_star", F.when(F.col("kw_all_significant"), annotate.stars(F.col("kw_p_worst"))).otherwise(""))
        .withColumn("kw_epsilon_min", F.array_min(e)).withColumn("kw_epsilon_median", median_of(e))
    )
    out = out.withColumn("kw_epsilon_consensus_stars", annotate.effect_stars(F.col("kw_epsilon_min"), annotate.EPSILON_STEPS))
    for s, x in zip(ids, p):
        out = out.withColumn(f"kw_star_{s}", annotate.stars(x)).withColumn(f"kw_pass_{s}", F.coalesce(x < alpha, F.lit(False)))
    return out.withColumnsRenamed({f"p_use_{s}": f"kw_p_{s}" for s in ids} | {f"epsilon_squared_R_{s}": f"kw_epsilon_{s}" for s in ids})


def median_of(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2.0)


def pairwise_consensus(pairs: DataFrame, kw: DataFrame, ids: Sequence, alpha: float = 0.05, require_kw: bool = True,
                       require_sign: bool = True, effect: str = "rank_biserial") -> DataFrame:
    """Verdict per (region, comparison).

    The p rule needs every strategy significant in a region that passes the
    Kruskal consensus; the effect rule also needs one common sign.
    """
    wide = widen(used_p(pairs), ["region", "comparison"], ids, ["p_use", effect])
    p = [F.col(f"p_use_{s}") for s in ids]
    e = [F.col(f"{effect}_{s}") for s in ids]
    have = F.filter(F.array(*e), lambda x: x.isNotNull())
    available, plus, minus = F.lit(True), F.lit(True), F.lit(True)
    for x, y in zip(p, e):
        available = available & x.isNotNull()
        plus, minus = plus & F.coalesce(y > 0, F.lit(False)), minus & F.coalesce(y < 0, F.lit(False))
    out = wide.join(kw.select("region", "kw_all_significant"), "region", "left")
    out = out.withColumn("kw_all_significant", F.coalesce("kw_all_significant", F.lit(False)))
    out = out.withColumn("pair_all_available", available).withColumn("pair_p_worst", F.when(available, F.greatest(*p) if len(p) > 1 else p[0]))
    out = out.withColumn("pair_all_significant", F.coalesce(F.col("pair_p_worst") < alpha, F.lit(False)))
    out = out.withColumn("sign_concordant", plus | minus)
    gate = F.col("kw_all_significant") if require_kw else F.lit(True)
    sign = F.col("sign_concordant") if require_sign else F.lit(True)
    out = out.withColumn("pair_pvalue_consensus_pass", F.col("pair_all_significant") & gate)
    out = out.withColumn("pair_effect_consensus_pass", F.col("pair_pvalue_consensus_pass") & sign)
    weakest = F.array_min(F.transform(have, lambda x: F.abs(x)))
    out = (
        out.withColumn("pair_consensus_star", F.when(F.col("pair_pvalue_consensus_pass"), annotate.stars(F.col("pair_p_worst"))).otherwise(""))
        .withColumn("pair_neg_log10_worst_p", annotate.neg_log10(F.col("pair_p_worst")))
        .withColumn("pair_effect_min_abs", weakest).withColumn("pair_effect_median", median_of(have))
        .withColumn("pair_effect_worst_signed", F.when(plus, F.col("pair_effect_min_abs")).when(minus, -F.col("pair_effect_min_abs")))
    )
    ok, m = F.col("pair_effect_consensus_pass"), F.col("pair_effect_min_abs")
    out = (
        out.withColumn("pair_effect_consensus_stars", F.when(ok, annotate.effect_stars(m, annotate.RANK_BISERIAL_STEPS)).otherwise(""))
        .withColumn("pair_effect_magnitude", F.when(ok, annotate.magnitude(m, annotate.RANK_BISERIAL_STEPS, "")).otherwise(""))
    )
    for s, x in zip(ids, p):
        out = out.withColumn(f"pair_star_{s}", annotate.stars(x)).withColumn(f"pair_pass_{s}", F.coalesce(x < alpha, F.lit(False)))
    return out.withColumnsRenamed({f"p_use_{s}": f"pair_p_{s}" for s in ids} | {f"{effect}_{s}": f"pair_effect_{s}" for s in ids})


def star_checks(kw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Star of every consensus row beside the star its worst p calls for."""
    a = kw.select(F.lit("kruskal").alias("part"), "region", F.lit("").alias("comparison"), F.col("kw_consensus_star").alias("star"),
                  F.when(F.col("kw_all_significant"), annotate.stars(F.col("kw_p_worst"))).otherwise("").alias("expected"))
    b = pairs.select(F.lit("pairwise").alias("part"), "region", "comparison", F.col("pair_consensus_star").alias("star"),
                     F.when(F.col("pair_pvalue_consensus_pass"), annotate.stars(F.col("pair_p_worst"))).otherwise("").alias("expected"))
    return a.unionByName(b)


def star_mismatches(kw: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose star is wrong; must be empty."""
    return star_checks(kw, pairs).filter(F.col("star") != F.col("expected"))


def yes_no(c: Column) -> Column:
    return F.when(c.isNull(), "").when(c, "yes").otherwise("no")


def readable(df: DataFrame, names: dict[str, str], flags: Sequence[str] = ()) -> DataFrame:
    """Selected columns under readable names, flags as yes or no."""
    return df.select(*[(yes_no(F.col(c)) if c in flags else F.col(c)).alias(n) for c, n in names.items()])


def sample_counts(values: DataFrame, strategy: str, region: str, label: str) -> DataFrame:
    return values.groupBy(strategy, region, label).agg(F.count(F.lit(1)).alias("n_samples"))
