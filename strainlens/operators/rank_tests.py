"""Rank tests in one pass over distinct values.

For a fixed, small list of groups the data are reduced to one row per
(key, distinct value) holding a count per group.  Prefix sums over those rows
give every rank sum, U statistic and tie term, for all group pairs at once; no
pair of records is ever formed.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlens.functions import adjust, annotate, tails
from strainlens.functions import ranking as rk


def group_value_table(df: DataFrame, keys: Sequence[str], group: str, groups: Sequence[str], value: str) -> DataFrame:
    """Rows (keys, value) with n_i, n_i_before per group i."""
    v = F.col(value).cast("double")
    counts = (
        df.filter(v.isNotNull() & ~F.isnan(v) & F.col(group).isin(list(groups)))
        .groupBy(*keys, v.alias("value"))
        .agg(*[F.count_if(F.col(group) == g).alias(f"n_{i}") for i, g in enumerate(groups)])
    )
    weights = {f"n_{i}": F.col(f"n_{i}") for i in range(len(groups))}
    return rk.with_prefix_sums(counts, keys, [F.col("value")], weights)


def _total(k: int, suffix: str = ""):
    out = F.col(f"n_0{suffix}")
    for i in range(1, k):
        out = out + F.col(f"n_{i}{suffix}")
    return out


def _cube(t):
    t = t.cast("double")
    return t * t * t - t


def kruskal(table: DataFrame, keys: Sequence[str], groups: Sequence[str], min_n: int = 2) -> DataFrame:
    """H (tie corrected) over the groups with at least ``min_n`` values.

    Groups below ``min_n`` are rare and small, but their values must not take
    ranks: their counts are taken out of the rank of every value.
    """
    k = len(groups)
    used = [F.col(f"n_{i}_total") >= min_n for i in range(k)]
    t, before = F.lit(0), F.lit(0)
    for i in range(k):
        t = t + F.when(used[i], F.col(f"n_{i}")).otherwise(0)
        before = before + F.when(used[i], F.col(f"n_{i}_before")).otherwise(0)
    work = table.withColumn("_t", t).withColumn("_rank", before + (t + 1) / 2.0)
    sums = work.groupBy(*keys).agg(
        *[F.sum(F.col(f"n_{i}") * F.col("_rank")).alias(f"_r{i}") for i in range(k)],
        *[F.max(f"n_{i}_total").alias(f"_n{i}") for i in range(k)],
        F.sum(_cube(F.col("_t"))).alias("_ties"),
        F.min(F.when(F.col("_t") > 0, F.col("value"))).alias("_lo"), F.max(F.when(F.col("_t") > 0, F.col("value"))).alias("_hi"),
    )
    n_groups, n, acc = F.lit(0), F.lit(0), F.lit(0.0)
    for i in range(k):
        ok = F.col(f"_n{i}") >= min_n
        n_groups = n_groups + ok.cast("int")
        n = n + F.when(ok, F.col(f"_n{i}")).otherwise(0)
        acc = acc + F.when(ok, F.col(f"_r{i}") * F.col(f"_r{i}") / F.col(f"_n{i}")).otherwise(0.0)
    out = sums.withColumn("n_groups", n_groups).withColumn("N", n.cast("bigint")).withColumn("_acc", acc)
    big = F.col("N").cast("double")
    raw = 12.0 / (big * (big + 1)) * F.col("_acc") - 3.0 * (big + 1)
    ties = 1.0 - F.try_divide(F.col("_ties"), big * big * big - big)
    enough = (F.col("n_groups") >= 2) & (F.col("N") > F.col("n_groups"))
    return out.withColumn("H", F.when(enough, F.try_divide(raw, ties))).select(
        *keys, "n_groups", "N", "H", (F.col("_lo") == F.col("_hi")).alias("all_equal"))


def _unit(x):
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def region_kruskal(table: DataFrame, keys: Sequence[str], groups: Sequence[str], scope: Sequence[str] = (), min_n: int = 2) -> DataFrame:
    """H, p, eta and epsilon squared, magnitude, and BH p over the keys of a scope."""
    out = kruskal(table, keys, groups, min_n).drop("all_equal")
    h, n, k = F.col("H"), F.col("N"), F.col("n_groups")
    out = (
        out.withColumn("p", tails.nan_to_null(tails.chi2_tail_udf(h, k - 1)))
        .withColumn("eta_squared_H", F.when(h.isNotNull(), _unit(F.try_divide(h - k + 1.0, (n - k).cast("double")))))
        .withColumn("epsilon_squared_R", F.when(h.isNotNull(), _unit(F.try_divide(h, n - 1.0))))
    )
    out = out.withColumn("effect_size_magnitude", annotate.magnitude(F.col("epsilon_squared_R"), annotate.EPSILON_STEPS))
    return adjust.benjamini_hochberg(out, scope, "p", "p_fdr", [c for c in keys if c not in scope])


def mann_whitney_pairs(table: DataFrame, keys: Sequence[str], groups: Sequence[str], scope: Sequence[str] = (),
                       within: Sequence[str] = (), min_n: int = 2, method: str = "normal") -> DataFrame:
    """U, p, VDA, rank-biserial, magnitude and dominant group for every pair of
    groups; BH over the scope, or within ``scope + within``.

    ``method`` says how p is found, for groups of any size: "normal", or
    "exact" with ties, whose work and whose arrays of distinct values grow with
    the groups.
    """
    aggs, parts = [], []
    for a, b in combinations(range(len(groups)), 2):
        na, nb = F.col(f"n_{a}"), F.col(f"n_{b}")
        tag = f"{a}_{b}"
        both = na + nb
        aggs += [
            F.sum(na * (F.col(f"n_{b}_before") + nb / 2.0)).alias(f"_u{tag}"),
            F.sum(_cube(both)).alias(f"_t{tag}"),
            (F.array_sort(F.collect_list(F.when(both > 0, F.struct("value", both.alias("t"))))) if method == "exact" else F.array()).alias(f"_x{tag}"),
        ]
        parts.append(F.struct(
            F.lit(str(groups[a])).alias("class_a"), F.lit(str(groups[b])).alias("class_b"), F.lit(f"{groups[a]}v{groups[b]}").alias("comparison"),
            F.col(f"_n{a}").alias("n_a"), F.col(f"_n{b}").alias("n_b"), F.col(f"_u{tag}").alias("U"),
            F.col(f"_t{tag}").alias("_ties"), (F.transform(f"_x{tag}", lambda x: x["t"]) if method == "exact" else F.array().cast("array<bigint>")).alias("_tied"),
        ))
    sums = table.groupBy(*keys).agg(*aggs, *[F.max(f"n_{i}_total").alias(f"_n{i}") for i in range(len(groups))])
    rows = sums.select(*keys, F.inline(F.array(*parts)))
    ok = (F.col("n_a") >= min_n) & (F.col("n_b") >= min_n)
    rows = rows.withColumn("U", F.when(ok, F.col("U")))
    p = tails.mann_whitney_udf(method)(F.col("U"), F.col("n_a"), F.col("n_b"), F.col("_ties"), F.col("_tied"))
    vda = F.try_divide(F.col("U"), (F.col("n_a") * F.col("n_b")).cast("double"))
    rows = (
        rows.withColumn("p", tails.nan_to_null(p)).withColumn("VDA", vda)
        .withColumn("VDA_folded", F.greatest(F.col("VDA"), 1 - F.col("VDA")))
        .withColumn("rank_biserial", 2 * F.col("VDA") - 1)
    )
    rb = F.col("rank_biserial")
    rows = (
        rows.withColumn("cliffs_delta", rb)
        .withColumn("effect_size_magnitude", annotate.magnitude(rb, annotate.RANK_BISERIAL_STEPS))
        .withColumn("dominant_class", F.when(rb.isNull(), "NA").when(rb > 0, F.col("class_a")).when(rb < 0, F.col("class_b")).otherwise("tie"))
        .drop("_ties", "_tied")
    )
    return adjust.benjamini_hochberg(rows, [*scope, *within], "p", "p_fdr", [*[c for c in keys if c not in scope], "comparison"])


def fold_kruskal(df: DataFrame, keys: Sequence[str], group: str, groups: Sequence[str], value: str) -> DataFrame:
    """Kruskal over models with the all-equal guard and (H-k+1)/(n-k)."""
    out = kruskal(group_value_table(df, keys, group, groups, value), keys, groups, min_n=1)
    same = F.col("all_equal")
    h = F.when(F.col("n_groups") < 2, F.lit(None)).when(same, F.lit(0.0)).otherwise(F.col("H"))
    out = out.withColumn("H", h.cast("double"))
    p = F.when(same, F.lit(1.0)).otherwise(tails.nan_to_null(tails.chi2_tail_udf(F.col("H"), F.col("n_groups") - 1)))
    k, n = F.col("n_groups"), F.col("N")
    eps = F.when((k >= 2) & (n > k), _unit(F.try_divide(F.col("H") - k + 1.0, (n - k).cast("double"))))
    method = F.when(k < 2, "not_enough_models").when(same, "all_values_identical").otherwise("kruskal_wallis")
    return out.withColumn("p", p).withColumn("epsilon_squared", eps).withColumn("method", method).drop("all_equal")


def signed_rank_pairs(df: DataFrame, keys: Sequence[str], group: str, pairs: Sequence[tuple[str, str]], unit: str, value: str, method: str = "normal") -> DataFrame:
    """Wilcoxon signed-rank and matched rank-biserial per planned pair.

    ``method`` says how p is found, for any number of pairs: "normal", or
    "exact" with ties, which holds the distinct magnitudes of a pair.

    Values are pivoted to one row per (keys, unit); differences closer to zero
    than 1e-8 count as zero, and nearly equal magnitudes share a rank.
    """
    names = sorted({m for p in pairs for m in p})
    wide = df.groupBy(*keys, unit).agg(*[F.max(F.when(F.col(group) == m, F.col(value))).alias(f"_m{i}") for i, m in enumerate(names)])
    at = {m: F.col(f"_m{i}") for i, m in enumerate(names)}
    rows = wide.select(*keys, unit, F.inline(F.array(*[
        F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"), (at[a] - at[b]).alias("_d")) for a, b in pairs])))
    rows = rows.filter(F.col("_d").isNotNull() & ~F.isnan("_d"))
    by = [*keys, "model_a", "model_b"]
    rows = rows.withColumn("_abs", F.round(F.abs("_d"), 8))
    counts = rows.groupBy(*by, "_abs").agg(F.count(F.lit(1)).alias("_t"), F.count_if(F.col("_d") > 0).alias("_pos"))
    nonzero = counts.filter(F.col("_abs") > 0)
    ranked = rk.with_prefix_sums(nonzero, by, [F.col("_abs")], {"t": F.col("_t")})
    r = F.col("t_before") + (F.col("_t") + 1) / 2.0
    stats = ranked.groupBy(*by).agg(
        F.sum(F.col("_pos") * r).alias("w_plus"), F.sum((F.col("_t") - F.col("_pos")) * r).alias("w_minus"),
        F.max("t_total").alias("n_nonzero"), F.sum(_cube(F.col("_t"))).alias("_ties"),
        (F.transform(F.array_sort(F.collect_list(F.struct("_abs", "_t"))), lambda x: x["_t"]) if method == "exact" else F.lit(None).cast("array<bigint>")).alias("_tied"))
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n_pairs"))
    out = sizes.join(stats, by, "left")
    m = F.coalesce(F.col("n_nonzero"), F.lit(0))
    few = (F.col("n_pairs") < 2) | ((m > 0) & (m < 2))
    p = tails.signed_rank_udf(method)(F.coalesce("w_plus", F.lit(0.0)), F.coalesce("w_minus", F.lit(0.0)), m,
                              F.coalesce("_ties", F.lit(0.0)), F.col("_tied"))
    total = F.col("w_plus") + F.col("w_minus")
    return out.select(
        *by, "n_pairs", m.alias("n_nonzero"),
        F.when(few, F.lit(None)).when(m == 0, F.lit(0.0)).otherwise(F.least("w_plus", "w_minus")).alias("W"),
        F.when(few, F.lit(None)).when(m == 0, F.lit(1.0)).otherwise(tails.nan_to_null(p)).alias("p"),
        F.when(m == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("w_plus") - F.col("w_minus"), total)).alias("rank_biserial"),
    )
