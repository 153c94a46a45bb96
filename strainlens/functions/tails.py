"""Tail probabilities for result rows (one row per test, never per record).

Plain closed forms and integer counting; each is exposed as a pandas UDF so
that Spark evaluates it on Arrow batches of result rows.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def chi2_tail(x: float, df: int) -> float:
    """P(X >= x) for a chi-square variable with integer degrees of freedom."""
    if x is None or math.isnan(x) or df < 1:
        return float("nan")
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2:
        total, term, a = math.erfc(math.sqrt(half)), math.sqrt(half) * math.exp(-half) / math.gamma(1.5), 1.5
    else:
        total, term, a = 0.0, math.exp(-half), 1.0
    while a <= df / 2.0:
        total += term
        term *= half / a
        a += 1.0
    return min(1.0, total)


def normal_two_sided(z: float) -> float:
    return float("nan") if z is None or math.isnan(z) else math.erfc(abs(z) / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 200000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return h
    raise ArithmeticError("the incomplete beta fraction did not converge")


def binomial_half_two_sided(k: int, n: int) -> float:
    """Two-sided exact test of k successes in n fair trials."""
    if n == 0:
        return 1.0
    k = min(k, n - k)
    if 2 * k == n:
        return 1.0
    a, b = float(n - k), float(k + 1)
    front = math.exp(math.lgamma(n + 1) - math.lgamma(a) - math.lgamma(b) - (n + 1) * math.log(2.0))
    # P(X <= k) = I_{1/2}(n-k, k+1), through the side that converges.
    if 0.5 < (a + 1.0) / (a + b + 2.0):
        cdf = front * _beta_fraction(a, b, 0.5) / a
    else:
        cdf = 1.0 - front * _beta_fraction(b, a, 0.5) / b
    return min(1.0, 2.0 * cdf)


def mann_whitney_exact(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of U without ties.

    The counts of arrangements by U are the coefficients of the product over
    i of (1 - q^(n2+i)) / (1 - q^i); factors of the smaller group are applied
    one after the other, so the work is linear in the larger group.
    """
    n1, n2 = sorted((n1, n2))
    size = n1 * n2 + 1
    dist = np.zeros(size)
    dist[0] = 1.0
    for i in range(1, n1 + 1):
        dist[n2 + i:] -= dist[:size - n2 - i].copy() if n2 + i < size else 0.0
        for start in range(i):
            dist[start::i] = np.cumsum(dist[start::i])
    # the counts are symmetric: both tails are the lower one
    low = int(min(u, n1 * n2 - u))
    return min(1.0, 2.0 * float(dist[:low + 1].sum()) / math.comb(n1 + n2, n1))


def _doubled_ranks(ties: Sequence[int]) -> list[int]:
    """Twice the mean rank of each group of equal values, in order: whole numbers."""
    out, before = [], 0
    for t in ties:
        out.append(2 * before + t + 1)
        before += t
    return out


def mann_whitney_exact_tied(u: float, n1: int, ties: Sequence[int]) -> float:
    """Two-sided exact p of U given the sizes of all groups of equal values.

    Arrangements are counted by how many values of the first group lie in each
    group of equal ones, and the rank sum that gives; both tails are counted,
    as ties make them differ.
    """
    total = sum(ties)
    counts = [{} for _ in range(n1 + 1)]
    counts[0][0] = 1
    for t, r in zip(ties, _doubled_ranks(ties), strict=True):
        for k in range(n1, -1, -1):
            for j in range(1, min(t, k) + 1):
                ways = math.comb(t, j)
                for s, c in counts[k - j].items():
                    counts[k][s + j * r] = counts[k].get(s + j * r, 0) + c * ways
    at = round(2 * u) + n1 * (n1 + 1)
    low = sum(c for s, c in counts[n1].items() if s <= at)
    high = sum(c for s, c in counts[n1].items() if s >= at)
    return min(1.0, 2.0 * min(low, high) / math.comb(total, n1))


def mann_whitney_normal(u: float, n1: int, n2: int, tie_sum: float) -> float:
    """Two-sided p of U by the normal form with tie and continuity correction."""
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - tie_sum / (n * (n - 1.0)))
    if var <= 0:
        return 1.0
    z = (max(u, n1 * n2 - u) - n1 * n2 / 2.0 - 0.5) / math.sqrt(var)
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


def signed_rank_exact(w_plus: float, w_minus: float, ties: Sequence[int]) -> float:
    """Two-sided exact Wilcoxon p given the sizes of all groups of equal
    magnitudes, by counting sums of (doubled) ranks over all signs."""
    n = sum(ties)
    if n == 0:
        return float("nan")
    dist = {0: 1}
    for t, r in zip(ties, _doubled_ranks(ties), strict=True):
        grown: dict[int, int] = {}
        for s, c in dist.items():
            for j in range(t + 1):
                grown[s + j * r] = grown.get(s + j * r, 0) + c * math.comb(t, j)
        dist = grown
    low = round(2 * min(w_plus, w_minus))
    return min(1.0, 2.0 * sum(c for s, c in dist.items() if s <= low) / 2 ** n)


def signed_rank_normal(w_plus: float, w_minus: float, n: int, tie_sum: float) -> float:
    """Two-sided Wilcoxon p by the normal form with tie correction."""
    if n == 0:
        return float("nan")
    mean = n * (n + 1) / 4.0
    var = n * (n + 1) * (2 * n + 1) / 24.0 - tie_sum / 48.0
    return 1.0 if var <= 0 else min(1.0, math.erfc(abs(min(w_plus, w_minus) - mean) / math.sqrt(2.0 * var)))


@F.pandas_udf(DoubleType())
def chi2_tail_udf(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(float("nan") if pd.isna(a) else float(a), 0 if pd.isna(b) else int(b)) for a, b in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def binomial_half_udf(k: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([binomial_half_two_sided(int(a), int(b)) for a, b in zip(k, n)], dtype="float64")


METHODS = ("exact", "normal")


def mann_whitney_udf(method: str):
    """p from U, both sizes, the tie sum and, for the exact form, the sizes of
    all groups of equal values (one array)."""
    def p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_sum: pd.Series, ties: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d, e in zip(u, n1, n2, tie_sum, ties):
            if pd.isna(a):
                out.append(float("nan"))
            elif method == "normal":
                out.append(mann_whitney_normal(float(a), int(b), int(c), float(d)))
            elif max(e, default=1) == 1:
                out.append(mann_whitney_exact(float(a), int(b), int(c)))
            else:
                out.append(mann_whitney_exact_tied(float(a), int(b), [int(x) for x in e]))
        return pd.Series(out, dtype="float64")

    return _chosen(p, method)


def signed_rank_udf(method: str):
    """p from both rank sums, the number of pairs, the tie sum and, for the
    exact form, the sizes of all groups of equal magnitudes (one array)."""
    def p(wp: pd.Series, wm: pd.Series, n: pd.Series, tie_sum: pd.Series, ties: pd.Series) -> pd.Series:
        rows = zip(wp, wm, n, tie_sum, ties)
        if method == "normal":
            return pd.Series([signed_rank_normal(float(a), float(b), int(c), float(d)) for a, b, c, d, _ in rows], dtype="float64")
        return pd.Series([signed_rank_exact(float(a), float(b), [] if e is None else [int(x) for x in e]) for a, b, _, _, e in rows], dtype="float64")

    return _chosen(p, method)


def _chosen(p, method: str):
    if method not in METHODS:
        raise ValueError(f"method is one of {METHODS}, not {method!r}")
    return F.pandas_udf(p, DoubleType())


def nan_to_null(col):
    """pandas NaN back to SQL null."""
    return F.when(F.isnan(col), F.lit(None)).otherwise(col)
