"""Score profiles over positions: per-sample scaling, masked aggregation,
region values, profile scaling, reductions that produce profiles."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainlens.functions import ranking as rk
from strainlens.functions.arrays import divide_all, let, total



def scale_sample(scores: Column, mode: str = "none", valid: Column | None = None) -> Column:
    """Per-sample scaling: ``none``, ``sum1`` or ``abs_sum1``.

    Masked positions become 0 before the total is taken; a zero total gives
    zeros.
    """
    x = scores
    if mode == "abs_sum1":
        x = F.transform(x, lambda v: F.abs(v))
    elif mode not in ("none", "sum1"):
        raise ValueError(f"unknown scaling {mode!r}")
    if valid is not None:
        x = F.zip_with(x, valid, lambda v, ok: F.when(ok, v).otherwise(0.0))
    if mode == "none":
        return x
    return let(x, lambda y: let(total(y), lambda t: F.when(t != 0, divide_all(y, t)).otherwise(F.transform(y, lambda v: F.lit(0.0)))))


def class_profile(df: DataFrame, keys: Sequence[str], scores: str = "scores", valid: str | None = "valid", mode: str = "none",
                  divide: bool = True) -> DataFrame:
    """Mean (or sum) per key and position over valid samples.

    ``keys`` may be empty for the overall profile.  A position without a valid
    sample is null in the mean.  The explode feeds a map-side partial
    aggregate, so positions x keys rows are shuffled, not positions x samples.
    """
    if valid is None:
        cut, mask = F.col(scores), F.transform(F.col(scores), lambda v: F.lit(True))
    else:
        n = F.least(F.size(scores), F.size(valid))
        cut, mask = F.slice(scores, F.lit(1), n), F.slice(valid, F.lit(1), n)
    work = df.select(*keys, scale_sample(cut, mode, mask).alias("_s"), mask.alias("_m"))
    long = work.select(*keys, F.posexplode(F.arrays_zip("_s", "_m")).alias("pos", "_z"))
    sums = F.sum(F.when(F.col("_z._m"), F.col("_z._s")).otherwise(0.0))
    count = F.count_if(F.col("_z._m"))
    value = F.when(count > 0, sums / count) if divide else sums
    return long.groupBy(*keys, "pos").agg(value.alias("value"), count.alias("n_valid"), F.count(F.lit(1)).alias("n_samples"))


def scale_profile(profile: DataFrame, keys: Sequence[str], value: str, mode: str, name: str | None = None) -> DataFrame:
    """0-1 scaling of profiles: ``no``, ``class`` (per profile) or ``global``.

    Null stays null; a constant profile becomes 0.  Windows run over the
    positions of one profile; the global range is a one-row aggregate.
    """
    name = name or value
    if mode == "no":
        return profile.withColumn(name, F.col(value))
    if mode == "class":
        w = Window.partitionBy(*keys)
        lo, hi = F.min(value).over(w), F.max(value).over(w)
        work = profile.withColumn("_lo", lo).withColumn("_hi", hi)
    elif mode == "global":
        ends = profile.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
        work = profile.withColumn("_lo", ends.select("lo").scalar()).withColumn("_hi", ends.select("hi").scalar())
    else:
        raise ValueError(f"unknown profile scaling {mode!r}")
    lo, hi, v = F.col("_lo"), F.col("_hi"), F.col(value)
    out = F.when(v.isNull(), None).when(hi > lo, (v - lo) / F.when(hi > lo, hi - lo)).otherwise(0.0)
    return work.withColumn(name, out).drop("_lo", "_hi")


def _reduce(part: Column, how: str) -> Column:
    if how == "sum":
        return total(part)
    if how == "mean":
        return total(part) / F.size(part)
    if how == "median":
        s = F.array_sort(part)
        n = F.size(part)
        return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2.0
    raise ValueError(f"unknown region reduction {how!r}")


def region_values(df: DataFrame, keep: Sequence[str], regions: Column, scores: str = "scores", how: str = "mean",
                  normalise: str | None = None) -> DataFrame:
    """One value per (sample, region).

    ``regions`` is a literal array of (region, region_order, start, end), half
    open, 0-based; bounds are clipped to the profile and empty regions skipped.
    Positions are never exploded: each region is a slice of the sample's array.
    ``normalise``: ``abs`` divides |scores| by their sum, ``sum`` scores by
    their sum (only when it is positive).
    """
    x = F.col(scores)
    if normalise == "abs":
        raw = x
        x = let(F.transform(x, lambda v: F.abs(v)), lambda a: let(total(a), lambda t: F.when(t > 0, divide_all(a, t)).otherwise(raw)))
    elif normalise == "sum":
        raw = x
        x = let(total(x), lambda t: F.when(t > 0, divide_all(raw, t)).otherwise(raw))
    elif normalise is not None:
        raise ValueError(f"unknown normalisation {normalise!r}")
    rows = df.select(*keep, x.alias("_x"), F.explode(regions).alias("_r"))
    start, end = F.greatest(F.lit(0), F.col("_r.start")), F.least(F.size("_x"), F.col("_r.end"))
    rows = rows.filter(end > start)
    part = F.slice("_x", start + 1, end - start)
    return rows.select(*keep, F.col("_r.region").alias("region"), F.col("_r.region_order").alias("region_order"), _reduce(part, how).alias("value"))


def last_finite(profile: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Length of each profile up to its last finite position, 0 when empty."""
    ok = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    return profile.groupBy(*keys).agg(F.coalesce(F.max(F.when(ok, F.col("pos") + 1)), F.lit(0)).cast("bigint").alias("length"))


def common_cut(lengths: DataFrame, genome_end: int, keys: Sequence[str] = ()) -> DataFrame:
    """Shortest non-empty profile, at most the genome end; one row, or one per ``keys``."""
    return lengths.filter(F.col("length") > 0).groupBy(*keys).agg(F.least(F.min("length"), F.lit(genome_end)).cast("bigint").alias("cut"))


def robust_limits(df: DataFrame, keys: Sequence[str], value: str, low: float = 0.01, high: float = 0.99, pad: float = 0.12,
                  nonnegative: bool = False) -> DataFrame:
    """Axis limits: 1st to 99th percentile with padding, with fallbacks."""
    q = rk.exact_percentiles(df, keys, value, {"_lo": low, "_hi": high, "_min": 0.0, "_max": 1.0})
    flat = F.col("_hi") <= F.col("_lo")
    lo, hi = F.when(flat, F.col("_min")).otherwise(F.col("_lo")), F.when(flat, F.col("_max")).otherwise(F.col("_hi"))
    q = q.withColumn("_a", lo).withColumn("_b", hi)
    eps = F.when(F.col("_b") != 0, F.abs("_b") * 0.05).otherwise(1e-12)
    same = F.col("_b") <= F.col("_a")
    q = q.withColumn("_a2", F.when(same, F.col("_a") - eps).otherwise(F.col("_a"))).withColumn("_b2", F.when(same, F.col("_b") + eps).otherwise(F.col("_b")))
    margin = (F.col("_b2") - F.col("_a2")) * pad
    y0 = F.col("_a2") - margin
    if nonnegative:
        y0 = F.when((F.col("_min") >= 0) & (y0 < 0), 0.0).otherwise(y0)
    return q.select(*keys, y0.alias("low"), (F.col("_b2") + margin).alias("high"))


def reduce_attention(weights: DataFrame, layer, chunk_size: int, mode: str = "cls", max_length: int | None = None) -> DataFrame:
    """Mean over heads, then the first query (``cls``) or the mean over queries.

    Long input (sample, layer, chunk, head, query, key, weight); chunks are
    laid end to end and cut to ``max_length``.
    """
    work = weights.filter(F.col("layer") == layer)
    if mode == "cls":
        work = work.filter(F.col("query") == 0)
    elif mode != "mean_query":
        raise ValueError(f"unknown attention reduction {mode!r}")
    pos = F.col("chunk") * chunk_size + F.col("key")
    if max_length is not None:
        work = work.filter(pos < max_length)
    return work.groupBy("sample", pos.alias("pos")).agg(F.avg("weight").alias("score"))


def genome_intervals(scores: DataFrame, tokens: DataFrame) -> DataFrame:
    """(chrom, start, end, score) per position through a token map."""
    return scores.join(tokens, "pos").select("sample", "pos", "chrom", "start", "end", "score")


def gradient_times_input(grad: Column, inputs: Column, mode: str = "signed") -> Column:
    """Per position: sum, sum of absolute or sum of positive parts over the
    channels of grad * input (arrays of arrays)."""
    pick = {"signed": lambda v: v, "abs": lambda v: F.abs(v), "positive": lambda v: F.greatest(v, F.lit(0.0))}[mode]
    return F.zip_with(grad, inputs, lambda g, x: total(F.transform(F.zip_with(g, x, lambda a, b: a * b), pick)))


def scale_to_unit(df: DataFrame, keys: Sequence[str], values: Sequence[str], pad: float = 0.06) -> DataFrame:
    """Each part scaled to 0-1 with a margin; a constant part becomes 0.5.

    The range per part is a small aggregate joined back.
    """
    ends = df.groupBy(*keys).agg(*[F.min(v).alias(f"_lo_{v}") for v in values], *[F.max(v).alias(f"_hi_{v}") for v in values])
    out = df.join(ends, list(keys))
    for v in values:
        lo, hi = F.col(f"_lo_{v}"), F.col(f"_hi_{v}")
        close = F.abs(lo - hi) <= 1e-8 + 1e-5 * F.abs(hi)
        out = out.withColumn(v, F.when(close, 0.5).otherwise(pad + (F.col(v) - lo) / F.when(~close, hi - lo) * (1 - 2 * pad)))
    return out.drop(*[f"_{e}_{v}" for v in values for e in ("lo", "hi")])
