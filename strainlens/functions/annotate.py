"""Result annotation: stars, magnitudes, formatted text, display names."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Thresholds (small, medium, large).
EPSILON_STEPS = (0.01, 0.06, 0.14)
RANK_BISERIAL_STEPS = (0.11, 0.28, 0.43)
VDA_STEPS = (0.56, 0.64, 0.71)
# Significance limits.
STAR_STEPS = ((1e-3, "***"), (1e-2, "**"), (5e-2, "*"))


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def stars(p: Column, not_significant: str = "") -> Column:
    """Stars by strict limits; not significant is empty or ``ns``."""
    out = F.lit(not_significant)
    for limit, mark in reversed(STAR_STEPS):
        out = F.when(p < limit, mark).otherwise(out)
    return F.when(_finite(p), out).otherwise("")


def effect_stars(value: Column, steps: Sequence[float], signed: bool = False) -> Column:
    v = F.abs(value) if signed else value
    return F.when(_finite(value), F.when(v >= steps[2], "***").when(v >= steps[1], "**").when(v >= steps[0], "*").otherwise("")).otherwise("")


def magnitude(value: Column, steps: Sequence[float], missing: str = "NA", signed: bool = True) -> Column:
    """negligible, small, medium or large."""
    v = F.abs(value) if signed else value
    return F.when(_finite(value), F.when(v >= steps[2], "large").when(v >= steps[1], "medium")
                  .when(v >= steps[0], "small").otherwise("negligible")).otherwise(missing)


def folded_magnitude(vda: Column) -> Column:
    return magnitude(F.greatest(vda, 1 - vda), VDA_STEPS)


def neg_log10(p: Column, cap: float = 300.0) -> Column:
    return F.when(_finite(p), -F.log10(F.greatest(F.least(p, F.lit(1.0)), F.lit(10.0 ** -cap))))


def fixed(x: Column, digits: int) -> Column:
    """Fixed decimals, rounding the exact binary value."""
    pattern = "0." + "0" * digits if digits else "0"
    return F.call_function("format_number", x.cast("double"), F.lit(pattern))


def p_text(p: Column) -> Column:
    return F.when(~_finite(p), "").when(p < 0.001, "<0.001").otherwise(fixed(p, 3))


def center_sd_text(center: Column, sd: Column) -> Column:
    return F.concat(fixed(center, 4), F.lit(" ("), fixed(sd, 4), F.lit(")"))


def center_range_text(center: Column, low: Column, high: Column) -> Column:
    return F.concat(fixed(center, 4), F.lit(" ["), fixed(low, 4), F.lit("-"), fixed(high, 4), F.lit("]"))


def metric_text(value: Column, as_percent: bool = False) -> Column:
    shown = F.concat(fixed(value * 100, 2), F.lit(" %")) if as_percent else fixed(value, 4)
    return F.when(_finite(value), shown).otherwise("")


def mean_sd_text(mean: Column, sd: Column, as_percent: bool = False) -> Column:
    if as_percent:
        return F.concat(fixed(mean * 100, 2), F.lit(" % +/- "), fixed(sd * 100, 2), F.lit(" %"))
    return F.concat(fixed(mean, 4), F.lit(" +/- "), fixed(sd, 4))


def parameter_text(n: Column) -> Column:
    """Parameter counts as M or K."""
    x = n.cast("double")
    return (F.when(x >= 1e6, F.concat(fixed(x / 1e6, 2), F.lit("M"))).when(x >= 1e3, F.concat(fixed(x / 1e3, 1), F.lit("K")))
            .otherwise(fixed(x, 0)))


def display_name(col: Column, names: Mapping[str, str]) -> Column:
    """Display name from a literal map; other values are kept."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), col)


# Readings of a comparison.
A_HIGHER, B_HIGHER = "Model A higher under this protocol", "Model B higher under this protocol"
NO_OBSERVED, NOT_SUPPORTED = "No observed accuracy difference", "No statistically supported accuracy difference"


def verdict(delta: Column, low: Column, high: Column, p: Column) -> Column:
    """Reading of an adjusted p with the sign of the interval."""
    return (
        F.when((p < 0.05) & (low > 0), A_HIGHER)
        .when((p < 0.05) & (high < 0), B_HIGHER)
        .when((F.abs(delta) <= 1e-15) & (low <= 0) & (high >= 0), NO_OBSERVED)
        .otherwise(NOT_SUPPORTED)
    )
