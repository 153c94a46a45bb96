"""Positional windows: smoothing, running counters, latest versions."""
from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def smooth(df: DataFrame, keys: Sequence[str], pos: str, value: str, window: int, strict_odd: bool = False) -> Column:
    """Centred moving average over the values present; edges shrink.

    Windows run inside one profile, whose length is that of a sequence.  An
    even width grows by one, or raises with ``strict_odd``.
    """
    if window % 2 == 0:
        if strict_odd:
            raise ValueError("the smoothing window must be odd")
        window += 1
    h = window // 2
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-h, h)
    return F.avg(F.when(~F.isnan(F.col(value)), F.col(value))).over(w)


def rolling_mean(keys: Sequence[str], pos: str, value: str, window: int) -> Column:
    """Centred rolling mean with at least a third of the window present."""
    if window <= 1:
        return F.col(value)
    after = (window - 1) // 2
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(-(window - 1 - after), after)
    need = max(1, min(window, ceil(window / 3)))
    return F.when(F.count(value).over(w) >= need, F.avg(value).over(w))


# Fixed value: names of saved models.
CHECKPOINT_NAME = r"model-(?:k\d+|ohe)_(\d+)_(\d+)\.pt"


def latest_checkpoint(df: DataFrame, keys: Sequence[str], name: str, pattern: str = CHECKPOINT_NAME) -> DataFrame:
    """Name with the highest (epoch, timestamp) per key."""
    epoch, ts = (F.regexp_extract(name, pattern, i).cast("bigint") for i in (1, 2))
    return df.filter(F.col(name).rlike(pattern)).groupBy(*keys).agg(F.max_by(F.col(name), F.struct(epoch, ts)).alias("latest"))


def ungapped_counter(keys: Sequence[str], pos: str, symbol: str, gaps: str = "-.") -> Column:
    """Running count of non-gap symbols along one row, null on gaps."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    gap = F.col(symbol).isin(list(gaps))
    return F.when(~gap, F.sum(F.when(gap, 0).otherwise(1)).over(w))
