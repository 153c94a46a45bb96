"""Array helpers."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` with ``value`` computed once.

    An outer expression used inside a lambda is evaluated again for every
    element; binding it as a lambda variable keeps the work linear.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def divide_all(a: Column, by: Column) -> Column:
    return F.transform(a, lambda v: v / by)
