"""Many yes-or-no columns as bits of a few longs, which aggregates hold without sorting."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_BITS = 62


def words(conditions: Sequence[Column]) -> list[Column]:
    """Longs with one bit per condition; a condition that is null counts as false."""
    out = []
    for start in range(0, len(conditions), _BITS):
        word = F.lit(0).cast("long")
        for j, c in enumerate(conditions[start:start + _BITS]):
            word = word.bitwiseOR(F.when(c, F.lit(1 << j).cast("long")).otherwise(F.lit(0).cast("long")))
        out.append(word)
    return out


def has(prefix: str, i: int) -> Column:
    """Whether bit ``i`` is set in the columns ``prefix0``, ``prefix1``, ..."""
    return F.col(f"{prefix}{i // _BITS}").bitwiseAND(F.lit(1 << i % _BITS).cast("long")) != 0
