"""Portable seeded hashing: the same integer in Spark and in any SQL engine
that has md5, so that samples and quotas can be reproduced elsewhere."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_digest(seed, *keys) -> Column:
    """md5 text of ``seed:key1:key2...``; its order is the sampling order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k) if isinstance(k, str) else k for k in keys]).cast("binary"))


def digest_int(digest: Column, digits: int = 8) -> Column:
    """First hex digits of a digest as a long."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("long")


def digest_uniform(digest: Column, digits: int = 12) -> Column:
    """Digest as a double in [0, 1)."""
    return digest_int(digest, digits).cast("double") / F.lit(float(16 ** digits))
