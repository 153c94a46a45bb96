"""Which keys extend an identifier, and which begin it, by one sorted merge.

Keys and identifiers are sorted together in ranges.  In that order all strings
that begin with s follow s without a gap, so a scan with a stack of the open
prefixes sees every pair of a string and its prefix once, and passes on sums
instead of pairs: what lies above a string goes down the stack, what lies below
goes up when it closes.

A prefix that is open across a border of ranges is a prefix of a later range's
first string.  There are at most as many such strings as ranges times the
longest string; they are told to every range, which adds its part.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from strainlens.functions import ranking as rk


@dataclass
class Sums:
    """Smallest value with its key, greatest value and number of some keys."""

    low: tuple | None = None
    high: object = None
    n: int = 0

    def add(self, other: "Sums") -> "Sums":
        if not other.n:
            return self
        if not self.n:
            return other
        return Sums(min(self.low, other.low), max(self.high, other.high), self.n + other.n)


@dataclass
class Open:
    text: str
    wanted: bool
    key: Sums
    above: Sums
    copies: int = 0
    inherited: bool = False
    below: Sums = field(default_factory=Sums)


def _scan(rows: Iterator[tuple], spanning: list[tuple]) -> Iterator[tuple]:
    """(text, copies, own, below, above) of the wanted strings; rows: part, text, low, high, copies, wanted in order."""
    stack: list[Open] = []
    part = None

    def key_of(text, low, high, copies) -> Sums:
        return Sums((low, text), high, 1) if copies else Sums()

    def push(text, low, high, copies, wanted, inherited) -> None:
        above = Sums()
        if stack:
            # the empty string begins nothing
            above = stack[-1].above.add(stack[-1].key) if stack[-1].text else stack[-1].above
        stack.append(Open(text, wanted, key_of(text, low, high, copies), above, copies, inherited))

    def pop() -> Iterator[tuple]:
        e = stack.pop()
        if stack:
            stack[-1].below = stack[-1].below.add(e.below if e.inherited else e.below.add(e.key))
        if e.wanted:
            yield (e.text, 0, Sums(), e.below, Sums()) if e.inherited else (e.text, e.copies, e.key, e.below, e.above)

    for now, text, low, high, copies, wanted in rows:
        if now != part:
            while stack:
                yield from pop()
            part = now
            for home, s, *rest in spanning:
                if home < now and text.startswith(s):
                    push(s, *rest, True)
        while stack and not text.startswith(stack[-1].text):
            yield from pop()
        push(text, low, high, copies, wanted, False)
    while stack:
        yield from pop()


def prefix_sums(keys: DataFrame, ids: DataFrame, key: str, value: str, id_col: str, parts: int | None = None) -> DataFrame:
    """Per distinct id: ``id``, ``copies`` of it among the keys, and of three
    sets of distinct keys the smallest value (``_low``) with its key (``_key``),
    the greatest value (``_high``) and the number (``_n``): the id itself
    (``own``), keys that go on after it (``below``), keys that begin it (``above``).
    """
    kind = keys.schema[value].dataType
    named = keys.where(F.col(key).isNotNull()).select(F.col(key).alias("text"), F.col(value).alias("low"), F.lit(1).alias("copies"), F.lit(False).alias("wanted"))
    asked = ids.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("text"), F.lit(None).cast(kind).alias("low"), F.lit(0).alias("copies"), F.lit(True).alias("wanted"))
    both = named.unionByName(asked).groupBy("text").agg(F.min("low").alias("low"), F.max("low").alias("high"), F.sum("copies").alias("copies"), F.bool_or("wanted").alias("wanted"))
    both = rk.ordered_ranges(both, [F.col("text")], parts=parts).select("_part", "text", "low", "high", "copies", "wanted")
    # first strings of the ranges, and what is open there
    first = [r["text"] for r in both.groupBy("_part").agg(F.min("text").alias("text")).orderBy("_part").collect()][1:]
    begins = sorted({s[:i] for s in first for i in range(len(s) + 1)})
    spanning = []
    if begins:
        listed = both.sparkSession.createDataFrame([(s,) for s in begins], "text string")
        spanning = sorted((tuple(r) for r in both.join(listed, "text").select(*both.columns).collect()), key=lambda r: len(r[1]))
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("copies", T.LongType())] + [
        T.StructField(f"{s}_{c}", k) for s in ("own", "below", "above") for c, k in (("low", kind), ("key", T.StringType()), ("high", kind), ("n", T.LongType()))])
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            columns = zip(*held, strict=True) if held else [()] * len(arrow)
            batch = pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)
            held.clear()
            return batch

        for text, copies, *sums in _scan(rows(), spanning):
            held.append((text, copies, *[x for s in sums for x in ((s.low[0], s.low[1], s.high, s.n) if s.n else (None, None, None, 0))]))
            if len(held) >= 10_000:
                yield flush()
        yield flush()

    found = both.repartition("_part").sortWithinPartitions("_part", "text").mapInArrow(run, out)
    # an id that is open across ranges has a row from each
    aggs = [F.sum("copies").alias("copies")]
    for s in ("own", "below", "above"):
        best = F.min(F.when(F.col(f"{s}_n") > 0, F.struct(f"{s}_low", f"{s}_key"))).alias(s)
        aggs += [best, F.max(f"{s}_high").alias(f"{s}_high"), F.sum(f"{s}_n").alias(f"{s}_n")]
    merged = found.groupBy("id").agg(*aggs)
    return merged.select("id", "copies", *[c for s in ("own", "below", "above") for c in (F.col(f"{s}.{s}_low").alias(f"{s}_low"), F.col(f"{s}.{s}_key").alias(f"{s}_key"), f"{s}_high", f"{s}_n")])
