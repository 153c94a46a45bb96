"""Vectorised work on the texts of an Arrow batch.

A batch is cut into slices of a bounded number of text bytes; a slice is one
byte array in which a line feed ends every text.  Words, lines and their
64-bit hashes are found for all texts of the slice at once.  Separators are
ASCII, so byte and code point views agree on where words begin and end.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SLICE_BYTES = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(n: int, seed: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _BASE + np.uint64(seed))


_BYTE = draws(256, 11)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        for name, factor in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, factor)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, block: int = 4_000_000) -> np.ndarray:
    """Hash of the bytes [start, end) of each span; spans come in order of start.

    Long arrays are hashed in blocks of spans, so that the helper arrays stay
    small; a single span longer than a block is hashed in one piece.
    """
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        origin = int(start[i])
        j = max(i + 1, int(np.searchsorted(start, origin + block)))
        s, e = start[i:j] - origin, end[i:j] - origin
        size = int(e.max())
        up, down = _powers(max(size, 1) + 1)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE[data[origin:origin + size]] * up[:size], out=sums[1:])
        out[i:j] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        i = j
    return out


@dataclass
class Texts:
    """The texts of a slice. ``first`` and ``last`` bound each text in ``data``."""

    data: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def __len__(self) -> int:
        return len(self.first)

    def owner(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def per_text(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        sums = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return sums[self.last] - sums[self.first]


@dataclass
class Words:
    """Words of all texts in order; ``first`` has one entry more than texts."""

    code: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


def pack(texts: list[bytes]) -> Texts:
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    last = np.cumsum(size + 1) - 1
    return Texts(np.frombuffer(b"\n".join([*texts, b""]), np.uint8), last - size, last)


def words(t: Texts, lower: bool = False, separator: np.ndarray = SEPARATOR) -> Words:
    """Maximal runs of bytes that are no separators, by default space and 0x09-0x0D."""
    data = LOWER[t.data] if lower else t.data
    inside = np.concatenate(([False], ~separator[data], [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    text = t.owner(start)
    return Words(span_hashes(data, start, end), text, start, end, np.searchsorted(text, np.arange(len(t) + 1)))


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of every window of n words within one text."""
    if len(w.code) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(w.text[:len(w.text) - n + 1] == w.text[n - 1:])
    factor = draws(n, 1000 + n) | np.uint64(1)
    total = np.zeros(len(w.code) - n + 1, np.uint64)
    for j in range(n):
        total += w.code[j:len(w.code) - n + 1 + j] * factor[j]
    return mix(total[at]), at


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Parts of a batch with about ``limit`` bytes of text; null is empty."""
    texts = [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield batch.slice(i, j - i), texts[i:j]
        i = j


def map_slices(df: DataFrame, column: str, schema: T.StructType, work: Callable[[pa.RecordBatch, list[bytes]], dict | None], limit: int = SLICE_BYTES) -> DataFrame:
    """``mapInArrow`` over slices; ``work`` returns output columns by name."""
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch, column, limit):
                found = work(part, texts)
                if found is not None:
                    yield pa.RecordBatch.from_arrays([_column(found[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def _column(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array | pa.ChunkedArray) else pa.array(values, kind)


def add_struct(df: DataFrame, column: str, name: str, schema: T.StructType, work: Callable[[list[bytes]], dict], limit: int = SLICE_BYTES) -> DataFrame:
    """All columns of ``df`` and a struct ``name`` computed from a text column.

    Nothing is joined back, so repeated rows and null keys keep their own
    values.  A ``name`` that ``df`` already has is an error.
    """
    if name.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"column {name!r} exists already; choose another name")
    inner, names = to_arrow_schema(schema), list(df.columns)

    def both(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        found = work(texts)
        struct = pa.StructArray.from_arrays([_column(found[f.name], f.type) for f in inner], fields=list(inner))
        return {c: part.column(i) for i, c in enumerate(names)} | {name: struct}

    return map_slices(df, column, T.StructType([*df.schema.fields, T.StructField(name, schema)]), both, limit)


def as_long(x: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit values as the signed ones Spark has."""
    return x.view(np.int64)
