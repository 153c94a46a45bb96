"""Sequence functions as Column expressions."""
from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainlens import constants as C


def clean_sequence(col: Column, mask_other: bool = True) -> Column:
    """Upper case, U as T, gaps removed; other symbols become N unless
    ``mask_other`` is off."""
    out = F.translate(F.upper(col), "U-", "T")
    return F.regexp_replace(out, "[^ACGTN]", "N") if mask_other else out


def symbol_count(col: Column, symbols: str) -> Column:
    """How many characters of ``col`` are in ``symbols``."""
    without = F.replace(col, F.lit(symbols), F.lit("")) if len(symbols) == 1 else F.translate(col, symbols, "")
    return F.length(col) - F.length(without)


def _share(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


FEATURES = ["sequence_length", "padding_fraction", "n_fraction", "iupac_fraction", "gap_fraction",
            "other_fraction", "non_acgt_fraction", "gc_fraction"]


def composition(df: DataFrame, sequence: str = "sequence", keep: list[str] | None = None) -> DataFrame:
    """Length, symbol counts and fractions of every sequence."""
    s = F.upper(F.col(sequence))
    base = df.select(
        *(keep if keep is not None else [c for c in df.columns if c != sequence]),
        F.length(s).alias("sequence_length"),
        *[symbol_count(s, b).alias(f"{b.lower()}_count") for b in C.BASES],
        symbol_count(s, "N").alias("n_count"),
        symbol_count(s, C.AMBIGUITY_CODES).alias("iupac_count"),
        symbol_count(s, C.GAP_SYMBOLS).alias("gap_count"),
    )
    length = F.col("sequence_length")
    acgt = sum((F.col(f"{b.lower()}_count") for b in C.BASES[1:]), F.col("a_count"))
    known = F.col("acgt_count") + F.col("n_count") + F.col("iupac_count") + F.col("gap_count")
    return (
        base.withColumn("acgt_count", acgt)
        .withColumn("other_count", F.greatest(F.lit(0), length - known))
        .withColumn("non_acgt_count", length - F.col("acgt_count"))
        .withColumn("n_fraction", _share(F.col("n_count"), length))
        .withColumn("iupac_fraction", _share(F.col("iupac_count"), length))
        .withColumn("gap_fraction", _share(F.col("gap_count"), length))
        .withColumn("other_fraction", _share(F.col("other_count"), length))
        .withColumn("non_acgt_fraction", _share(F.col("non_acgt_count"), length))
        .withColumn("gc_fraction", _share(F.col("g_count") + F.col("c_count"), F.col("acgt_count")))
    )


def with_padding(df: DataFrame) -> DataFrame:
    """Padding up to the longest sequence.

    The maximum is one number, found by an aggregate of its own over the
    length column and attached as a scalar subquery.
    """
    longest = df.select(F.max("sequence_length").alias("_max"))
    out = df.withColumn("_max", longest.scalar())
    gap = F.col("_max") - F.col("sequence_length")
    return (
        out.withColumn("padding_length", gap)
        .withColumn("padding_fraction", F.when(F.col("_max") > 0, gap / F.col("_max")))
        .drop("_max")
    )


def _encode(sequences: pa.Array) -> pa.Array:
    """One-hot rows of every sequence, one per code point."""
    if not len(sequences):
        return pa.array([], pa.list_(pa.list_(pa.int8())))
    text = sequences.fill_null("").cast(pa.large_string())
    _, ends, data = text.buffers()
    at = np.frombuffer(ends, np.int64)[text.offset:text.offset + len(text) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    first = (raw & 0xC0) != 0x80
    if not first.all():
        at = np.concatenate([[0], np.cumsum(first)])[at]
        raw = raw[first]
    # the four numbers of a row are looked up as one
    values = _ROW_OF.view(np.uint32).ravel()[raw].view(np.int8)
    return _as_lists(values.reshape(-1, len(C.BASES)), at, sequences.is_null())


def _as_lists(values: np.ndarray, at: np.ndarray, missing: pa.Array) -> pa.Array:
    """Rows ``at[i]`` to ``at[i + 1]`` as list ``i``."""
    if values.size >= 2**31:
        raise OverflowError(f"{len(values)} one-hot rows in one Arrow batch; run inside session.arrow_batches")
    offsets = _row_offsets(len(values))
    rows = pa.ListArray.from_arrays(offsets, pa.array(values.reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows, mask=missing)


def _row_offsets(n: int) -> pa.Array:
    """Where ``n`` rows begin and end in their values; one table serves all batches of about this size."""
    return _offset_table(1 << n.bit_length()).slice(0, n + 1) if n * 2 * len(C.BASES) <= PADDED_BYTES else _offset_table.__wrapped__(n)


@functools.cache
def _offset_table(n: int) -> pa.Array:
    return pa.array(np.arange(0, n * len(C.BASES) + 1, len(C.BASES), dtype=np.int32))


def _from_lists(encoded: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows of all lists, and where the lists begin and end."""
    values = encoded.flatten().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(C.BASES))
    sizes = pc.list_value_length(encoded).fill_null(0).to_numpy(zero_copy_only=False)
    return values, np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def one_hot(col: Column) -> Column:
    """Unpadded one-hot rows over A, C, G, T; every other symbol is all zero.

    Encoded by Arrow batches, in eight bytes a symbol: run it inside
    ``session.arrow_batches``, with ``ENCODED_RECORDS`` where nothing is
    padded.  A function below that takes the rows directly runs in the same
    worker, and the rows are not sent back to Spark.
    """
    return F.arrow_udf(_encode, "array<array<tinyint>>")(F.upper(col))


def pad_one_hot(encoded: Column, length: Column | int) -> Column:
    """One-hot rows with all-zero rows behind them, up to ``length`` rows.

    Padded arrays of a collection are as long as its longest sequence, so keep
    the unpadded ones where that is not asked for.  With a number for
    ``length`` the rows are padded where :func:`one_hot` makes them, a whole
    Arrow batch at once: run that inside ``session.arrow_batches`` with
    :func:`padded_records`.
    """
    if isinstance(length, int):
        def pad(rows: pa.Array) -> pa.Array:
            return _pad(rows, length)
        return F.arrow_udf(pad, "array<array<tinyint>>")(encoded)
    none = F.array(*[F.lit(0).cast("tinyint") for _ in C.BASES])
    return F.concat(encoded, F.array_repeat(none, F.greatest(length - F.size(encoded), F.lit(0)).cast("int")))


def _pad(encoded: pa.Array, length: int) -> pa.Array:
    values, at = _from_lists(encoded)
    missing = encoded.is_null()
    sizes = np.where(missing.to_numpy(zero_copy_only=False), 0, np.maximum(np.diff(at), length))
    ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    out = np.zeros((ends[-1], len(C.BASES)), np.int8)
    for a, b, start in zip(at[:-1].tolist(), at[1:].tolist(), ends.tolist()):
        out[start:start + b - a] = values[a:b]
    return _as_lists(out, ends, missing)


def padded_records(length: int) -> int:
    """Sequences of an Arrow batch whose padded rows take ``PADDED_BYTES``, one at least."""
    return max(1, PADDED_BYTES // (2 * len(C.BASES) * max(1, length)))


def encoded_length(encoded: Column) -> Column:
    """Number of one-hot rows."""
    def count(rows: pa.Array) -> pa.Array:
        return pc.list_value_length(rows).cast(pa.int64())
    return F.arrow_udf(count, "bigint")(encoded)


def channel_summary(encoded: Column) -> Column:
    """Number of one-hot rows; per channel its sum and its first row with a one, from 1, 0 without any."""
    return F.arrow_udf(_summarise, "rows bigint, totals array<bigint>, first array<bigint>")(encoded)


def _summarise(encoded: pa.Array) -> pa.Array:
    values, at = _from_lists(encoded)
    totals, first = [], []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
        for k in range(len(C.BASES)):
            channel = values[a:b, k]
            ones = channel == 1
            at_one = int(ones.argmax()) if b > a else 0
            totals.append(int(channel.sum(dtype=np.int64)))
            first.append(at_one + 1 if b > a and ones[at_one] else 0)
    ends = pa.array(np.arange(0, len(totals) + 1, len(C.BASES), dtype=np.int32))
    per_channel = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int64())) for x in (totals, first)]
    return pa.StructArray.from_arrays([pa.array(np.diff(at)), *per_channel], ["rows", "totals", "first"], mask=encoded.is_null())


def position_mask(encoded: Column) -> Column:
    """A position is real when any of its channels is non-zero."""
    return F.transform(encoded, lambda row: F.exists(row, lambda v: v != 0))


def cut_to_common(a: Column, b: Column) -> tuple[Column, Column]:
    """Both arrays cut to the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n)


def wrap_fasta(header: Column, sequence: Column, width: int = 80) -> Column:
    """One FASTA record as text, the sequence wrapped."""
    body = F.regexp_replace(F.regexp_replace(sequence, f"(.{{{width}}})", "$1\n"), r"\n$", "")
    return F.concat(F.lit(">"), header, F.when(F.length(sequence) > 0, F.concat(F.lit("\n"), body)).otherwise(""))


def detect_alphabet(df: DataFrame, sequence: str, requested: str = "auto") -> DataFrame:
    """Alphabet of a collection as one row: name and symbols.

    ``nt`` when every observed symbol is an IUPAC nucleotide, else ``aa``;
    ``observed`` lists the symbols that occur.  All records are read (distinct
    symbols are found inside each record before anything is shuffled).
    """
    gaps = list(C.GAP_SYMBOLS + " *")
    symbols = (
        df.select(F.explode(F.array_distinct(F.split(F.upper(F.col(sequence)), ""))).alias("symbol"))
        .filter((F.col("symbol") != "") & ~F.col("symbol").isin(gaps))
    )
    if requested == "nt":
        return df.sparkSession.createDataFrame([("nt", C.BASES)], "name string, symbols array<string>")
    if requested == "aa":
        return df.sparkSession.createDataFrame([("aa", AMINO_ACIDS)], "name string, symbols array<string>")
    seen = symbols.agg(F.sort_array(F.collect_set("symbol")).alias("seen"))
    if requested == "observed":
        return seen.select(F.lit("observed").alias("name"), F.col("seen").alias("symbols"))
    if requested != "auto":
        raise ValueError(f"unknown alphabet mode {requested!r}")
    nt = F.array(*[F.lit(c) for c in NUCLEOTIDE_CODES])
    is_nt = (F.size("seen") > 0) & (F.size(F.array_except("seen", nt)) == 0)
    return seen.select(
        F.when(is_nt, "nt").otherwise("aa").alias("name"),
        F.when(is_nt, F.array(*[F.lit(c) for c in C.BASES])).otherwise(
            F.array(*[F.lit(c) for c in AMINO_ACIDS])).alias("symbols"),
    )


# Alphabets.
AMINO_ACIDS = list("ACDEFGHIKLMNPQRSTVWY")
NUCLEOTIDE_CODES = list("ACGTUNRYSWKMBDHV")

# The one-hot row of every first byte of a character.
_ROW_OF = np.zeros((256, len(C.BASES)), np.int8)
_ROW_OF[[ord(b) for b in C.BASES], range(len(C.BASES))] = 1

# bytes of padded rows that a task holds at once
PADDED_BYTES = 64 << 20
# sequences that a task encodes at once
ENCODED_RECORDS = 200
