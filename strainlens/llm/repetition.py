"""Quality rules by repetition coverage.

For n-grams of several lengths, rolling hashes of word windows find the ones
that occur twice or more in a text; the characters of words inside them, and
the characters of repeated lines, are measured against all characters of
words.  A text is rejected when any share is above its limit.

One pass without a shuffle; memory is bounded by a slice of texts (a longer
single text is a slice of its own).  Defined results: null text counts as
empty; texts without words have zero counts and fail the base rule; repeated
rows are measured one by one; other columns pass through, and a clash with the
added struct's name is an error.  Two windows or lines count as equal when
their 64-bit hashes in the same text are.
"""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainlens.llm import batches

# fixed values: largest share (percent) of word characters inside duplicated n-grams, by n
NGRAM_LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
# fixed values: largest share (percent) of lines, and of their word characters, that repeat an earlier line
LINE_LIMIT = 30
LINE_CHAR_LIMIT = 20
MIN_WORDS = 10
BASE_WINDOW, BASE_LIMIT = 5, 20

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "dup_line_chars", "n_repeat_words")]
    + [T.StructField("ngram_chars", T.ArrayType(T.LongType()))]
    + [T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
)


def _repeated(hash_: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal hashes in one text: which entries have a twin, and which are not the first."""
    key = hash_ ^ batches.mix(text.astype(np.uint64) + np.uint64(77))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twin, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    later[order[1:][same]] = True
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    return twin, later


def measure_texts(texts: list[bytes], limits: dict[int, int] = NGRAM_LIMITS) -> dict:
    t = batches.pack(texts)
    w = batches.words(t)
    n = len(t)
    lead = (t.data & 0xC0) != 0x80
    in_word = ~batches.SEPARATOR[t.data]
    chars = np.concatenate(([0], np.cumsum(lead & in_word, dtype=np.int64)))
    word_chars = chars[w.end] - chars[w.start]
    n_words, total = np.diff(w.first), chars[t.last] - chars[t.first]

    def covered(size: int) -> np.ndarray:
        """Words inside windows of that size with a twin in the same text."""
        hashes, at = batches.windows(w, size)
        hit = at[_repeated(hashes, w.text[at])[0]]
        steps = np.zeros(len(w.code) + 1, np.int64)
        np.add.at(steps, hit, 1)
        np.add.at(steps, hit + size, -1)
        return np.cumsum(steps[:-1]) > 0

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
        return sums[w.first[1:]] - sums[w.first[:-1]]

    # lines with a word
    end = np.flatnonzero(t.data == 10)
    start = np.concatenate(([0], end[:-1] + 1)) if len(end) else end
    line_chars = chars[end] - chars[start]
    full = line_chars > 0
    start, end, line_chars = start[full], end[full], line_chars[full]
    line_text = t.owner(start)
    later = _repeated(batches.span_hashes(t.data, start, end), line_text)[1]
    n_lines = np.bincount(line_text, minlength=n)
    n_dup = np.bincount(line_text[later], minlength=n)
    dup_chars = np.bincount(line_text[later], weights=line_chars[later], minlength=n).astype(np.int64)

    shares = {size: per_text(word_chars * covered(size)) for size in limits}
    repeat_words = per_text(covered(BASE_WINDOW))
    failed = (n_words < MIN_WORDS) | (100 * repeat_words > BASE_LIMIT * n_words)
    bad = (100 * n_dup > LINE_LIMIT * n_lines) | (100 * dup_chars > LINE_CHAR_LIMIT * total)
    for size, limit in limits.items():
        bad |= 100 * shares[size] > limit * total
    return {
        "n_words": n_words, "word_chars": total, "n_symbols": t.per_text(_SYMBOL[t.data]), "n_lines": n_lines, "n_dup_lines": n_dup,
        "dup_line_chars": dup_chars, "n_repeat_words": repeat_words, "ngram_chars": list(np.stack(list(shares.values()), axis=1)) if n else [],
        "base_failed": failed, "kept": ~failed & ~bad,
    }


def measure(df: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """``df`` with a struct ``out`` of counts, ``base_failed`` and ``kept``."""
    return batches.add_struct(df, text, out, SCHEMA, measure_texts)


def keep(df: DataFrame, text: str = "text") -> DataFrame:
    """The rows that pass, with their own columns."""
    out = next(c for c in ("quality", *(f"quality_{i}" for i in range(len(df.columns) + 1))) if c not in {x.lower() for x in df.columns})
    return measure(df, text, out).where(F.col(out)["kept"]).select(*[F.col(f"`{c}`") for c in df.columns])
