"""Benchmark decontamination by greedy string tiling.

Words are compared in lower case without punctuation.  Windows of
``min_match`` words are seeds: a bitmap of fixed size, filled from the seeds
of all benchmark items, lets each task keep only the parts of its texts where
a match is possible; an exact join on seeds then gives candidate pairs of text
and item.  For a pair, the longest common runs that are not yet marked are
found by running Karp-Rabin hashes and marked in both, again and again until
none of ``min_match`` words is left.  An item whose marked share reaches
``coverage`` is contaminated, also when its passages come in another order.

Only texts with possible seeds leave the scan, one row per text in a written
table that the joins by number read.  The bitmap
has a fixed size (1 MB); the join's sides are left to Spark.  Defined results:
null, empty and wordless texts match nothing; items with fewer than
``min_match`` words cannot be matched; repeated rows and items are compared
each for itself; rows with a null id are not compared and stay; empty tables
give none; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainlens import session
from strainlens.llm import batches

MIN_MATCH = 5
COVERAGE = 0.5
_SLOT_BITS = 23

_BREAK = np.zeros(256, bool)
_BREAK[[b for b in range(128) if not chr(b).isalnum()]] = True
_FACTOR = np.uint64(0xD6E8FEB86659FD93)

HITS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("row_no", T.LongType()), T.StructField("seeds", T.ArrayType(T.LongType())), T.StructField("codes", T.ArrayType(T.LongType()))])
PAIR = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("item_id", T.LongType()), ("item_words", T.LongType()), ("covered_words", T.LongType()), ("n_tiles", T.LongType()), ("coverage", T.DoubleType()))])


def _words(texts: list[bytes]) -> batches.Words:
    return batches.words(batches.pack([x.decode().lower().encode() for x in texts]), separator=_BREAK)


def _scan(bitmap: np.ndarray | None, min_match: int):
    """Per text with possible seeds: its distinct seeds, and its words around them; 0 stands between parts."""

    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict | None:
        w = _words(texts)
        seeds, at = batches.windows(w, min_match)
        if bitmap is not None:
            slot = seeds >> np.uint64(64 - _SLOT_BITS)
            hit = (bitmap[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
            seeds, at = seeds[hit], at[hit]
        if not len(at):
            return None
        near = np.zeros(len(w.code) + 1, np.int64)
        np.add.at(near, at, 1)
        np.add.at(near, at + min_match, -1)
        inside = np.cumsum(near[:-1]) > 0
        out = {"doc_id": [], "row_no": [], "seeds": [], "codes": []}
        ids, rows = part.column("doc_id").to_pylist(), part.column("row_no").to_pylist()
        for t in np.unique(w.text[at]):
            lo, hi = w.first[t], w.first[t + 1]
            use = np.flatnonzero(inside[lo:hi])
            gap = np.flatnonzero(np.diff(use) > 1) + 1
            out["doc_id"].append(ids[t])
            out["row_no"].append(rows[t])
            out["seeds"].append(batches.as_long(np.unique(seeds[w.text[at] == t])))
            out["codes"].append(batches.as_long(np.insert(w.code[lo:hi][use], gap, np.uint64(0))))
        return out

    return work


def _run_hashes(codes: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Running hash and place of every window of n free words."""
    if len(codes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    taken = np.concatenate(([0], np.cumsum(~free)))
    at = np.flatnonzero(taken[n:] == taken[:-n])
    up = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(codes), _FACTOR))))
    sums = np.concatenate(([np.uint64(0)], np.cumsum(codes * up[:-1], dtype=np.uint64)))
    # windows are brought to one power, so equal words give equal hashes wherever they stand
    return (sums[at + n] - sums[at]) * up[len(codes) - at], at


def tiles(item: np.ndarray, text: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy tiles (place in the item, place in the text, length), longest first; 0 in ``text`` matches nothing."""
    free_i, free_t = np.ones(len(item), bool), text != 0
    found = []

    def common(n: int) -> tuple | None:
        hi, ai = _run_hashes(item, free_i, n)
        ht, at = _run_hashes(text, free_t, n)
        # both sides are brought to the power of their own length
        up = pow(int(_FACTOR), abs(len(item) - len(text)), 1 << 64)
        if len(item) < len(text):
            hi = hi * np.uint64(up)
        else:
            ht = ht * np.uint64(up)
        keep = np.isin(hi, ht)
        return (hi[keep], ai[keep], ht, at) if keep.any() else None

    most = min(len(item), len(text))
    while most >= min_match and common(min_match):
        low, high = min_match, most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if common(mid) else (low, mid - 1)
        most = low
        hi, ai, ht, at = common(most)
        order = np.argsort(ht, kind="stable")
        ht, at = ht[order], at[order]
        left, right = np.searchsorted(ht, hi, "left"), np.searchsorted(ht, hi, "right")
        next_ = {}
        for h, i, a, b in zip(hi.tolist(), ai.tolist(), left.tolist(), right.tolist(), strict=True):
            if not free_i[i:i + most].all():
                continue
            k = next_.get(h, a)
            while k < b and not free_t[at[k]:at[k] + most].all():
                k += 1
            if k < b:
                free_i[i:i + most] = False
                free_t[at[k]:at[k] + most] = False
                found.append((i, int(at[k]), most))
                k += 1
            next_[h] = k
    return found


def overlaps(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text", item_id: str = "item_id", min_match: int = MIN_MATCH) -> DataFrame:
    """Pairs of text and item that share a seed: words of the item, words covered by tiles, tiles, coverage."""
    rows = lambda df, key, col: df.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(f"`{col}`").alias("text"))
    found = batches.map_slices(rows(items, item_id, item_text), "text", HITS, _scan(None, min_match)).select(F.col("doc_id").alias("item_id"), F.col("row_no").alias("item_no"), F.col("seeds").alias("item_seeds"), F.col("codes").alias("item_codes"))
    known = session.cut_lineage(found, "benchmark-seeds")
    seeds = known.select("item_no", F.explode("item_seeds").alias("seed"))
    # one bit per slot: at most 2^17 rows of 64 slots, whatever the size of the benchmark
    slot = F.shiftrightunsigned("seed", 64 - _SLOT_BITS)
    cells = seeds.groupBy(F.shiftright(slot, 6).alias("cell")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(63).cast("int"))).alias("bits"))
    bitmap = np.zeros(1 << (_SLOT_BITS - 6), np.uint64)
    for r in cells.collect():
        bitmap[r.cell] = r.bits & ((1 << 64) - 1)
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def scan(part: pa.RecordBatch, texts: list[bytes]) -> dict | None:
        return _scan(shared.value, min_match)(part, texts)

    # numbers are joined first, so that the words of a text travel once per pair and not once per seed
    hits = session.cut_lineage(batches.map_slices(rows(docs, doc_id, text), "text", HITS, scan), "text-seeds")
    pairs = hits.select("row_no", F.explode("seeds").alias("seed")).join(seeds, "seed").select("row_no", "item_no").distinct()
    items_of = pairs.join(known.select("item_no", "item_id", "item_codes"), "item_no")
    wide = items_of.join(hits.select("row_no", "doc_id", "codes"), "row_no").select("doc_id", "codes", "item_id", "item_codes")

    def tile(parts):
        for part in parts:
            out = {f.name: [] for f in PAIR}
            for doc, codes, item, item_codes in zip(*(part.column(i) for i in range(4)), strict=True):
                p, t = (x.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for x in (item_codes, codes))
                found = tiles(p, t, min_match)
                covered = sum(x[2] for x in found)
                for name, value in zip(out, (doc.as_py(), item.as_py(), len(p), covered, len(found), covered / len(p)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_pydict(out)

    return wide.mapInArrow(tile, PAIR)


def contaminated(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE, **options) -> DataFrame:
    """The pairs whose coverage reaches the threshold."""
    return overlaps(docs, items, **options).where(F.col("coverage") >= coverage)


def keep(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", **options) -> DataFrame:
    """The rows without a contaminated item, with their own columns."""
    bad = contaminated(docs, items, doc_id=doc_id, **options).select(F.col("doc_id").alias("bad_id")).distinct()
    return docs.join(bad, F.col(f"`{doc_id}`").cast("long") == F.col("bad_id"), "left_anti")
