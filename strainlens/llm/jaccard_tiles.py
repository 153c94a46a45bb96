"""Exact self-join of word n-gram sets by Jaccard similarity, in size-banded tiles.

Texts become sets of word shingles; equal sets collapse to their smallest id.
Sizes are cut into bands so wide that linked sets lie in one band or in
neighbours.  A link bounds the difference of two sets by D shingles (from the
largest size of the upper band), so if both sets are dealt to D + 1 parts by
hash, at least one part is equal.  The digest of a part, with its band, names a
tile; a set enters the tiles of its own band and, if it is large enough to link
upwards, those of the next band.  No link between different sets is lost.

A part may be empty, and the tile of empty parts would be large.  Both sides of
a pair that agrees in empty parts only have one, so such sets are dealt again
with another hash, and only a third empty part names a tile.  With more than 64
parts empty ones are left out: such a pair would have to differ in each of the
other parts and agree in none, at odds below 1e-12.

Every set has a bitmap of 1024 bits, the parity of its shingles by hashed cell.
A cell in which two bitmaps differ holds a shingle of one set only, so
(size + size - differing bits) / 2 bounds the overlap from above.  Pairs that
the bound allows are intersected as whole sorted arrays of shingle hashes.

Tiles are never listed as pairs.  A tile is led by the member with most company
in all its tiles; every member first meets the one lead with which it shares
most tiles, and confirmed links give components.  Then only members of one tile
in different components meet, and the join itself applies root, size and
bitmap.  A set that none of its tiles links costs a bitmap comparison per
member, so a tile of many unlinked sets is compared in its square.

Defined results: null, empty and word-less texts have an empty set and no
links; fewer words than a shingle give one shingle of the whole sequence;
copies and repeated ids share a component; a null id is kept and never linked;
empty tables give none; other columns are not read.  Shingles are told apart by
64-bit hashes.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainlens import session
from strainlens.llm import batches
from strainlens.llm.bbit_minhash import shingle_sets
from strainlens.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
# ratio of neighbouring band edges, as a fraction
BAND_RATIO = (3, 2)
LEVELS, MANY_PARTS = 3, 64
BITMAP_BITS = 1024
_LONGS = BITMAP_BITS // 64
_BITMAP = [f"bits_{i}" for i in range(_LONGS)]
_DIGEST = ["n_shingles", "digest_a", "digest_b"]
LARGEST = 1 << 40

SIGNATURE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", *_DIGEST)] + [T.StructField("tiles", T.ArrayType(T.LongType()))] + [T.StructField(c, T.LongType()) for c in _BITMAP])


def difference(total: int, percent: int) -> int:
    """Most shingles that are in one of two linked sets only, given the sum of their sizes."""
    return total * (100 - percent) // (100 + percent)


def band_edges(percent: int) -> list[int]:
    """First sizes of the bands; linked sets are at most one band apart."""
    up, down = BAND_RATIO if 100 * BAND_RATIO[1] <= percent * BAND_RATIO[0] else (100, percent)
    edges = [1]
    while edges[-1] < LARGEST:
        edges.append(max(edges[-1] + 1, -(-edges[-1] * up // down)))
    return edges


def _deal(hashes: np.ndarray, owner: np.ndarray, parts: np.ndarray, band: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text and tile of every filled part, and the number of filled parts of each text; hashes come by text, ascending."""
    pick = parts[owner] > 0
    h, o = hashes[pick], owner[pick]
    # the first deal cuts ranges of the hash, so parts are runs of the sorted array
    drawn = h if level == 0 else batches.mix(h + np.uint64(100 + level))
    part = ((drawn >> np.uint64(32)) * parts[o].astype(np.uint64)) >> np.uint64(32)
    if level:
        order = np.lexsort((part, o))
        h, o, part = h[order], o[order], part[order]
    if not len(h):
        return o, h, np.zeros(len(parts), np.int64)
    new = np.flatnonzero(np.concatenate(([True], (o[1:] != o[:-1]) | (part[1:] != part[:-1]))))
    content = np.add.reduceat(batches.mix(h + np.uint64(23)), new)
    text = o[new]
    place = (band[text].astype(np.uint64) << np.uint64(48)) + (np.uint64(level) << np.uint64(44)) + part[new]
    return text, batches.mix(content + batches.mix(place)), np.bincount(text, minlength=len(parts))


def tiles(hashes: np.ndarray, owner: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and tile of all tiles, ordered by text."""
    edges = np.array(band_edges(percent))
    own = np.searchsorted(edges, size, "right") - 1
    texts, keys = [], []
    for up in (0, 1):
        band = np.maximum(own + up, 0)
        parts = np.array([difference(2 * (e - 1), percent) + 1 for e in edges[1:].tolist()])[band]
        # a single part is the whole set, and equal sets are one already
        enters = (size > 0) & (parts > 1)
        if up:
            enters &= 100 * size >= percent * edges[band]
        parts = np.where(enters, parts, 0)
        for level in range(LEVELS):
            text, key, filled = _deal(hashes, owner, parts, band, level)
            texts.append(text)
            keys.append(key)
            hollow = (filled < parts) & (parts <= MANY_PARTS)
            if not hollow.any():
                break
            parts = np.where(hollow, parts, 0)
        else:
            # the last deal names its empty parts by their place alone
            at = np.flatnonzero(parts)
            whole = np.repeat(at, parts[at])
            place = np.concatenate([np.arange(n) for n in parts[at]]).astype(np.uint64)
            names = batches.mix((band[whole].astype(np.uint64) << np.uint64(48)) + (np.uint64(LEVELS) << np.uint64(44)) + place)
            texts.append(whole)
            keys.append(names)
    text, key = np.concatenate(texts), np.concatenate(keys)
    order = np.argsort(text, kind="stable")
    return text[order], key[order]


def _signatures(size: int, percent: int):
    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        hashes, owner = shingle_sets(texts, size)
        n = np.bincount(owner, minlength=len(texts))
        filled = np.flatnonzero(n)
        first = np.searchsorted(owner, filled)
        digests = np.zeros((2, len(texts)), np.uint64)
        if len(filled):
            digests[0, filled] = np.add.reduceat(batches.mix(hashes + np.uint64(3)), first)
            digests[1, filled] = np.bitwise_xor.reduceat(batches.mix(hashes + np.uint64(9)), first)
        text, key = tiles(hashes, owner, n, percent)
        cell = batches.mix(hashes + np.uint64(17)) >> np.uint64(54)
        bits = np.zeros(len(texts) * _LONGS, np.uint64)
        np.bitwise_xor.at(bits, owner * _LONGS + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
        bits = batches.as_long(bits.reshape(-1, _LONGS))
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(text, np.arange(len(texts) + 1)), pa.int32()), pa.array(batches.as_long(key)))
        return {"doc_id": part.column("doc_id"), "n_shingles": n, "digest_a": batches.as_long(digests[0]), "digest_b": batches.as_long(digests[1]), "tiles": listed} | {c: np.ascontiguousarray(bits[:, i]) for i, c in enumerate(_BITMAP)}

    return work


def may_link(a: str, b: str, percent: int) -> Column:
    """Whether sizes and bitmaps of two aliases leave room for a link."""
    n_a, n_b = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    differing = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in _BITMAP), F.lit(0))
    most = F.floor((n_a + n_b - differing) / 2)
    return (F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * percent) & (most * 100 >= (n_a + n_b - most) * percent)


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar enough."""
    rows = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b"))

    def work(part: pa.RecordBatch, second: list[bytes]) -> dict | None:
        first = [x or b"" for x in part.column("text_a").cast(pa.binary()).to_pylist()]
        # a lead's text comes with each of its members and is cut into shingles once
        place = {x: i for i, x in enumerate(dict.fromkeys([*first, *second]))}
        hashes, owner = shingle_sets(list(place), size)
        cut = np.searchsorted(owner, np.arange(len(place) + 1))
        arrays = [hashes[cut[i]:cut[i + 1]] for i in range(len(place))]

        def similar(x: np.ndarray, y: np.ndarray) -> bool:
            if not len(x) or not len(y):
                return False
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
            return 100 * both >= percent * (len(x) + len(y) - both)

        ok = pa.array([similar(arrays[place[x]], arrays[place[y]]) for x, y in zip(first, second, strict=True)], pa.bool_())
        return {c: part.column(c).filter(ok) for c in ("a", "b")}

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return batches.map_slices(rows, "text_b", schema, work)


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable by links).

    Intermediate tables are written while the query is built.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    sig = session.cut_lineage(batches.map_slices(rows, "text", SIGNATURE, _signatures(size, percent)), "signatures")
    known = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = session.cut_lineage(known.groupBy(*_DIGEST).agg(F.min("doc_id").alias("rep")), "classes")
    reps = known.join(classes.select(*_DIGEST, F.col("rep").alias("doc_id")), [*_DIGEST, "doc_id"]).dropDuplicates([*_DIGEST, "doc_id"])
    reps = session.cut_lineage(reps, "representatives")
    slim = reps.drop("tiles", "digest_a", "digest_b")

    entries = reps.select("doc_id", F.explode("tiles").alias("tile"))
    shared = entries.groupBy("tile").agg(F.count("*").alias("n")).where("n > 1")
    members = session.cut_lineage(entries.join(shared, "tile"), "members")
    texts = session.cut_lineage(rows.join(members.select("doc_id").distinct(), "doc_id", "left_semi"), "texts")

    # every member meets one lead
    company = members.groupBy("doc_id").agg(F.sum("n").alias("company"))
    leads = members.join(company, "doc_id").groupBy("tile").agg(F.min_by("doc_id", F.struct(-F.col("company"), "doc_id")).alias("lead"))
    common = members.join(leads, "tile").where("doc_id <> lead").groupBy("doc_id", "lead").agg(F.count("*").alias("n"))
    stars = common.groupBy(F.col("doc_id").alias("b")).agg(F.min_by("lead", F.struct(-F.col("n"), "lead")).alias("a"))
    near = stars.join(slim.alias("x"), F.col("a") == F.col("x.doc_id")).join(slim.alias("y"), F.col("b") == F.col("y.doc_id")).where(may_link("x", "y", percent)).select("a", "b").distinct()
    links = session.cut_lineage(confirmed(near, texts, size, percent), "links")

    # members of one tile that the leads have not brought together
    roots = components(links)
    placed = members.select("tile", "doc_id").join(roots.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    placed = session.cut_lineage(placed, "placed")
    mixed = placed.groupBy("tile").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("tile")
    open_ = session.cut_lineage(placed.join(mixed, "tile").join(slim, "doc_id"), "open")
    cross = open_.alias("x").join(open_.alias("y"), F.expr("x.tile = y.tile AND x.doc_id < y.doc_id AND x.root <> y.root") & may_link("x", "y", percent))
    cross = session.cut_lineage(cross.select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct(), "cross")
    more = session.cut_lineage(confirmed(cross, texts, size, percent), "links")

    # an id that occurs with several sets is one vertex
    per_id = known.select("doc_id", *_DIGEST).distinct().join(classes, _DIGEST).select("doc_id", "rep").distinct()
    several = per_id.groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("doc_id", "low")
    same = per_id.join(several, "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b")).where("a < b")
    roots = components(links.unionByName(more).unionByName(same))

    out = sig.select("doc_id", *_DIGEST).join(classes, _DIGEST, "left").join(roots.withColumnRenamed("v", "rep"), "rep", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))
