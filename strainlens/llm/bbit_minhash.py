"""Near-duplicates by b-bit MinHash.

Texts become sets of word shingles.  Equal sets collapse to their smallest id.
Minima under 192 hash functions give 38 bands of 5 (candidates: equal bands)
and, from 2 low bits of every minimum, a packed signature; the share of equal
2-bit values, corrected for chance equality, estimates the similarity.
Candidates whose estimate is far below the threshold, or whose sets differ by
too much already in a sketch of parities (an exact bound), are left; the others
are confirmed on full sets.

At similarity 0.8 a pair misses all bands with probability 3e-7, and its
estimate is more than 4 standard deviations above the margin.

Groups are never listed as pairs.  A bucket is led by the member with most
company in all its buckets, and every member first meets only one lead, that
with which it shares most bands; confirmed links give components.  Then only
members of one bucket that lie in different components meet, so no link
between components is lost, and a large group around a common text costs one
link per member.  Buckets are counted by partial aggregation and joined back as
ordinary equi-joins, which Spark splits when a key is hot.

Defined results: null, empty and word-less texts have an empty set and no
links; fewer words than a shingle give one shingle of the whole sequence;
copies and repeated ids share a component; a null id is kept and never
linked; empty tables give none; other columns are not read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strainlens import session
from strainlens.llm import batches
from strainlens.llm.components import components

SHINGLE_WORDS = 5
SIMILARITY_PERCENT = 80
HASHES, ROWS, BANDS, BITS = 192, 5, 38, 2
# estimates below threshold minus this margin are left out; one standard deviation at 0.8 is 0.034
MARGIN = 0.15
_LONGS = HASHES * BITS // 64
# a second sketch holds the parity of the number of shingles in each of 1024 cells
PARITY_BITS = 1024
_PARITY = PARITY_BITS // 64
_SKETCHES = [f"s{i}" for i in range(_LONGS)] + [f"p{i}" for i in range(_PARITY)]

_FACTOR = batches.draws(HASHES, 5) | np.uint64(1)
_OFFSET = batches.draws(HASHES, 6)

SIGNATURE = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_shingles", "digest_a", "digest_b")]
    + [T.StructField("bands", T.ArrayType(T.LongType()))] + [T.StructField(c, T.LongType()) for c in _SKETCHES]
)


def shingle_sets(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts and the text of each, ordered by text."""
    w = batches.words(batches.pack(texts), lower=True)
    hashes, at = batches.windows(w, size)
    owner = w.text[at]
    n_words = np.diff(w.first)
    extra_h, extra_t = [], []
    for k in range(1, size):
        short = np.flatnonzero(n_words == k)
        if len(short):
            h, a = batches.windows(w, k)
            pick = np.isin(w.text[a], short)
            extra_h.append(h[pick])
            extra_t.append(w.text[a][pick])
    hashes, owner = np.concatenate([hashes, *extra_h]), np.concatenate([owner, *extra_t])
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], owner[new]


def _signatures(size: int):
    def work(part: pa.RecordBatch, texts: list[bytes]) -> dict:
        hashes, owner = shingle_sets(texts, size)
        n = np.bincount(owner, minlength=len(texts))
        out = {"doc_id": part.column("doc_id"), "n_shingles": n}
        filled = np.flatnonzero(n)
        first = np.searchsorted(owner, filled)
        minima = np.zeros((HASHES, len(texts)), np.uint32)
        digests = np.zeros((2, len(texts)), np.uint64)
        if len(filled):
            for j in range(HASHES):
                value = ((hashes * _FACTOR[j] + _OFFSET[j]) >> np.uint64(32)).astype(np.uint32)
                minima[j, filled] = np.minimum.reduceat(value, first)
            digests[0, filled] = np.add.reduceat(batches.mix(hashes + np.uint64(3)), first)
            digests[1, filled] = np.bitwise_xor.reduceat(batches.mix(hashes + np.uint64(9)), first)
        out["digest_a"], out["digest_b"] = map(batches.as_long, digests)
        factor = batches.draws(ROWS, 7) | np.uint64(1)
        keys = np.empty((BANDS, len(texts)), np.uint64)
        for b in range(BANDS):
            rows = minima[b * ROWS:(b + 1) * ROWS].astype(np.uint64) + np.uint64(1)
            keys[b] = batches.mix(batches.mix((rows * factor[:, None]).sum(axis=0, dtype=np.uint64)) + np.uint64(b))
        bands = batches.as_long(np.ascontiguousarray(keys.T))
        out["bands"] = [row if k else None for row, k in zip(bands, n, strict=True)]
        low = (minima & np.uint32(2 ** BITS - 1)).astype(np.uint64)
        per = 64 // BITS
        for i in range(_LONGS):
            packed = np.zeros(len(texts), np.uint64)
            for j in range(per):
                packed |= low[i * per + j] << np.uint64(BITS * j)
            out[f"s{i}"] = batches.as_long(packed)
        cell = batches.mix(hashes + np.uint64(17)) >> np.uint64(54)
        parity = np.zeros(len(texts) * _PARITY, np.uint64)
        np.bitwise_xor.at(parity, owner * _PARITY + (cell >> np.uint64(6)).astype(np.int64), np.uint64(1) << (cell & np.uint64(63)))
        parity = batches.as_long(parity.reshape(-1, _PARITY))
        return out | {f"p{i}": np.ascontiguousarray(parity[:, i]) for i in range(_PARITY)}

    return work


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE_WORDS) -> DataFrame:
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return batches.map_slices(rows, "text", SIGNATURE, _signatures(size))


def estimate(a: str, b: str) -> Column:
    """Similarity from the packed signatures of two aliases, corrected for equality by chance."""
    even = F.lit(0x5555555555555555)
    differ = sum((F.bit_count((x := F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))).bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(even)) for i in range(_LONGS)), F.lit(0))
    chance = 0.5 ** BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def _may_link(a: str, b: str, percent: int) -> Column:
    """Whether a pair can be a link, by sizes, by the estimate, and by parities.

    A cell whose parities differ holds a shingle of one side only, so such
    cells are never more than the sets' difference, which a link bounds.
    """
    small, large = F.least(f"{a}.n_shingles", f"{b}.n_shingles"), F.greatest(f"{a}.n_shingles", f"{b}.n_shingles")
    odd = sum((F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(_PARITY)), F.lit(0))
    return (small * 100 >= large * percent) & (odd * (100 + percent) <= (small + large) * (100 - percent)) & (estimate(a, b) >= percent / 100 - MARGIN)


def _confirm(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    rows = (
        pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")
    )

    def work(part: pa.RecordBatch, second: list[bytes]) -> dict | None:
        first = [x or b"" for x in part.column("text_a").cast(pa.binary()).to_pylist()]
        m = len(second)
        hashes, owner = shingle_sets(first + second, size)
        n = np.bincount(owner, minlength=2 * m)
        # within a pair every hash occurs once per side, so equal neighbours are shared shingles
        order = np.lexsort((hashes, owner % m))
        h, o = hashes[order], (owner % m)[order]
        both = np.bincount(o[1:][(h[1:] == h[:-1]) & (o[1:] == o[:-1])], minlength=m)
        ok = 100 * both >= percent * (n[:m] + n[m:] - both)
        mask = pa.array(ok)
        return {"a": part.column("a").filter(mask), "b": part.column("b").filter(mask)} if ok.any() else None

    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    return batches.map_slices(rows, "text_b", schema, work)


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", size: int = SHINGLE_WORDS, percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id (smallest id reachable), kept."""
    sig = session.cut_lineage(signatures(docs, text, doc_id, size), "signatures")
    known = sig.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["n_shingles", "digest_a", "digest_b"]
    copies = known.groupBy(*digest).agg(F.min("doc_id").alias("rep"))
    # rows are made distinct before the join, so that Spark can split the join of a large group of copies
    classes = session.cut_lineage(known.select("doc_id", *digest).distinct().join(copies, digest).select("doc_id", "rep"), "classes")
    reps = known.join(copies.select(*digest, F.col("rep").alias("doc_id")), [*digest, "doc_id"]).dropDuplicates([*digest, "doc_id"])
    reps = session.cut_lineage(reps, "representatives")

    rows = reps.select("doc_id", F.explode("bands").alias("bucket"))
    shared = rows.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
    members = session.cut_lineage(rows.join(shared, "bucket"), "members")
    # a bucket is led by the member that has most company in all its buckets, the centre of a group
    company = members.groupBy("doc_id").agg(F.sum("n").alias("company"))
    leads = members.join(company, "doc_id").groupBy("bucket").agg(F.min_by("doc_id", F.struct(-F.col("company"), "doc_id")).alias("lead"))
    slim = reps.select("doc_id", "n_shingles", *_SKETCHES)

    wanted = members.select("doc_id").distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).join(wanted, "doc_id", "left_semi")
    texts = session.cut_lineage(texts, "texts")

    # of the leads of its buckets a member meets the one with which it shares most bands
    common = members.join(leads, "bucket").where("doc_id <> lead").groupBy("doc_id", "lead").agg(F.count("*").alias("n"))
    stars = common.groupBy(F.col("doc_id").alias("b")).agg(F.min_by("lead", F.struct(-F.col("n"), "lead")).alias("a"))
    near = stars.join(slim.alias("x"), F.col("a") == F.col("x.doc_id")).join(slim.alias("y"), F.col("b") == F.col("y.doc_id")).where(_may_link("x", "y", percent)).select("a", "b").distinct()
    links = session.cut_lineage(_confirm(near, texts, size, percent), "links")

    # what the stars leave open: members of one bucket in different components
    roots = components(links)
    placed = members.select("bucket", "doc_id").join(roots.withColumnRenamed("v", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    placed = session.cut_lineage(placed, "placed")
    mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("bucket")
    open_ = session.cut_lineage(placed.join(mixed, "bucket").join(slim, "doc_id"), "open")
    cross = (
        open_.alias("x").join(open_.alias("y"), F.expr("x.bucket = y.bucket AND x.doc_id < y.doc_id AND x.root <> y.root") & _may_link("x", "y", percent))
        .select(F.col("x.doc_id").alias("a"), F.col("y.doc_id").alias("b")).distinct().join(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")
    )
    more = session.cut_lineage(_confirm(session.cut_lineage(cross, "cross"), texts, size, percent), "links")
    roots = components(links.unionByName(more).unionByName(classes.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))))

    out = sig.select("doc_id", "n_shingles").join(roots.withColumnRenamed("v", "doc_id"), "doc_id", "left")
    component = F.coalesce("root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (component.isNull() | (component == F.col("doc_id"))).alias("kept"))


def keep(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """One row of each group stays, with its own columns."""
    rows = near_duplicates(docs, text, doc_id, **options).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(rows, F.col(f"`{doc_id}`").cast("long") == F.col("kept_id"), "left_semi").unionByName(docs.where(F.col(f"`{doc_id}`").isNull()))
