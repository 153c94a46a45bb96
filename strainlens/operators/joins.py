"""Identifier joins: lookups, prefix matches, occurrence-ranked matches,
metadata annotation, coordinate lift-over, region extraction."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens.functions import ranking as rk
from strainlens.functions import text
from strainlens.functions.arrays import let
from strainlens.operators import prefixes

def lookup_index(ids: DataFrame, mapping: DataFrame, id_col: str, key: str, index: str) -> tuple[DataFrame, DataFrame]:
    """Ids with their index, and the ids that have none."""
    m = mapping.select(F.col(key).alias("_k"), F.col(index).alias("index"))
    joined = ids.join(m, ids[id_col] == m["_k"], "left").drop("_k")
    return joined.filter(F.col("index").isNotNull()), joined.filter(F.col("index").isNull()).drop("index")


def require_mapped(missing: DataFrame, id_col: str) -> None:
    first = [r[0] for r in missing.select(id_col).orderBy(id_col).limit(20).collect()]
    if first:
        raise ValueError(f"ids without an index: {first}")


def prefix_lookup(ids: DataFrame, mapping: DataFrame, id_col: str, key: str, index: str) -> DataFrame:
    """Index of possibly truncated ids: exact match first, then either id being
    a prefix of the other.

    Adds ``index``, ``how`` (exact, prefix, ambiguous, missing) and
    ``n_matches``, from one sorted merge of keys and ids; an id that begins a
    third of all keys takes their sums, not their rows.
    """
    found = prefixes.prefix_sums(mapping, ids, key, index, id_col)
    low, high = F.least("below_low", "above_low"), F.greatest("below_high", "above_high")
    n = F.col("below_n") + F.col("above_n")
    exact = F.col("copies") > 0
    table = found.select(
        F.col("id").alias("_id"), F.when(exact, F.col("own_low")).when(low == high, low).alias("index"),
        F.when(exact, "exact").when(n == 0, "missing").when(low == high, "prefix").otherwise("ambiguous").alias("how"),
        F.when(exact, F.col("copies")).otherwise(n).cast("bigint").alias("n_matches"))
    return ids.join(table, ids[id_col] == table["_id"], "left").drop("_id")


def require_unambiguous(resolved: DataFrame, id_col: str) -> DataFrame:
    """Resolved rows; an ambiguous prefix raises."""
    message = F.concat(F.lit("ambiguous prefix match for "), F.col(id_col))
    return resolved.withColumn("how", F.when(F.col("how") != "ambiguous", F.col("how")).otherwise(F.raise_error(message)))


def first_key_starting_with(ids: DataFrame, mapping: DataFrame, id_col: str, key: str, order: str) -> DataFrame:
    """One-way variant: an exact key, else the first key (in order) that starts
    with the id."""
    found = prefixes.prefix_sums(mapping, ids, key, order, id_col)
    best = found.select(F.col("id").alias("_id"), F.coalesce("own_key", "below_key").alias("matched_key"))
    return ids.join(best, ids[id_col] == best["_id"], "left").drop("_id")


def occurrence_join(features: DataFrame, target: DataFrame, keys: Sequence[str], feature_pos: str, target_pos: str) -> DataFrame:
    """Rows with the same keys are matched first-in first-out.

    The n-th occurrence on one side meets the n-th on the other; numbering runs
    in ranges of (key, place), so one key holding most rows is still spread.  ``status`` is
    matched, missing (target row without a feature row) or leftover.
    """
    def numbered(df, pos):
        return rk.with_row_number(df, keys, [F.col(pos)], "_rn")
    f = numbered(features, feature_pos).withColumn("_f", F.lit(1))
    t = numbered(target, target_pos).withColumn("_t", F.lit(1))
    out = t.join(f, [*keys, "_rn"], "full_outer")
    return out.withColumn("status", F.when(F.col("_f").isNull(), "missing").when(F.col("_t").isNull(), "leftover").otherwise("matched")).drop("_f", "_t", "_rn")


def annotate_rows(rows: DataFrame, metadata: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Metadata columns (Unknown when absent) and a found marker (0/1)."""
    m = metadata.select(F.col(key).alias("_k"), *[F.col(c).cast("string").alias(c) for c in columns], F.lit(1).alias("_found"))
    out = rows.join(m, rows[key] == m["_k"], "left").drop("_k")
    for c in columns:
        out = out.withColumn(c, F.coalesce(c, F.lit(C.UNKNOWN)))
    return out.withColumn("metadata_found", F.coalesce("_found", F.lit(0))).drop("_found")


def missing_ids(rows: DataFrame, metadata: DataFrame, key: str) -> DataFrame:
    """Distinct ids without metadata (written sorted by the sink)."""
    return rows.select(key).join(metadata.select(key), key, "left_anti").distinct()


def lift_regions(regions: DataFrame, mapping: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end") -> DataFrame:
    """Region ends looked up in a position map; reversed ends swap, regions
    with an unmapped end drop out."""
    def side(name):
        return mapping.select(*keys, F.col("ref_pos").alias(name), F.col("target_pos").alias(f"_{name}"))
    out = regions.join(side(start), [*keys, start]).join(side(end), [*keys, end])
    lo, hi = F.least(f"_{start}", f"_{end}"), F.greatest(f"_{start}", f"_{end}")
    rest = [c for c in regions.columns if c not in (*keys, start, end)]
    return out.select(*keys, *rest, lo.alias(start), hi.alias(end), (hi - lo + 1).alias("length_nt"))


def unordered_pairs(values: Sequence[str]) -> Column:
    """Literal array of (a, b) with a before b, for a short list of labels."""
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for i, a in enumerate(values) for b in values[i + 1:]])


def region_pieces(genomes: DataFrame, coordinates: DataFrame, keys: Sequence[str], sequence: str = "sequence") -> DataFrame:
    """Region sequence (1-based, closed) and its FASTA id per genome."""
    out = genomes.join(coordinates, list(keys))
    piece = F.upper(F.substring(sequence, F.col("start"), F.col("end") - F.col("start") + 1))
    name = F.concat_ws("|", "class", "record_id", "region", F.concat(F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")))
    return out.select(*keys, "class", "region", "start", "end", name.alias("fasta_id"), piece.alias("piece"))


def normalise_product(name: Column) -> Column:
    """Region of a product name: exact, else the first known name contained."""
    key = text.strip(F.regexp_replace(F.regexp_replace(F.lower(name), "-", " "), r"\s+", " "))
    known = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(r).alias("r")) for p, r in C.PRODUCT_REGIONS])

    def find(k):
        exact = F.filter(known, lambda x: x["p"] == k)
        part = F.filter(known, lambda x: k.contains(x["p"]))
        return F.coalesce(F.get(exact, F.lit(0))["r"], F.get(part, F.lit(0))["r"])
    return let(key, find)


def region_table(features: DataFrame, genomes: DataFrame, key: str) -> DataFrame:
    """Region coordinates per genome from its feature table.

    Input features: key, ``type``, ``product``, ``start`` (1-based), ``end``,
    ``feature_no``; genomes: key, ``genome_length``.  Peptide features only,
    first feature per region, untranslated ends added before the first and
    after the last feature.
    """
    f = features.filter(F.col("type").isin(C.PEPTIDE_TYPES)).withColumn("region", normalise_product(F.col("product")))
    first = f.filter(F.col("region").isNotNull()).groupBy(key, "region").agg(
        F.min(F.struct(F.col("feature_no").alias("n"), F.col("start").alias("s"), F.col("end").alias("e"), F.col("product").alias("p"))).alias("_f"))
    standard = F.create_map(*[F.lit(x) for kv in C.REGION_PRODUCTS.items() for x in kv])
    body = first.select(key, "region", F.coalesce(F.try_element_at(standard, F.col("region")), F.col("_f.p")).alias("product"),
                        F.col("_f.s").cast("bigint").alias("start"), F.col("_f.e").cast("bigint").alias("end"))
    # the last feature is the one that starts last
    ends = body.groupBy(key).agg(F.min("start").alias("_first"), F.max(F.struct("start", "end"))["end"].alias("_last")).join(genomes, key)
    five = ends.filter(F.col("_first") > 1).select(key, F.lit("5'UTR").alias("region"), F.lit("5'UTR").alias("product"), F.lit(1).cast("bigint").alias("start"), (F.col("_first") - 1).alias("end"))
    three = ends.filter(F.col("_last") < F.col("genome_length")).select(key, F.lit("3'UTR").alias("region"), F.lit("3'UTR").alias("product"), (F.col("_last") + 1).alias("start"), F.col("genome_length").cast("bigint").alias("end"))
    out = body.unionByName(five).unionByName(three)
    return out.withColumn("length_nt", F.col("end") - F.col("start") + 1).withColumn("region_order", text.region_order(F.col("region")))


def region_bounds(coordinates: DataFrame, key: str, genome_end: int = C.GENOME_END, strict: bool = True) -> DataFrame:
    """All 13 regions per map, in order, from a coordinate table.

    ``region`` may hold a region or a standard product name; the 5' start is
    forced to 0, missing untranslated ends are filled in, any other missing
    region raises when ``strict`` and is listed in ``missing`` otherwise.
    """
    by_product = F.create_map(*[F.lit(x) for r, p in C.REGION_PRODUCTS.items() for x in (p, r)])
    # fixed values: older names of two regions
    legacy = {"capsid protein C": "C", "premembrane protein prM": "prM"}
    by_legacy = F.create_map(*[F.lit(x) for kv in legacy.items() for x in kv])
    name = F.when(F.col("region").isin(C.REGIONS), F.col("region")).otherwise(F.coalesce(F.try_element_at(by_product, F.col("region")), F.try_element_at(by_legacy, F.col("region"))))
    known = coordinates.withColumn("_region", name).filter(F.col("_region").isNotNull())
    at = {r: F.max(F.when(F.col("_region") == r, F.struct(F.lit(0).cast("bigint").alias("start") if r == "5'UTR" else F.col("start").cast("bigint").alias("start"),
                                                          F.col("end").cast("bigint").alias("end")))).alias(f"_r{i}") for i, r in enumerate(C.REGIONS)}
    wide = known.groupBy(key).agg(*at.values())
    last = len(C.REGIONS) - 1
    five = F.struct(F.lit(C.FIVE_PRIME_DEFAULT[0]).cast("bigint").alias("start"), F.lit(C.FIVE_PRIME_DEFAULT[1]).cast("bigint").alias("end"))
    ns5_end = F.coalesce(F.col(f"_r{last - 1}.end"), F.lit(C.NS5_END_DEFAULT))
    three = F.struct((ns5_end + 1).cast("bigint").alias("start"), F.lit(genome_end).cast("bigint").alias("end"))
    wide = wide.withColumn("_r0", F.coalesce("_r0", five)).withColumn(f"_r{last}", F.coalesce(F.col(f"_r{last}"), three))
    gone = F.concat_ws(",", *[F.when(F.col(f"_r{i}").isNull(), F.lit(r)) for i, r in enumerate(C.REGIONS)])
    if strict:
        gone = F.when(gone == "", gone).otherwise(F.raise_error(F.concat(F.lit("missing regions: "), gone)))
    cells = F.array(*[F.struct(F.lit(r).alias("region"), F.lit(i).alias("region_order"), F.col(f"_r{i}").alias("b")) for i, r in enumerate(C.REGIONS)])
    return wide.select(key, gone.alias("missing"), F.inline(cells)).filter(F.col("b").isNotNull()).select(key, "region", "region_order", "b.start", "b.end", "missing")
