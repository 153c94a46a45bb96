"""Variability of aligned sequences, column by column.

Everything derives from one count table (region, class, position): symbol
counts from a single explode with a map-side aggregate.  The GLOBAL row sums
the class counts; class pairs join the count table with itself (positions x
class pairs), never sequences with sequences.
"""
from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens.functions import hashing, text
from strainlens.functions import ranking as rk
from strainlens.functions.arrays import let

GLOBAL = "GLOBAL"


def _sum(cols: list[Column]) -> Column:
    out = cols[0]
    for c in cols[1:]:
        out = out + c
    return out


def column_counts(aligned: DataFrame, keys: Sequence[str] = ("region",), label: str = "class", sequence: str = "aligned",
                  alphabet: Sequence[str] = C.BASES, with_global: bool = True) -> DataFrame:
    """Counts per (keys, class, pos): ``s_<symbol>``, gaps, unknown, n_sequences.

    U counts as T.  Positions are 1-based.
    """
    long = aligned.select(*keys, label, F.posexplode(F.split(F.upper(sequence), "")).alias("_p", "_s")).filter(F.col("_s") != "")
    s = F.when(F.col("_s") == "U", "T").otherwise(F.col("_s")) if "T" in alphabet else F.col("_s")
    gaps = list(C.GAP_SYMBOLS)
    per = long.groupBy(*keys, label, (F.col("_p") + 1).alias("pos")).agg(
        F.count(F.lit(1)).alias("n_sequences"), *[F.count_if(s == a).alias(f"s_{a}") for a in alphabet],
        F.count_if(F.col("_s").isin(gaps)).alias("gap_count"))
    if with_global:
        sums = [F.sum(c).alias(c) for c in per.columns if c not in (*keys, label, "pos")]
        per = per.unionByName(per.groupBy(*keys, "pos").agg(*sums).withColumn(label, F.lit(GLOBAL)))
    valid = _sum([F.col(f"s_{a}") for a in alphabet])
    return per.withColumn("valid_count", valid).withColumn(
        "unknown_count", F.greatest(F.lit(0), F.col("n_sequences") - F.col("valid_count") - F.col("gap_count")))


def _plogp(p: Column) -> Column:
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def consensus_of(alphabet: Sequence[str]) -> Column:
    """Most frequent symbol; alphabet order breaks ties; blank when empty."""
    top = F.greatest(*[F.col(f"s_{a}") for a in alphabet]) if len(alphabet) > 1 else F.col(f"s_{alphabet[0]}")
    out = F.lit("")
    for a in reversed(list(alphabet)):
        out = F.when(F.col(f"s_{a}") == top, a).otherwise(out)
    return F.when(F.col("valid_count") > 0, out).otherwise("")


def column_metrics(counts: DataFrame, alphabet: Sequence[str] = C.BASES) -> DataFrame:
    """Fractions, entropy, conservation, similarity and consensus per column."""
    n, valid = F.col("n_sequences"), F.col("valid_count")
    out = counts
    for a in alphabet:
        out = out.withColumn(f"p_{a}", F.when(valid > 0, F.col(f"s_{a}") / F.when(valid > 0, valid)).otherwise(0.0))
    p = [F.col(f"p_{a}") for a in alphabet]
    top = log2(len(alphabet)) if len(alphabet) > 1 else 1.0
    out = (
        out.withColumn("valid_fraction", valid / n).withColumn("gap_fraction", F.col("gap_count") / n)
        .withColumn("unknown_fraction", F.col("unknown_count") / n)
        .withColumn("entropy_bits", F.abs(_sum([_plogp(x) for x in p])))
    )
    most = F.greatest(*[F.col(f"s_{a}") for a in alphabet]) if len(alphabet) > 1 else F.col(f"s_{alphabet[0]}")
    return (
        out.withColumn("entropy_norm", F.col("entropy_bits") / top).withColumn("conservation_norm", 1.0 - F.col("entropy_norm"))
        .withColumn("intra_similarity", _sum([x * x for x in p])).withColumn("consensus", consensus_of(alphabet))
        .withColumn("consensus_fraction", F.when(valid > 0, most / F.when(valid > 0, valid)).otherwise(0.0))
        .withColumn("effective_symbols", F.pow(F.lit(2.0), F.col("entropy_bits")))
    )


def pair_divergence(metrics: DataFrame, keys: Sequence[str] = ("region",), label: str = "class", alphabet: Sequence[str] = C.BASES) -> DataFrame:
    """Overlap, Jensen-Shannon divergence (bits), cosine, weighted overlap and
    gap difference per column and class pair.

    All classes of a column meet in one grouped row, from which the pairs are
    read; classes are a handful of labels.
    """
    cell = F.struct(F.col(label).alias("c"), *[F.col(f"p_{a}") for a in alphabet], "valid_fraction", "gap_fraction")
    row = metrics.filter(F.col(label) != GLOBAL).groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(cell)).alias("_c"))
    left = row.select(*keys, "pos", "_c", F.posexplode("_c").alias("_i", "_a"))
    # b after a in label order: a slice of the sorted classes of this column
    both = left.select(*keys, "pos", "_a", F.explode(F.slice("_c", F.col("_i") + 2, F.size("_c"))).alias("_b"))
    a = {x: F.col(f"_a.p_{x}") for x in alphabet}
    b = {x: F.col(f"_b.p_{x}") for x in alphabet}

    def kl(p, q):
        return F.when(p > 0, p * F.log2(F.when(p > 0, p) / (0.5 * (p + q)))).otherwise(0.0)
    jsd = 0.5 * _sum([kl(a[x], b[x]) for x in alphabet]) + 0.5 * _sum([kl(b[x], a[x]) for x in alphabet])
    norm = F.sqrt(_sum([a[x] * a[x] for x in alphabet])) * F.sqrt(_sum([b[x] * b[x] for x in alphabet]))
    out = both.select(
        *keys, "pos", F.concat("_a.c", F.lit("v"), "_b.c").alias("pair"), F.col("_a.c").alias("class_a"), F.col("_b.c").alias("class_b"),
        _sum([F.least(a[x], b[x]) for x in alphabet]).alias("distribution_overlap"), jsd.alias("jsd"),
        F.when(norm > 0, _sum([a[x] * b[x] for x in alphabet]) / F.when(norm > 0, norm)).alias("cosine_similarity"),
        F.least("_a.valid_fraction", "_b.valid_fraction").alias("min_valid_fraction"),
        F.abs(F.col("_a.gap_fraction") - F.col("_b.gap_fraction")).alias("gap_fraction_absdiff"))
    return out.withColumn("coverage_weighted_overlap", F.col("distribution_overlap") * F.col("min_valid_fraction"))


def column_rollup(metrics: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("region",), label: str = "class") -> DataFrame:
    """One row per column: global values, class means and ranges, pair means,
    specificity = mean divergence x (1 - global gap share)."""
    own = F.col(label) != GLOBAL
    per = metrics.groupBy(*keys, "pos").agg(
        *[F.max(F.when(~own, F.col(c))).alias(f"global_{c}") for c in ("entropy_norm", "conservation_norm", "gap_fraction")],
        F.avg(F.when(own, F.col("entropy_norm"))).alias("class_entropy_mean"), F.max(F.when(own, F.col("entropy_norm"))).alias("class_entropy_max"),
        F.min(F.when(own, F.col("entropy_norm"))).alias("class_entropy_min"), F.avg(F.when(own, F.col("intra_similarity"))).alias("intra_similarity_mean"),
        F.avg(F.when(own, F.col("gap_fraction"))).alias("gap_fraction_mean"))
    pair = pairs.groupBy(*keys, "pos").agg(F.avg("jsd").alias("pairwise_jsd_mean"), F.max("jsd").alias("pairwise_jsd_max"),
                                           F.avg("distribution_overlap").alias("pairwise_overlap_mean"))
    return (
        per.join(pair, [*keys, "pos"], "left").withColumn("class_entropy_range", F.col("class_entropy_max") - F.col("class_entropy_min"))
        .withColumn("specificity", F.col("pairwise_jsd_mean") * (1.0 - F.col("global_gap_fraction")))
    )


def class_summary(metrics: DataFrame, keys: Sequence[str] = ("region",), label: str = "class") -> DataFrame:
    """Means and median per class; one row per alignment column goes in."""
    return metrics.filter(F.col(label) != GLOBAL).groupBy(*keys, label).agg(
        F.max("n_sequences").alias("n_sequences"), F.avg("entropy_norm").alias("mean_entropy_norm"), F.percentile("entropy_norm", F.lit(0.5)).alias("median_entropy_norm"),
        F.avg("conservation_norm").alias("mean_conservation_norm"), F.avg("intra_similarity").alias("mean_intra_similarity"), F.avg("gap_fraction").alias("mean_gap_fraction"))


def pair_summary(pairs: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    return pairs.groupBy(*keys, "pair", "class_a", "class_b").agg(
        F.avg("distribution_overlap").alias("mean_distribution_overlap"), F.percentile("distribution_overlap", F.lit(0.5)).alias("median_distribution_overlap"),
        F.avg("jsd").alias("mean_jsd"), F.percentile("jsd", F.lit(0.5)).alias("median_jsd"), F.avg("cosine_similarity").alias("mean_cosine"),
        F.avg("coverage_weighted_overlap").alias("mean_coverage_weighted_overlap"), F.avg("gap_fraction_absdiff").alias("mean_gap_fraction_absdiff"))


# Columns of the region recap.
RECAP = ["global_entropy_norm", "class_entropy_mean", "class_entropy_range", "intra_similarity_mean", "pairwise_jsd_mean", "pairwise_jsd_max",
         "pairwise_overlap_mean", "specificity", "global_gap_fraction"]


def region_recap(rollup: DataFrame, threshold: float = 0.0, keys: Sequence[str] = ("region",)) -> DataFrame:
    aggs = []
    for c in RECAP:
        aggs += [F.avg(c).alias(f"mean_{c}"), F.percentile(c, F.lit(0.5)).alias(f"median_{c}")]
    return rollup.groupBy(*keys).agg(*aggs, F.avg((F.col("global_entropy_norm") > threshold).cast("double")).alias("global_variable_site_fraction"),
                                     F.count(F.lit(1)).alias("n_alignment_positions"))


def class_versus_others(pair_means: DataFrame, regions: Sequence[str], value: str = "mean_jsd") -> DataFrame:
    """Each pair counts for both its classes; mean per (class, region), wide."""
    long = pair_means.select("region", value, F.explode(F.array("class_a", "class_b")).alias("class"))
    return long.groupBy("class").agg(*[F.avg(F.when(F.col("region") == r, F.col(value))).alias(r) for r in regions])


def population_columns(counts: DataFrame, classes: Sequence[str] = C.CLASSES, keys: Sequence[str] = ("region",), label: str = "class",
                       sequence_gap: str = "gap_count") -> DataFrame:
    """Global and mean within-class entropy, similarity and variability,
    informativeness, and the major base of every class.

    A class without valid symbols counts as 0 in the means.
    """
    def entropy(n, total):
        return F.abs(_sum([_plogp(F.when(total > 0, x / F.when(total > 0, total)).otherwise(0.0)) for x in n]))
    one = counts.filter(F.col(label) != GLOBAL).groupBy(*keys, "pos").agg(
        F.sum("n_sequences").alias("n_sequences"), F.sum(sequence_gap).alias("_gaps"),
        *[F.sum(f"s_{b}").alias(f"g_{b}") for b in C.BASES],
        *[F.coalesce(F.sum(F.when(F.col(label) == c, F.col(f"s_{b}"))), F.lit(0)).alias(f"{c}_{b}") for c in classes for b in C.BASES])
    g = [F.col(f"g_{b}") for b in C.BASES]
    gt = _sum(g)
    aggs = [
        entropy(g, gt).alias("global_entropy"), F.when(gt > 0, F.greatest(*g) / F.when(gt > 0, gt)).otherwise(0.0).alias("global_consensus_similarity"),
        (_sum([(x > 0).cast("int") for x in g]) > 1).cast("int").alias("global_variable_site"), (F.col("_gaps") / F.col("n_sequences")).alias("gap_fraction"),
    ]
    hs, ss, vs = [], [], []
    for c in classes:
        n = [F.col(f"{c}_{b}") for b in C.BASES]
        t = _sum(n)
        hs.append(entropy(n, t))
        share = F.greatest(*n) / F.when(t > 0, t)
        ss.append(F.coalesce(share, F.lit(0.0)))
        vs.append((_sum([(x > 0).cast("int") for x in n]) > 1).cast("int"))
        base = F.lit(None).cast("string")
        for b in reversed(C.BASES):
            base = F.when(F.col(f"{c}_{b}") == F.greatest(*n), b).otherwise(base)
        aggs += [F.when(t > 0, base).alias(f"{c}_major_base"), share.alias(f"{c}_major_freq")]
    k = float(len(classes))
    aggs += [(_sum(hs) / k).alias("within_entropy_mean"), (_sum(ss) / k).alias("within_similarity_mean"), (_sum(vs) / k).alias("within_variable_mean")]
    out = one.select(*keys, "pos", "n_sequences", *aggs)
    return out.withColumn("informativeness", F.col("global_entropy") - F.col("within_entropy_mean"))


def reference_columns(aligned: DataFrame, names: Sequence[str], name: str, keys: Sequence[str] = ("region",), sequence: str = "aligned") -> DataFrame:
    """Columns of a few aligned references: entropy, consensus share, variable
    flag, gap share, and symbol and ungapped position of every reference."""
    picked = aligned.filter(F.col(name).isin(list(names)))
    long = picked.select(*keys, name, F.inline(numbered_symbols(F.upper(sequence), "-"))).select(
        *keys, name, "pos", F.col("symbol").alias("_s"), F.col("ungapped").alias("_u"))
    out = long.groupBy(*keys, "pos").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_s") == "-").alias("_gaps"), *[F.count_if(F.col("_s") == b).alias(f"s_{b}") for b in C.BASES],
        *[F.max(F.when(F.col(name) == x, F.col("_s"))).alias(f"{x}_base") for x in names],
        *[F.max(F.when(F.col(name) == x, F.col("_u"))).alias(f"{x}_ungapped_pos") for x in names])
    n = [F.col(f"s_{b}") for b in C.BASES]
    t = _sum(n)
    share = [F.when(t > 0, x / F.when(t > 0, t)).otherwise(0.0) for x in n]
    return out.select(
        *keys, "pos", F.abs(_sum([_plogp(p) for p in share])).alias("entropy"), F.greatest(*share).alias("consensus_similarity"),
        (_sum([(x > 0).cast("int") for x in n]) > 1).cast("int").alias("variable_site"), (F.col("_gaps") / F.col("_n")).alias("gap_fraction"),
        *[f"{x}_base" for x in names], *[f"{x}_ungapped_pos" for x in names])


def reference_identities(aligned: DataFrame, names: Sequence[str], name: str, keys: Sequence[str] = ("region",), sequence: str = "aligned") -> DataFrame:
    """Identity and divergence of every pair of a few named references, N = N
    counting as a match."""
    wide = aligned.filter(F.col(name).isin(list(names))).groupBy(*keys).agg(*[F.max(F.when(F.col(name) == x, F.col(sequence))).alias(x) for x in names])
    cells = [F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), identity_of(F.col(a), F.col(b), bases_only=False).alias("identity")) for a, b in combinations(names, 2)]
    return wide.select(*keys, F.inline(F.array(*cells))).withColumn("divergence", 1.0 - F.col("identity"))


def region_divergence(sites: DataFrame, pairs: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Length, entropy, variable sites, gaps and pairwise identity per region."""
    s = sites.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alignment_length"), F.avg("entropy").alias("mean_entropy"), F.max("entropy").alias("max_entropy"),
        F.avg("consensus_similarity").alias("mean_consensus_similarity"), F.sum("variable_site").alias("variable_sites"), F.avg("gap_fraction").alias("mean_gap_fraction"))
    s = s.withColumn("variable_site_fraction", F.col("variable_sites") / F.col("alignment_length"))
    p = pairs.groupBy(*keys).agg(F.avg("identity").alias("mean_pairwise_identity"), F.min("identity").alias("min_pairwise_identity"),
                                 F.max(1.0 - F.col("identity")).alias("max_pairwise_divergence"))
    return s.join(p, list(keys), "left")


def population_regions(sites: DataFrame, identities: DataFrame, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Region summary with within and between identity and their gap."""
    s = sites.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("alignment_length"), F.avg("global_entropy").alias("mean_global_entropy"), F.avg("within_entropy_mean").alias("mean_within_entropy"),
        F.avg("informativeness").alias("mean_informativeness"), F.max("informativeness").alias("max_informativeness"), F.sum("global_variable_site").alias("global_variable_sites"),
        F.avg("within_variable_mean").alias("mean_within_variable_fraction"), F.avg("gap_fraction").alias("mean_gap_fraction"))
    s = s.withColumn("global_variable_site_fraction", F.col("global_variable_sites") / F.col("alignment_length"))
    kind = F.col("comparison_type")
    i = identities.groupBy(*keys).agg(F.avg(F.when(kind == "within", F.col("identity"))).alias("mean_within_identity"),
                                      F.avg(F.when(kind == "between", F.col("identity"))).alias("mean_between_identity"))
    out = s.join(i, list(keys), "left").withColumn("identity_gap", F.col("mean_within_identity") - F.col("mean_between_identity"))
    return out.withColumn("region_order", text.region_order(F.col("region"))) if "region" in keys else out


def identity_of(a: Column, b: Column, bases_only: bool = True) -> Column:
    """Share of equal symbols over comparable positions, null when none.

    Gaps are skipped; ``bases_only`` also skips everything but A, C, G, T.
    Two strings are compared with three length differences per symbol set, in
    array form over one pair at a time.
    """
    both = F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    if bases_only:
        both = F.filter(both, lambda z: z["x"].isin(C.BASES) & z["y"].isin(C.BASES))
    else:
        both = F.filter(both, lambda z: (z["x"] != "-") & (z["y"] != "-") & (z["x"] != "") & (z["y"] != ""))
    acc = F.aggregate(both, F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")),
                      lambda s, z: F.struct((s["n"] + 1).alias("n"), (s["m"] + (z["x"] == z["y"]).cast("int")).alias("m")),
                      lambda s: F.when(s["n"] > 0, s["m"] / s["n"]))
    return acc


# positions per integer mask
_WORD = 60


def base_masks(sequence: Column) -> Column:
    """array<struct<a, c, g, t>> of position bit masks, one per 60 positions.

    Built once per sequence; a pair is then compared with a few bit counts per
    60 positions instead of symbol by symbol.
    """
    up = F.upper(sequence)

    def mask(part, base):
        other = "".join(b for b in C.BASES if b != base)
        bits = F.regexp_replace(F.translate(part, base + other, "1000"), "[^01]", "0")
        return F.conv(bits, 2, 10).cast("bigint")
    starts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(up) / F.lit(float(_WORD))) - 1, F.lit(0)).cast("int"))
    return F.transform(starts, lambda i: let(F.rpad(F.substring(up, i * _WORD + 1, F.lit(_WORD)), _WORD, "-"),
                                             lambda part: F.struct(*[mask(part, b).alias(b.lower()) for b in C.BASES])))


def masked_identity(a: Column, b: Column) -> Column:
    """Identity over positions where both rows hold A, C, G or T."""
    def union(x):
        return x["a"].bitwiseOR(x["c"]).bitwiseOR(x["g"]).bitwiseOR(x["t"])

    def word(x, y):
        same = _sum([F.bit_count(x[k].bitwiseAND(y[k])) for k in "acgt"])
        return F.struct(F.bit_count(union(x).bitwiseAND(union(y))).alias("n"), same.alias("m"))
    return F.aggregate(F.zip_with(a, b, word), F.struct(F.lit(0).alias("n"), F.lit(0).alias("m")),
                       lambda s, z: F.struct((s["n"] + z["n"]).alias("n"), (s["m"] + z["m"]).alias("m")),
                       lambda s: F.when(s["n"] > 0, s["m"] / s["n"]))


def exact_identity(counts: DataFrame, classes: Sequence[str] = C.CLASSES, keys: Sequence[str] = ("region",), label: str = "class") -> DataFrame:
    """Pooled identity within and between classes, exact at any size.

    Matching over comparable symbol pairs, summed over columns: within a class
    with counts n_s, matches are sum n_s (n_s - 1) / 2 of v (v - 1) / 2
    comparable pairs; between classes sum n_s m_s of v w.
    """
    wide = counts.filter(F.col(label) != GLOBAL).groupBy(*keys, "pos").agg(
        *[F.coalesce(F.sum(F.when(F.col(label) == c, F.col(f"s_{b}"))), F.lit(0)).cast("double").alias(f"{c}_{b}") for c in classes for b in C.BASES])
    parts = []
    for c in classes:
        n = [F.col(f"{c}_{b}") for b in C.BASES]
        t = _sum(n)
        parts.append(("within", c, _sum([x * (x - 1) / 2 for x in n]), t * (t - 1) / 2))
    for a, b in combinations(classes, 2):
        x, y = [F.col(f"{a}_{s}") for s in C.BASES], [F.col(f"{b}_{s}") for s in C.BASES]
        parts.append(("between", f"{a}_vs_{b}", _sum([p * q for p, q in zip(x, y)]), _sum(x) * _sum(y)))
    aggs = []
    for i, (_, _, m, t) in enumerate(parts):
        aggs += [F.sum(m).alias(f"_m{i}"), F.sum(t).alias(f"_t{i}")]
    rows = wide.groupBy(*keys).agg(*aggs)
    cells = [F.struct(F.lit(k).alias("comparison_type"), F.lit(n).alias("comparison"), F.try_divide(F.col(f"_m{i}"), F.col(f"_t{i}")).alias("identity"))
             for i, (k, n, _, _) in enumerate(parts)]
    return rows.select(*keys, F.inline(F.array(*cells)))


# draws per block in sampled identity
_BLOCK = 1000


def _ordinals(aligned: DataFrame, keys: Sequence[str], label: str, seq_id: str) -> DataFrame:
    return rk.with_row_number(aligned, [*keys, label], [F.col(seq_id)], "_no").withColumn("_no", F.col("_no") - 1)


def sampled_identity(aligned: DataFrame, most: int, keys: Sequence[str] = ("region",), label: str = "class", seq_id: str = "seq_id", sequence: str = "aligned",
                     seed: int = C.PAIR_SEED, bases_only: bool = True) -> DataFrame:
    """Mean identity over sequence pairs within and between classes, on at most
    ``most`` sampled pairs per group (all pairs when there are no more).  The
    caller asks for the sample size; :func:`exact_identity` takes all pairs.

    Pairs are never listed: a pair is a number below n(n-1)/2 (within) or n*m
    (between), the wanted numbers are drawn, decoded to two ordinals, and the
    sequences are fetched by equi joins on (group, ordinal).
    """
    form = base_masks(F.col(sequence)) if bases_only else F.col(sequence)
    numbered = _ordinals(aligned.select(*keys, label, seq_id, form.alias("_form")), keys, label, seq_id)
    sizes = numbered.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    # classes x classes per region: a few rows
    cell = F.array_sort(F.collect_list(F.struct(F.col(label).alias("c"), "n")))
    groups = sizes.groupBy(*keys).agg(cell.alias("_c")).select(*keys, "_c", F.posexplode("_c").alias("_i", "_a"))
    groups = groups.select(*keys, "_a", F.explode(F.slice("_c", F.col("_i") + 1, F.size("_c"))).alias("_b"))
    within = F.col("_a.c") == F.col("_b.c")
    pairs = F.when(within, F.expr("(_a.n * (_a.n - 1)) div 2")).otherwise(F.col("_a.n") * F.col("_b.n"))
    groups = groups.select(*keys, F.col("_a.c").alias("class_a"), F.col("_b.c").alias("class_b"), F.col("_b.n").alias("_m"), within.alias("_within"), pairs.alias("_pairs"))
    groups = groups.filter(F.col("_pairs") > 0)
    want = F.least(F.col("_pairs"), F.lit(most))
    # a few group rows grow into most draws: spread blocks before the explode
    parts = int(aligned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = groups.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(least(_pairs, {most}L) - 1) div {_BLOCK}"))))
    blocks = blocks.repartition(parts, *keys, "class_a", "class_b", "_block")
    draws = blocks.withColumn("_k", F.explode(F.sequence(F.col("_block") * _BLOCK, F.least(F.col("_block") * _BLOCK + (_BLOCK - 1), want - 1))))
    # one seeded draw per equal slice of the pair numbers: distinct by construction
    u = hashing.digest_uniform(hashing.seeded_digest(seed, *[F.col(k) for k in keys], F.col("class_a"), F.col("class_b"), F.col("_k").cast("string")))
    lo, hi = F.floor(F.col("_k") * F.col("_pairs") / want), F.floor((F.col("_k") + 1) * F.col("_pairs") / want)
    number = F.when(F.col("_pairs") <= most, F.col("_k")).otherwise(lo + F.floor(u * (hi - lo)))
    draws = draws.withColumn("_t", number.cast("bigint"))
    # within: t = j(j-1)/2 + i with i < j; the root is corrected by one where it rounds
    root = F.floor((1 + F.sqrt(8.0 * F.col("_t") + 1)) / 2).cast("bigint")
    draws = draws.withColumn("_j0", root)
    j = F.expr("CASE WHEN _j0 * (_j0 - 1) div 2 > _t THEN _j0 - 1 WHEN (_j0 + 1) * _j0 div 2 <= _t THEN _j0 + 1 ELSE _j0 END")
    draws = draws.withColumn("_j", F.when(F.col("_within"), j).otherwise(F.expr("_t % _m")))
    draws = draws.withColumn("_i", F.when(F.col("_within"), F.expr("_t - _j * (_j - 1) div 2")).otherwise(F.expr("_t div _m")))

    def side(tag):
        return numbered.select(*[F.col(k).alias(k) for k in keys], F.col(label).alias(f"class_{tag}"), F.col("_no").alias("_i" if tag == "a" else "_j"), F.col("_form").alias(f"_s{tag}"))
    rows = draws.select(*keys, "class_a", "class_b", "_within", "_i", "_j").join(side("a"), [*keys, "class_a", "_i"]).join(side("b"), [*keys, "class_b", "_j"])
    same = masked_identity(F.col("_sa"), F.col("_sb")) if bases_only else identity_of(F.col("_sa"), F.col("_sb"), False)
    rows = rows.withColumn("_id", same)
    out = rows.groupBy(*keys, "class_a", "class_b", "_within").agg(F.avg("_id").alias("identity"), F.min("_id").alias("min_identity"), F.count(F.lit(1)).alias("n_pairs"))
    return out.select(*keys, F.when(F.col("_within"), "within").otherwise("between").alias("comparison_type"),
                      F.when(F.col("_within"), F.col("class_a")).otherwise(F.concat("class_a", F.lit("_vs_"), "class_b")).alias("comparison"),
                      "identity", "min_identity", "n_pairs")


def to_genome(sites: DataFrame, value: Column, bounds: Column, keys: Sequence[str] = ("region",)) -> DataFrame:
    """Alignment columns projected on their region's interval, duplicates averaged.

    ``bounds`` is a struct(start, end) column; ``rint(linspace)`` over the
    number of columns of the region.
    """
    n = sites.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    work = sites.withColumn("_v", value).withColumn("_b", bounds).join(n, list(keys))
    step = F.when(F.col("_n") > 1, (F.col("_b.end") - F.col("_b.start")) / F.when(F.col("_n") > 1, F.col("_n") - 1.0)).otherwise(0.0)
    pos = F.rint(F.col("_b.start") + (F.col("pos") - 1) * step).cast("bigint")
    return work.filter(F.col("_v").isNotNull()).groupBy(pos.alias("genome_pos")).agg(F.avg("_v").alias("value"))


def similarity_or_entropy(similarity: Column, entropy: Column) -> Column:
    """Consensus similarity, filled as 1 - entropy / 2 where it is missing."""
    return F.coalesce(similarity, 1.0 - entropy / 2.0)


def consensus_text(metrics: DataFrame, keys: Sequence[str] = ("region",), label: str = "class") -> DataFrame:
    """``class:symbol(share);...`` per column, classes in natural order."""
    from strainlens.functions.annotate import fixed
    symbol = F.when(F.length("consensus") > 0, F.col("consensus")).otherwise("?")
    piece = F.concat(F.col(label), F.lit(":"), symbol, F.lit("("), fixed(F.col("consensus_fraction"), 2), F.lit(")"))
    part = F.struct(text.class_order(F.col(label)).alias("o"), F.col(label).alias("c"), piece.alias("t"))
    out = metrics.filter(F.col(label) != GLOBAL).groupBy(*keys, "pos").agg(F.array_sort(F.collect_list(part)).alias("_p"))
    return out.select(*keys, "pos", F.array_join(F.transform("_p", lambda x: x["t"]), ";").alias("consensus_by_class"))


def top_positions(rollup: DataFrame, metrics: DataFrame, n: int, keys: Sequence[str] = ("region",)) -> DataFrame:
    """The n most specific columns with their rank and consensus text.

    The limit is taken before the consensus text is joined.
    """
    order = [F.col("_key").desc_nulls_last(), *[F.col(k) for k in keys], F.col("pos")]
    best = rollup.withColumn("_key", F.round("specificity", 9)).orderBy(*order).limit(n)
    best = best.withColumn("rank_specificity", F.row_number().over(Window.orderBy(*order))).drop("_key")
    return best.join(consensus_text(metrics, keys), [*keys, "pos"])


def top_pair_positions(pairs: DataFrame, metrics: DataFrame, n: int, keys: Sequence[str] = ("region",)) -> DataFrame:
    """The n most divergent columns of every class pair."""
    w = Window.partitionBy("pair").orderBy(F.round("jsd", 9).desc_nulls_last(), *keys, "pos")
    best = pairs.withColumn("rank_pair_jsd", F.row_number().over(w)).filter(F.col("rank_pair_jsd") <= n)
    return best.join(consensus_text(metrics, keys), [*keys, "pos"])


def numbered_symbols(sequence: Column, gaps: str = C.GAP_SYMBOLS) -> Column:
    """array<struct<pos, symbol, ungapped>> of one aligned row, linear in its
    length: the index inside the non-gap symbols is the ungapped position."""
    marks = list(gaps)

    def build(cells):
        real = F.filter(cells, lambda x: ~x["s"].isin(marks))
        gap = F.filter(cells, lambda x: x["s"].isin(marks))
        return F.concat(
            F.transform(real, lambda x, i: F.struct(x["p"].alias("pos"), x["s"].alias("symbol"), (i + 1).alias("ungapped"))),
            F.transform(gap, lambda x: F.struct(x["p"].alias("pos"), x["s"].alias("symbol"), F.lit(None).cast("int").alias("ungapped"))))
    cells = F.filter(F.transform(F.split(sequence, ""), lambda c, i: F.struct((i + 1).alias("p"), c.alias("s"))), lambda x: x["s"] != "")
    return let(cells, build)


def position_table(aligned: DataFrame, is_reference: Column, keys: Sequence[str] = ("region",), order: str = "seq_id", sequence: str = "aligned") -> DataFrame:
    """Reference position and symbol per alignment column (null on gaps), from
    the first record that matches."""
    rest = F.struct(F.col(order).alias("o"), F.col(sequence).alias("s"))
    ref = aligned.filter(is_reference).groupBy(*keys).agg(F.min(rest)["s"].alias("_q"))
    return ref.select(*keys, F.inline(numbered_symbols(F.col("_q")))).select(
        *keys, "pos", F.col("ungapped").alias("ref_pos"), F.col("symbol").alias("ref_symbol"))


def score_on_columns(scores: DataFrame, position: str, value: str, table: DataFrame | None = None, keys: Sequence[str] = ("region",), zero_based: bool = False) -> DataFrame:
    """Scores by alignment column: rounded positions, optional shift to 1-based,
    reference coordinates translated through the position table, duplicates
    averaged."""
    pos = F.bround(F.col(position).cast("double"), 0).cast("int")
    pos = pos + 1 if zero_based else pos
    work = scores.filter(F.col(position).isNotNull() & F.col(value).isNotNull()).select(*keys, pos.alias("_at"), F.col(value).alias("_v"))
    if table is not None:
        known = table.filter(F.col("ref_pos").isNotNull()).select(*keys, F.col("ref_pos").alias("_at"), "pos")
        work = work.join(known, [*keys, "_at"])
    else:
        work = work.withColumnRenamed("_at", "pos")
    return work.groupBy(*keys, "pos").agg(F.avg("_v").alias("score"))


def correlations(joined: DataFrame, score: str, metrics: Sequence[str]) -> DataFrame:
    """Pearson and Spearman of the score with every metric.

    Null below three finite pairs or without variance.  Ranks are taken over
    each series' own finite values.  One row per alignment column goes in, so
    a window per metric is bounded by the alignment length.
    """
    long = joined.select(score, *metrics).unpivot([score], list(metrics), "metric", "value")

    def rank(c):
        w = Window.partitionBy("metric", F.col(c).isNull())
        tied = F.count(F.lit(1)).over(Window.partitionBy("metric", c))
        return F.when(F.col(c).isNotNull(), F.rank().over(w.orderBy(c)) + (tied - 1) / 2.0)
    ranked = long.withColumn("_rv", rank("value")).withColumn("_rs", rank(score))

    def safe(x, y):
        ok = x.isNotNull() & y.isNotNull()
        a, b = F.when(ok, x.cast("double")), F.when(ok, y.cast("double"))
        n = F.count_if(ok)
        sa, sb = F.stddev_pop(a), F.stddev_pop(b)
        return F.when((n >= 3) & (sa > 0) & (sb > 0), F.try_divide(F.covar_pop(a, b), sa * sb)), n
    p, n = safe(F.col(score), F.col("value"))
    s, _ = safe(F.col("_rs"), F.col("_rv"))
    return ranked.groupBy("metric").agg(n.alias("n_positions"), p.alias("pearson_r"), s.alias("spearman_rho"))


def mapped_texts(ref: Column, target: Column) -> Column:
    """Target text per reference position (array, index = position - 1).

    Insertions attach to the previous reference position; those before the
    first one are left out.  Linear in the alignment length, inside one row.
    """
    def cut(state):
        starts, cells = state["starts"], state["cells"]
        end = F.size(cells)
        return F.transform(starts, lambda p, k: F.array_join(F.filter(
            F.slice(cells, p + 1, F.coalesce(F.get(starts, k + 1), end) - p), lambda c: c != "-"), ""))
    starts = F.transform(F.filter(F.transform(F.split(ref, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))),
                                  lambda x: (x["c"] != "-") & (x["c"] != "")), lambda x: x["i"])
    cells = F.filter(F.split(F.upper(target), ""), lambda c: c != "")
    return let(F.struct(starts.alias("starts"), cells.alias("cells")), cut)


def alignment_map(pairs: DataFrame, keys: Sequence[str], ref: str = "ref", target: str = "target") -> DataFrame:
    """(keys, ref_pos, target_text, target_pos) of gapped pair rows.

    ``target_pos`` is the running count of target symbols up to the column of
    the reference position; the window covers one pair of rows.
    """
    lead = F.length(F.regexp_replace(F.expr(f"substring({target}, 1, length({ref}) - length(ltrim('-', {ref})))"), "-", ""))
    first_gap = F.transform(F.filter(F.transform(F.split(ref, ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))),
                                     lambda x: (x["c"] != "-") & (x["c"] != "")), lambda x: x["i"])
    rows = pairs.select(*keys, lead.alias("_lead"), first_gap.alias("_starts"), F.split(F.upper(target), "").alias("_cells"),
                        mapped_texts(F.col(ref), F.col(target)).alias("_texts"))
    long = rows.select(*keys, "_lead", F.posexplode(F.arrays_zip(
        F.col("_texts").alias("text"), F.transform("_starts", lambda p: (F.get("_cells", p) == "-").cast("int")).alias("gap"))).alias("_k", "_z"))
    w = Window.partitionBy(*keys).orderBy("_k")
    before = F.coalesce(F.sum(F.length("_z.text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.when(F.col("_z.gap") == 1, 0).otherwise(1)
    return long.select(*keys, (F.col("_k") + 1).alias("ref_pos"), F.col("_z.text").alias("target_text"), (F.col("_lead") + before + own).cast("bigint").alias("target_pos"))


def region_text(texts: Column, start: Column, end: Column) -> Column:
    """Target text of a reference interval (1-based, closed), U read as T."""
    first = F.greatest(start, F.lit(1))
    return F.translate(F.array_join(F.slice(texts, first, F.greatest(end - first + 1, F.lit(0))), ""), "U", "T")
