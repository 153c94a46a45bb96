"""Leakage-aware train/validation/test splits and seeded samples.

Every selection "the first q of a group in seeded order" goes through the
bucketed row number, so a group holding most of the records is still spread.
"""
from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens.functions import hashing
from strainlens.functions import ranking as rk
from strainlens.session import cut_lineage


def seeded_cutoffs(df: DataFrame, keys: Sequence[str], quota: DataFrame, seed, ids: Sequence[str]) -> DataFrame:
    """(keys, quota, cutoff): the digest and ids of the last record inside the
    quota of every group, in seeded hash order.

    A histogram of digest buckets finds the bucket in which the quota ends;
    only the records of that bucket (about 1 in 65536) are ordered.  Selecting
    "the first q" is then a comparison with the cutoff, so the records
    themselves are never shuffled.  A null cutoff with a positive quota means
    the whole group.  ``quota`` has one row per group.
    """
    work = df.select(*keys, *ids, hashing.seeded_digest(seed, *ids).alias("_digest"))
    work = work.withColumn("_bucket", rk.digest_bucket(F.col("_digest")))
    hist = work.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_bucket"))
    edge = hist.withColumn("_upto", upto).join(quota, list(keys))
    edge = edge.filter((F.col("_upto") >= F.col("quota")) & (F.col("_upto") - F.col("_n") < F.col("quota")))
    edge = edge.select(*keys, "_bucket", (F.col("quota") - F.col("_upto") + F.col("_n")).alias("_take"))
    # one row per group: the groups are folds x classes; written, so that Spark knows it as the small side and never broadcasts the records
    edge = cut_lineage(edge, "edges")
    near = work.join(edge, [*keys, "_bucket"])
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("_digest", *ids))
    last = near.withColumn("_rn", place).filter(F.col("_rn") == F.col("_take"))
    return quota.join(last.select(*keys, F.struct("_digest", *ids).alias("cutoff")), list(keys), "left")


def inside_quota(seed, ids: Sequence[str]) -> Column:
    """Whether a row joined with its group's cutoff is within the quota."""
    own = F.struct(hashing.seeded_digest(seed, *ids).alias("_digest"), *ids)
    return (F.col("quota") > 0) & (F.col("cutoff").isNull() | (own <= F.col("cutoff")))


def validation_quota(counts: DataFrame, fold: str, label: str, size: float = C.VALIDATION_SHARE) -> DataFrame:
    """Validation rows per (fold, class).

    The total is round-half-even(size * n) (or an absolute size), kept between
    1 and n - 1.  Classes share it by largest remainder when every class has
    two rows and both sides can hold every class; otherwise the quota is one
    number per fold (class null).  Input: one row per (fold, class) with n.
    """
    w = Window.partitionBy(fold)
    n, k, low = F.sum("n").over(w), F.count(F.lit(1)).over(w), F.min("n").over(w)
    want = F.bround(n * size, 0).cast("bigint") if size < 1 else F.lit(int(size)).cast("bigint")
    total = F.when(n <= 1, F.lit(0)).otherwise(F.greatest(F.lit(1), F.least(want, n - 1))).cast("bigint")
    work = counts.select(fold, label, "n", n.alias("_n"), k.alias("_k"), low.alias("_low"), total.alias("_total"))
    ok = (F.col("_k") > 1) & (F.col("_low") >= 2) & (F.col("_total") >= F.col("_k")) & (F.col("_n") - F.col("_total") >= F.col("_k"))
    work = work.withColumn("stratified", ok)
    # integer arithmetic: share = total * n_c / n, remainder decides the rest
    whole = F.expr("(_total * n) div _n")
    rest = F.expr("(_total * n) % _n")
    work = work.withColumn("_whole", whole).withColumn("_rest", rest)
    left = F.col("_total") - F.sum("_whole").over(w)
    place = F.row_number().over(w.orderBy(F.col("_rest").desc(), F.col(label)))
    quota = F.when(F.col("stratified"), F.col("_whole") + (place <= left).cast("int")).otherwise(F.col("_total"))
    return work.withColumn("quota", quota.cast("bigint")).select(fold, label, "stratified", "quota")


def mark_splits(rows: DataFrame, fold: str, index: str, label: str, is_test: Column, size: float = C.VALIDATION_SHARE, seed: int = C.SEED) -> DataFrame:
    """Add ``split``: test rows, a stratified validation share of every fold's
    training pool, training rows.

    The final step is a projection over ``rows`` joined with one small row per
    (fold, class).
    """
    rows = rows.withColumn("_test", is_test)
    pool = rows.filter(~F.col("_test"))
    counts = pool.groupBy(fold, label).agg(F.count(F.lit(1)).alias("n"))
    # folds x classes rows, written once: several later steps read them
    quota = cut_lineage(validation_quota(counts, fold, label, size), "quota")
    # a fold that cannot be stratified has one group and one quota
    shape = quota.groupBy(fold).agg(F.max("stratified").alias("_strat"), F.max("quota").alias("_whole"))
    # folds are a given list: one row each
    rows = rows.join(shape.select(fold, "_strat"), fold, "left")
    group = F.when(F.col("_strat"), F.col(label).cast("string")).otherwise(F.lit("")).alias("_group")
    rows = rows.select("*", group)
    per_class = quota.filter("stratified").select(fold, F.col(label).cast("string").alias("_group"), "quota")
    per_fold = shape.filter(~F.col("_strat")).select(fold, F.lit("").alias("_group"), F.col("_whole").alias("quota"))
    cut = cut_lineage(seeded_cutoffs(rows.filter(~F.col("_test")), [fold, "_group"], per_class.unionByName(per_fold), seed, [fold, index]), "cutoffs")
    # folds x classes rows
    out = rows.join(cut, [fold, "_group"], "left")
    split = F.when(F.col("_test"), "test").when(inside_quota(seed, [fold, index]), "val").otherwise("train")
    return out.withColumn("split", split).drop("_test", "_strat", "_group", "quota", "cutoff")


def leave_one_group_out(df: DataFrame, index: str, label: str, group: str, groups: Sequence[str], include_unknown: bool = True,
                        size: float = C.VALIDATION_SHARE, seed: int = C.SEED) -> DataFrame:
    """One fold per listed group: its rows test, a stratified share of the
    rest validation, the remainder training.

    Output has (folds x records) rows by definition; it is one narrow
    projection, an ``explode`` of the literal group list.  Folds whose test
    or training side would be empty are left out.
    """
    listed = [g for g in groups if include_unknown or g != C.UNKNOWN]
    # the records as three narrow columns, read by every later step
    base = cut_lineage(df.select(F.col(index).alias("index"), F.col(label).alias("class"), F.col(group).alias("_own")), "records")
    sizes = base.agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("_own") == g).alias(f"_g{i}") for i, g in enumerate(listed)])
    usable = sizes.select(F.array_compact(F.array(*[
        F.when((F.col(f"_g{i}") > 0) & (F.col(f"_g{i}") < F.col("_all")), F.lit(g)) for i, g in enumerate(listed)])))
    rows = base.select("index", "class", "_own", F.explode(usable.scalar()).alias("fold"))
    out = mark_splits(rows, "fold", "index", "class", F.coalesce(F.col("_own") == F.col("fold"), F.lit(False)), size, seed)
    return out.select("fold", "index", "split", F.col("fold").alias("group"), "class")


def fill_order(sizes: DataFrame, key: str, k: int) -> DataFrame:
    """Where the greedy rule puts the clusters of every (class, size).

    Greedy: clusters by size descending, each to the least loaded fold, lowest
    fold on ties.  Clusters of one size are interchangeable, so the rule runs
    over the histogram (size, m).  With loads L and equal items s, the fold
    sequence is the merge of the series L_i + j * s; folds joining that merge
    one by one make it piecewise periodic, so at most k + 1 segments
    (first, last, order of folds) describe m clusters.  The number of distinct
    sizes per class is at most about the square root of twice the records.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf[key].iloc[0]
        load = [0] * k
        rows = []
        for size, m in pdf.sort_values("size", ascending=False)[["size", "n"]].itertuples(index=False):
            size, m, at = int(size), int(m), 0
            while at < m:
                low = min(load)
                # folds reachable before any other fold joins the merge
                active = sorted((i for i in range(k) if load[i] < low + size), key=lambda i: (load[i], i))
                waiting = [load[i] for i in range(k) if i not in active]
                rounds = (m - at) // len(active)
                if waiting:
                    rounds = min(rounds, max(0, (min(waiting) - max(load[i] for i in active) - 1) // size))
                if rounds < 1:
                    i = active[0]
                    rows.append((name, size, at, at, [i]))
                    load[i] += size
                    at += 1
                    continue
                rows.append((name, size, at, at + rounds * len(active) - 1, list(active)))
                for i in active:
                    load[i] += rounds * size
                at += rounds * len(active)
        return pd.DataFrame(rows, columns=[key, "size", "first", "last", "folds"])

    schema = f"{key} string, size bigint, first bigint, last bigint, folds array<int>"
    return sizes.groupBy(key).applyInPandas(run, schema)


def cluster_folds(members: DataFrame, key: str, cluster: str, k: int = C.FOLDS) -> DataFrame:
    """Fold of every cluster (``fold_1`` .. ``fold_k``), balanced per class."""
    clusters = members.groupBy(key, cluster).agg(F.count(F.lit(1)).alias("size"))
    hist = clusters.groupBy(key, "size").agg(F.count(F.lit(1)).alias("n"))
    segments = fill_order(hist, key, k)
    # stable order inside one size: cluster id, numbered without a whole-group window
    numbered = rk.with_row_number(clusters, [key, "size"], [F.col(cluster)], "_no")
    numbered = numbered.withColumn("_no", F.col("_no") - 1)
    joined = numbered.join(segments, [key, "size"]).filter((F.col("_no") >= F.col("first")) & (F.col("_no") <= F.col("last")))
    slot = F.pmod(F.col("_no") - F.col("first"), F.size("folds").cast("bigint")).cast("int")
    return joined.select(key, cluster, "size", F.concat(F.lit("fold_"), F.get("folds", slot) + 1).alias("cluster_fold"))


def cluster_aware_splits(members: DataFrame, folds: DataFrame, index: str, key: str, cluster: str, k: int = C.FOLDS,
                         size: float = C.VALIDATION_SHARE, seed: int = C.SEED) -> DataFrame:
    """Train/validation/test per fold; ``group`` is the record's own fold."""
    own = cut_lineage(members.join(folds.select(key, cluster, "cluster_fold"), [key, cluster]).select(index, key, cluster, "cluster_fold"), "records")
    names = F.array(*[F.lit(f"fold_{i + 1}") for i in range(k)])
    rows = own.select(F.col(index).alias("index"), F.col(key).alias("class"), F.col(cluster).alias("cluster_id"),
                      F.col("cluster_fold").alias("group"), F.explode(names).alias("fold"))
    out = mark_splits(rows, "fold", "index", "class", F.col("group") == F.col("fold"), size, seed)
    return out.select("fold", "index", "split", "group", "class", "cluster_id")


def sample_per_class(df: DataFrame, label: str, most: int, *ids: str, seed: int = C.PAIR_SEED) -> DataFrame:
    """At most ``most`` records per class in seeded order, without replacement."""
    if most is None or most <= 0:
        return df
    quota = df.groupBy(label).agg(F.lit(most).cast("bigint").alias("quota"))
    cut = seeded_cutoffs(df, [label], quota, seed, list(ids))
    # one row per class
    return df.join(cut, label).filter(inside_quota(seed, list(ids))).select(*df.columns)


def weighted_draws(df: DataFrame, weight: str, draws: int, *id_cols: str, seed: int = C.SEED) -> DataFrame:
    """``draws`` records drawn with replacement in proportion to ``weight``.

    Integer weights are laid out as consecutive ranges; draw d picks a seeded
    uniform point.  Range starts and points are sorted together: a point takes
    the last start at or before it, from its own stretch of the order or, at a
    stretch's beginning, from the last one before that has any.  The work is
    linear in records and draws, and a heavy record is no hot key.
    """
    work = df.withColumn("_digest", hashing.seeded_digest(seed, *id_cols))
    order = [F.col("_digest"), *[F.col(c) for c in id_cols]]
    ranges = rk.with_prefix_sums(work, [], order, {"w": F.col(weight).cast("bigint")}).filter(F.col(weight) > 0)
    starts = ranges.select(F.col("w_before").alias("_at"), F.lit(None).cast("bigint").alias("draw"), F.struct(*df.columns).alias("_row"))
    total = df.agg(F.sum(F.col(weight).cast("bigint"))).scalar()
    points = df.sparkSession.range(draws).select(F.col("id").alias("draw"))
    u = hashing.digest_uniform(hashing.seeded_digest(seed, F.lit("draw"), F.col("draw").cast("string")))
    points = points.withColumn("_t", total).filter("_t > 0").select(F.least(F.floor(u * F.col("_t")), F.col("_t") - 1).alias("_at"), "draw")
    both = rk.ordered_ranges(starts.unionByName(points, allowMissingColumns=True), [F.col("_at"), F.col("draw").asc_nulls_first()])
    # the last record of each range of the order, carried to the ranges behind it
    last = both.filter(F.col("_row").isNotNull()).groupBy("_part").agg(F.max_by("_row", "_at").alias("_last"))
    spans = both.select("_part").distinct().join(last, "_part", "left")
    carried = F.last("_last", ignorenulls=True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select("_part", carried.alias("_carried"))
    here = Window.partitionBy("_part").orderBy("_at", F.col("draw").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    hit = both.withColumn("_own", F.last("_row", ignorenulls=True).over(here)).filter(F.col("draw").isNotNull())
    return hit.join(spans, "_part").select("draw", F.coalesce("_own", "_carried").alias("_row")).select("draw", "_row.*")
