"""Score profiles, region values, region tests and their consensus."""
from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens.functions import ranking as rk
from strainlens.operators import consensus, profiles, rank_tests, windows
from strainlens.plans import views
from strainlens.plans.catalog_metrics import CHI2_SQL, rounded
from strainlens.plans.registry import query

IDS = views.STRATEGIES


def prof(spark, sf):
    return views.profiles(spark, sf)


def named_class(col="class"):
    return F.concat(F.lit("DENV"), F.col(col) + 1)


@query("s11_profile_scan", """
    SELECT fold, count(DISTINCT sample) AS n_samples, count(*) AS n_positions, count(*) FILTER (valid) AS n_valid, round(sum(score), 6) AS total FROM plong GROUP BY fold""", ("plong",))
def profile_scan(spark, sf):
    from strainlens.session import scratch_path
    from strainlens.sources import predictions as src
    path = scratch_path(spark, "profiles")
    src.write_profiles(prof(spark, sf), path)
    p = src.read_profiles(spark, path)
    s = F.aggregate("scores", F.lit(0.0), lambda a, x: a + x)
    out = p.groupBy("fold").agg(F.count(F.lit(1)).alias("n_samples"), F.sum(F.size("scores")).alias("n_positions"),
                                F.sum(F.size(F.filter("valid", lambda v: v))).alias("n_valid"), F.sum(s).alias("total"))
    return rounded(out, "total")


@query("a16_class_profile", """
    SELECT class, pos, round(sum(score) FILTER (valid) / nullif(count(*) FILTER (valid), 0), 6) AS value, count(*) FILTER (valid) AS n_valid, count(*) AS n_samples FROM plong GROUP BY class, pos""", ("plong",))
def class_profile(spark, sf):
    return rounded(profiles.class_profile(prof(spark, sf), ["class"]), "value")


@query("a16_class_profile_sum", """
    WITH t AS (SELECT sample, sum(abs(score)) FILTER (valid) AS total FROM plong GROUP BY sample)
    SELECT class, pos, round(sum(CASE WHEN valid THEN abs(score) / total ELSE 0 END), 6) AS value, count(*) FILTER (valid) AS n_valid, count(*) AS n_samples FROM plong JOIN t USING (sample) GROUP BY class, pos""", ("plong",))
def class_profile_sum(spark, sf):
    return rounded(profiles.class_profile(prof(spark, sf), ["class"], mode="abs_sum1", divide=False), "value")


@query("a17_overall_profile", """
    SELECT pos, round(sum(score) FILTER (valid) / nullif(count(*) FILTER (valid), 0), 6) AS value, count(*) FILTER (valid) AS n_valid, count(*) AS n_samples FROM plong GROUP BY pos""", ("plong",))
def overall_profile(spark, sf):
    return rounded(profiles.class_profile(prof(spark, sf), []), "value")


@query("a18_unmasked_profile", """
    SELECT fold, class, pos, round(avg(score), 6) AS value, count(*) AS n_valid, count(*) AS n_samples FROM plong GROUP BY fold, class, pos""", ("plong",))
def unmasked_profile(spark, sf):
    return rounded(profiles.class_profile(prof(spark, sf), ["fold", "class"], valid=None), "value")


@query("a19_sample_scaling", """
    WITH t AS (SELECT sample, sum(score) FILTER (valid) AS s, sum(abs(score)) FILTER (valid) AS a FROM plong GROUP BY sample)
    SELECT sample, pos, round(CASE WHEN valid THEN score ELSE 0 END, 6) AS none, round(CASE WHEN valid AND s <> 0 THEN score / s ELSE 0 END, 4) AS sum1,
      round(CASE WHEN valid AND a <> 0 THEN abs(score) / a ELSE 0 END, 6) AS abs_sum1 FROM plong JOIN t USING (sample)""", ("plong",))
def sample_scaling(spark, sf):
    p = prof(spark, sf)
    s, v = F.col("scores"), F.col("valid")
    w = p.select("sample", profiles.scale_sample(s, "none", v).alias("none"), profiles.scale_sample(s, "sum1", v).alias("sum1"), profiles.scale_sample(s, "abs_sum1", v).alias("abs_sum1"))
    long = w.select("sample", F.posexplode(F.arrays_zip("none", "sum1", "abs_sum1")).alias("pos", "z")).select("sample", F.col("pos").cast("bigint").alias("pos"), "z.*")
    return long.withColumn("none", F.round("none", 6)).withColumn("sum1", F.round("sum1", 4)).withColumn("abs_sum1", F.round("abs_sum1", 6))


_CP = "WITH c AS (SELECT class, pos, avg(score) FILTER (valid) AS v FROM plong GROUP BY class, pos)"


@query("a20_profile_scaling", _CP + """
    SELECT class, pos, round((v - min(v) OVER (PARTITION BY class)) / (max(v) OVER (PARTITION BY class) - min(v) OVER (PARTITION BY class)), 6) AS by_class,
      round((v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()), 6) AS by_all FROM c""", ("plong",))
def profile_scaling(spark, sf):
    p = profiles.class_profile(prof(spark, sf), ["class"])
    p = profiles.scale_profile(profiles.scale_profile(p, ["class"], "value", "class", "by_class"), ["class"], "value", "global", "by_all")
    return rounded(p.select("class", F.col("pos").cast("bigint").alias("pos"), "by_class", "by_all"), "by_class", "by_all")


@query("a21_region_reduction", """
    SELECT sample, region, round(avg(score), 6) AS mean, round(sum(score), 6) AS sum, round(quantile_cont(score, 0.5), 6) AS median
    FROM plong JOIN regions ON pos >= "start" AND pos < "end" GROUP BY sample, region""", ("plong", "regions"))
def region_reduction(spark, sf):
    p = prof(spark, sf)
    x = F.col("scores")
    rows = p.select("sample", "scores", F.explode(views.region_array()).alias("r"))
    part = F.slice(x, F.col("r.start") + 1, F.least(F.size(x), F.col("r.end")) - F.col("r.start"))
    return rows.select("sample", "r.region", *[F.round(profiles._reduce(part, h), 6).alias(h) for h in ("mean", "sum", "median")])


_REGION_LONG = """
    WITH a AS (SELECT sample, sum(abs(score)) AS a FROM plong GROUP BY sample),
    rl AS (SELECT fold, sample, class, region, region_order, avg(abs(score) / a) AS value FROM plong JOIN a USING (sample)
      JOIN regions ON pos >= "start" AND pos < "end" GROUP BY ALL)"""


@query("j05_region_values", _REGION_LONG + " SELECT fold, sample, class, region, region_order, round(value, 6) AS value FROM rl", ("plong", "regions"))
def region_values(spark, sf):
    return rounded(profiles.region_values(prof(spark, sf), ["fold", "sample", "class"], views.region_array(), normalise="abs"), "value")


# Region values on a grid of 1e-4, so that ties occur and floating noise cannot
# change an order.
_RL = """
    WITH rl AS (SELECT strategy, fold, sample, 'DENV' || (class + 1) AS class, region, region_order, round(avg(score), 4) AS value
      FROM splong JOIN regions ON pos >= "start" AND pos < "end" GROUP BY ALL)"""


def region_long(spark, sf):
    p = views.strategy_profiles(spark, sf)
    out = profiles.region_values(p, ["strategy", "fold", "sample", "class"], views.region_array())
    return out.withColumn("class", named_class()).withColumn("value", F.round("value", 4))


@query("w03_average_rank", _RL + """
    SELECT strategy, sample, region, value, rank() OVER (PARTITION BY strategy, region ORDER BY value) + (count(*) OVER (PARTITION BY strategy, region, value) - 1) / 2.0 AS avg_rank FROM rl""", ("splong", "regions"))
def average_rank(spark, sf):
    r = region_long(spark, sf).select("strategy", "sample", "region", "value")
    return rk.average_rank(r, ["strategy", "region"], "value")


_H = _RL + f"""
    , r AS (SELECT strategy, region, class, value, rank() OVER (PARTITION BY strategy, region ORDER BY value) + (count(*) OVER (PARTITION BY strategy, region, value) - 1) / 2.0 AS rk,
        count(*) OVER (PARTITION BY strategy, region, value) AS t FROM rl),
    n AS (SELECT strategy, region, count(*) AS n, sum(t * t - 1) AS ties FROM r GROUP BY ALL),
    s AS (SELECT strategy, region, sum(q) AS acc, count(*) AS k FROM (SELECT strategy, region, class, sum(rk) * sum(rk) / count(*) AS q FROM r GROUP BY ALL) GROUP BY ALL),
    h AS (SELECT strategy, region, k, n, (12.0 / (n * (n + 1)) * acc - 3 * (n + 1)) / (1 - ties / (n::DOUBLE * n * n - n)) AS h FROM n JOIN s USING (strategy, region)),
    hp AS (SELECT *, {CHI2_SQL.format(x='h', df='(k - 1)')} AS p, greatest(0, least(1, h / (n - 1.0))) AS eps, greatest(0, least(1, (h - k + 1) / (n - k))) AS eta FROM h),
    kw AS (SELECT *, least(1.0, min(p * m / i) OVER (PARTITION BY strategy ORDER BY p DESC, region DESC)) AS p_fdr FROM (
        SELECT *, count(*) OVER (PARTITION BY strategy) AS m, row_number() OVER (PARTITION BY strategy ORDER BY p, region) AS i FROM hp)),
    cc AS (SELECT strategy, region, class, value, count(*) AS c FROM rl GROUP BY ALL),
    pr AS (SELECT a.strategy, a.region, a.class AS class_a, b.class AS class_b, sum(a.c * b.c * CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END)::DOUBLE AS u
        FROM cc a JOIN cc b ON a.strategy = b.strategy AND a.region = b.region AND a.class < b.class GROUP BY ALL),
    cn AS (SELECT strategy, region, class, sum(c) AS n FROM cc GROUP BY ALL),
    ti AS (SELECT strategy, region, class_a, class_b, sum(t * t * t - t) AS ties FROM (SELECT cc.strategy, cc.region, class_a, class_b, value, sum(c) AS t FROM cc
        JOIN (SELECT DISTINCT class_a, class_b FROM pr) q ON cc.class IN (class_a, class_b) GROUP BY ALL) GROUP BY ALL),
    mw0 AS (SELECT pr.*, x.n AS n_a, y.n AS n_b, ties FROM pr JOIN cn x ON x.strategy = pr.strategy AND x.region = pr.region AND x.class = class_a
        JOIN cn y ON y.strategy = pr.strategy AND y.region = pr.region AND y.class = class_b
        JOIN ti ON ti.strategy = pr.strategy AND ti.region = pr.region AND ti.class_a = pr.class_a AND ti.class_b = pr.class_b),
    mw1 AS (SELECT *, (greatest(u, n_a * n_b - u) - n_a * n_b / 2.0 - 0.5) / sqrt(n_a * n_b / 12.0 * ((n_a + n_b + 1) - ties / ((n_a + n_b) * (n_a + n_b - 1.0)))) AS z FROM mw0),
    mw2 AS (SELECT *, CASE WHEN z <= 0 THEN 1.0 ELSE least(1.0, {CHI2_SQL.format(x='(z * z)', df='1')}) END AS p, u / (n_a * n_b) AS vda, class_a || 'v' || class_b AS comparison FROM mw1),
    mw AS (SELECT *, least(1.0, min(p * m / i) OVER (PARTITION BY strategy ORDER BY p DESC, region DESC, comparison DESC)) AS p_fdr,
        least(1.0, min(p * m2 / i2) OVER (PARTITION BY strategy, region ORDER BY p DESC, comparison DESC)) AS p_fdr_region FROM (
        SELECT *, count(*) OVER (PARTITION BY strategy) AS m, row_number() OVER (PARTITION BY strategy ORDER BY p, region, comparison) AS i,
          count(*) OVER (PARTITION BY strategy, region) AS m2, row_number() OVER (PARTITION BY strategy, region ORDER BY p, comparison) AS i2 FROM mw2))"""


def value_table(spark, sf):
    return rank_tests.group_value_table(region_long(spark, sf), ["strategy", "region"], "class", C.CLASSES, "value")


def kruskal_tables(spark, sf):
    return rank_tests.region_kruskal(value_table(spark, sf), ["strategy", "region"], C.CLASSES, ["strategy"])


def pair_tables(spark, sf, within=()):
    return rank_tests.mann_whitney_pairs(value_table(spark, sf), ["strategy", "region"], C.CLASSES, ["strategy"], within)


@query("a40_kruskal_by_region", _H + """
    SELECT strategy, region, CAST(k AS INTEGER) AS n_groups, n AS "N", round(h, 6) AS "H", round(p, 6) AS p, round(eta, 6) AS eta_squared_H, round(eps, 6) AS epsilon_squared_R,
      CASE WHEN eps >= 0.14 THEN 'large' WHEN eps >= 0.06 THEN 'medium' WHEN eps >= 0.01 THEN 'small' ELSE 'negligible' END AS effect_size_magnitude, round(p_fdr, 6) AS p_fdr FROM kw""", ("splong", "regions"))
def kruskal_by_region(spark, sf):
    return rounded(kruskal_tables(spark, sf), "H", "p", "p_fdr", "eta_squared_H", "epsilon_squared_R")


_PAIR_SELECT = """
    SELECT strategy, region, class_a, class_b, comparison, CAST(n_a AS BIGINT) AS n_a, CAST(n_b AS BIGINT) AS n_b, round(u, 6) AS "U", round(p, 6) AS p, round(vda, 6) AS "VDA",
      round(greatest(vda, 1 - vda), 6) AS "VDA_folded", round(2 * vda - 1, 6) AS rank_biserial, round(2 * vda - 1, 6) AS cliffs_delta,
      CASE WHEN abs(2 * vda - 1) >= 0.43 THEN 'large' WHEN abs(2 * vda - 1) >= 0.28 THEN 'medium' WHEN abs(2 * vda - 1) >= 0.11 THEN 'small' ELSE 'negligible' END AS effect_size_magnitude,
      CASE WHEN 2 * vda - 1 > 0 THEN class_a WHEN 2 * vda - 1 < 0 THEN class_b ELSE 'tie' END AS dominant_class, round({p}, 6) AS p_fdr FROM mw"""


@query("a41_pairwise_by_region", _H + _PAIR_SELECT.format(p="p_fdr"), ("splong", "regions"))
def pairwise_by_region(spark, sf):
    return rounded(pair_tables(spark, sf), "U", "p", "p_fdr", "VDA", "VDA_folded", "rank_biserial", "cliffs_delta")


@query("a41_pairwise_within_region", _H + _PAIR_SELECT.format(p="p_fdr_region"), ("splong", "regions"))
def pairwise_within_region(spark, sf):
    return rounded(pair_tables(spark, sf, ["region"]), "U", "p", "p_fdr", "VDA", "VDA_folded", "rank_biserial", "cliffs_delta")


@query("q02_box_analysis", """
    WITH rl AS (SELECT scope, 'DENV' || (class + 1) AS class, region, round(v, 4) AS value FROM (
      SELECT sample, class, fold, region, avg(score) AS v FROM plong JOIN regions ON pos >= "start" AND pos < "end" GROUP BY ALL) r
      CROSS JOIN LATERAL (SELECT unnest(['dataset', 'fold ' || fold]) AS scope)),
    cc AS (SELECT scope, region, class, value, count(*) AS c FROM rl GROUP BY ALL),
    cn AS (SELECT scope, region, class, sum(c) AS n FROM cc GROUP BY ALL),
    pr AS (SELECT a.scope, a.region, a.class AS ca, b.class AS cb, sum(a.c * b.c * CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5 ELSE 0 END)::DOUBLE AS u
        FROM cc a JOIN cc b ON a.scope = b.scope AND a.region = b.region AND a.class < b.class GROUP BY ALL),
    m AS (SELECT pr.scope, pr.region, ca || 'v' || cb AS comparison, u / (x.n * y.n) AS vda FROM pr JOIN cn x ON x.scope = pr.scope AND x.region = pr.region AND x.class = ca
        JOIN cn y ON y.scope = pr.scope AND y.region = pr.region AND y.class = cb WHERE x.n >= 2 AND y.n >= 2)
    SELECT scope, region, comparison, round(greatest(vda, 1 - vda), 6) AS vda_folded, round(2 * vda - 1, 6) AS rank_biserial FROM m""", ("plong", "regions"))
def box_analysis(spark, sf):
    p = profiles.region_values(prof(spark, sf), ["fold", "sample", "class"], views.region_array())
    scope = F.explode(F.array(F.lit("dataset"), F.concat(F.lit("fold "), "fold"))).alias("scope")
    rows = p.select(scope, named_class().alias("class"), "region", F.round("value", 4).alias("value"))
    t = rank_tests.group_value_table(rows, ["scope", "region"], "class", C.CLASSES, "value")
    m = rank_tests.mann_whitney_pairs(t, ["scope", "region"], C.CLASSES, ["scope"]).filter(F.col("U").isNotNull())
    return m.select("scope", "region", "comparison", F.round("VDA_folded", 6).alias("vda_folded"), F.round("rank_biserial", 6).alias("rank_biserial"))


_COMPARISONS = [f"{a}v{b}" for a, b in combinations(C.CLASSES, 2)]
_MATRICES = {"p": "p", "VDA_folded": "greatest(vda, 1 - vda)", "rank_biserial": "2 * vda - 1"}


@query("q02_box_matrix", _H + """
    SELECT strategy, region, """ + ", ".join(f"""round(max({x}) FILTER (comparison = '{c}'), 6) AS "{name}_{c}\"""" for name, x in _MATRICES.items() for c in _COMPARISONS) + """
    FROM mw GROUP BY strategy, region""", ("splong", "regions"))
def box_matrix(spark, sf):
    w = consensus.widen(pair_tables(spark, sf), ["strategy", "region"], _COMPARISONS, list(_MATRICES), strategy="comparison")
    return rounded(w, *[f"{c}_{s}" for c in _MATRICES for s in _COMPARISONS])


_KC = _H + """
    , kc AS (SELECT region, max(p_fdr) FILTER (strategy = 1) AS p1, max(p_fdr) FILTER (strategy = 2) AS p2, max(p_fdr) FILTER (strategy = 3) AS p3, max(p_fdr) AS worst,
        min(eps) AS e_min, quantile_cont(eps, 0.5) AS e_med FROM kw GROUP BY region),
    pc AS (SELECT region, comparison, max(p_fdr) AS worst, min(2 * vda - 1) AS lo, max(2 * vda - 1) AS hi, min(abs(2 * vda - 1)) AS weakest, quantile_cont(2 * vda - 1, 0.5) AS med FROM mw GROUP BY region, comparison)"""
_STAR = "CASE WHEN {c} THEN CASE WHEN {p} < 0.001 THEN '***' WHEN {p} < 0.01 THEN '**' WHEN {p} < 0.05 THEN '*' ELSE '' END ELSE '' END"
# the stand-in scores carry little signal, so consensus is read at a wide level
ALPHA = 0.9


@query("a44_kruskal_consensus", _KC + f"""
    SELECT region, true AS kw_all_available, worst < {ALPHA} AS kw_all_significant, round(worst, 6) AS kw_p_worst, round(-log10(worst), 5) AS kw_neg_log10_worst_p,
      {_STAR.format(c=f'worst < {ALPHA}', p='worst')} AS kw_consensus_star, round(e_min, 6) AS kw_epsilon_min, round(e_med, 6) AS kw_epsilon_median,
      round(p1, 6) AS kw_p_1, round(p2, 6) AS kw_p_2, round(p3, 6) AS kw_p_3 FROM kc""", ("splong", "regions"))
def kruskal_consensus(spark, sf):
    c = consensus.kruskal_consensus(kruskal_tables(spark, sf), IDS, ALPHA)
    c = c.select("region", "kw_all_available", "kw_all_significant", "kw_p_worst", F.round("kw_neg_log10_worst_p", 5).alias("kw_neg_log10_worst_p"),
                 "kw_consensus_star", "kw_epsilon_min", "kw_epsilon_median", *[f"kw_p_{s}" for s in IDS])
    return rounded(c, "kw_p_worst", "kw_epsilon_min", "kw_epsilon_median", *[f"kw_p_{s}" for s in IDS])


@query("a45_pairwise_consensus", _KC + f"""
    SELECT pc.region, comparison, kc.worst < {ALPHA} AS kw_all_significant, pc.worst < {ALPHA} AS pair_all_significant, round(pc.worst, 6) AS pair_p_worst, (lo > 0 OR hi < 0) AS sign_concordant,
      (pc.worst < {ALPHA} AND kc.worst < {ALPHA}) AS pair_pvalue_consensus_pass, (pc.worst < {ALPHA} AND kc.worst < {ALPHA} AND (lo > 0 OR hi < 0)) AS pair_effect_consensus_pass,
      {_STAR.format(c=f'pc.worst < {ALPHA} AND kc.worst < {ALPHA}', p='pc.worst')} AS pair_consensus_star, round(weakest, 6) AS pair_effect_min_abs, round(med, 6) AS pair_effect_median,
      round(CASE WHEN lo > 0 THEN weakest WHEN hi < 0 THEN -weakest END, 6) AS pair_effect_worst_signed FROM pc JOIN kc USING (region)""", ("splong", "regions"))
def pairwise_consensus(spark, sf):
    t = value_table(spark, sf)
    kw = consensus.kruskal_consensus(rank_tests.region_kruskal(t, ["strategy", "region"], C.CLASSES, ["strategy"]), IDS, ALPHA)
    c = consensus.pairwise_consensus(rank_tests.mann_whitney_pairs(t, ["strategy", "region"], C.CLASSES, ["strategy"]), kw, IDS, ALPHA)
    c = c.select("region", "comparison", "kw_all_significant", "pair_all_significant", "pair_p_worst", "sign_concordant", "pair_pvalue_consensus_pass",
                 "pair_effect_consensus_pass", "pair_consensus_star", "pair_effect_min_abs", "pair_effect_median", "pair_effect_worst_signed")
    return rounded(c, "pair_p_worst", "pair_effect_min_abs", "pair_effect_median", "pair_effect_worst_signed")


@query("f10_star_consistency", _H + """
    SELECT 'kruskal' AS part, count(DISTINCT region) AS n_checked, 0::BIGINT AS n_mismatches FROM kw
    UNION ALL SELECT 'pairwise', count(DISTINCT region || comparison), 0 FROM mw""", ("splong", "regions"))
def star_consistency(spark, sf):
    t = value_table(spark, sf)
    kw = consensus.kruskal_consensus(rank_tests.region_kruskal(t, ["strategy", "region"], C.CLASSES, ["strategy"]), IDS, ALPHA)
    pc = consensus.pairwise_consensus(rank_tests.mann_whitney_pairs(t, ["strategy", "region"], C.CLASSES, ["strategy"]), kw, IDS, ALPHA)
    rows = consensus.star_checks(kw, pc)
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(F.col("star") != F.col("expected")).alias("n_mismatches"))


@query("a46_readable_consensus", _KC + f"""
    SELECT region AS "Region", round(p1, 6) AS "Corrected p-value (1)", round(worst, 6) AS "Worst corrected p-value", CASE WHEN worst < {ALPHA} THEN 'yes' ELSE 'no' END AS "Consensus significant",
      {_STAR.format(c=f'worst < {ALPHA}', p='worst')} AS "Consensus significance" FROM kc""", ("splong", "regions"))
def readable_consensus(spark, sf):
    c = consensus.kruskal_consensus(kruskal_tables(spark, sf), IDS, ALPHA)
    c = rounded(c, "kw_p_1", "kw_p_worst")
    return consensus.readable(c, {"region": "Region", "kw_p_1": "Corrected p-value (1)", "kw_p_worst": "Worst corrected p-value",
                                  "kw_all_significant": "Consensus significant", "kw_consensus_star": "Consensus significance"}, ["kw_all_significant"])


@query("a46_sample_counts", _RL + " SELECT strategy, region, class, count(*) AS n_samples FROM rl GROUP BY ALL", ("splong", "regions"))
def sample_counts(spark, sf):
    return consensus.sample_counts(region_long(spark, sf), "strategy", "region", "class")


@query("j10_strategy_merge", _H + """
    , w AS (SELECT region, comparison, max(p) FILTER (strategy = 1) AS p1, max(p) FILTER (strategy = 3) AS p3, max(vda) FILTER (strategy = 2) AS v2 FROM mw WHERE NOT (strategy = 3 AND region = 'E') GROUP BY ALL)
    SELECT region, comparison, round(p1, 6) AS p_1, round(p3, 6) AS p_3, round(v2, 6) AS "VDA_2", region_order FROM w JOIN (SELECT region, region_order FROM regions) USING (region)""", ("splong", "regions"))
def strategy_merge(spark, sf):
    m = pair_tables(spark, sf).filter(~((F.col("strategy") == 3) & (F.col("region") == "E")))
    w = consensus.widen(m, ["region", "comparison"], IDS, ["p", "VDA"])
    from strainlens.functions.text import region_order
    return rounded(w.select("region", "comparison", "p_1", "p_3", "VDA_2", region_order(F.col("region")).alias("region_order")), "p_1", "p_3", "VDA_2")


@query("o01_category_order", """
    SELECT region, class, n, row_number() OVER (ORDER BY region_order, class) AS place FROM (SELECT region, region_order, 'DENV' || (class + 1) AS class, count(*) AS n
      FROM prof, regions GROUP BY ALL)""", ("prof", "regions"))
def category_order(spark, sf):
    from pyspark.sql import Window
    from strainlens.functions.text import class_order, region_order
    p = profiles.region_values(prof(spark, sf), ["class"], views.region_array(), how="sum")
    n = p.groupBy("region", named_class().alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return n.select("region", "class", "n", F.row_number().over(Window.orderBy(region_order(F.col("region")), class_order(F.col("class")))).alias("place"))


_SM = _CP + ", s AS (SELECT class, pos, v, avg(v) OVER (PARTITION BY class ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS sm FROM c)"


@query("w02_smoothing", _SM + """
    SELECT class, pos, round(sm, 6) AS smoothed, round((sm - min(sm) OVER (PARTITION BY class)) / (max(sm) OVER (PARTITION BY class) - min(sm) OVER (PARTITION BY class)), 6) AS rescaled FROM s""", ("plong",))
def smoothing(spark, sf):
    p = profiles.class_profile(prof(spark, sf), ["class"])
    p = p.withColumn("smoothed", windows.smooth(p, ["class"], "pos", "value", 10))
    p = profiles.scale_profile(p, ["class"], "smoothed", "class", "rescaled")
    return rounded(p.select("class", F.col("pos").cast("bigint").alias("pos"), "smoothed", "rescaled"), "smoothed", "rescaled")


@query("w12_last_finite", """
    WITH c AS (SELECT class, pos, count(*) FILTER (valid AND sample % 8 >= class) AS n FROM plong GROUP BY class, pos)
    SELECT class, coalesce(max(pos + 1) FILTER (n > 0), 0) AS length, least((SELECT min(l) FROM (SELECT max(pos + 1) FILTER (n > 0) AS l FROM c GROUP BY class)), 64) AS cut FROM c GROUP BY class""", ("plong",))
def last_finite(spark, sf):
    p = prof(spark, sf).withColumn("valid", F.when(F.col("sample") % 8 >= F.col("class"), F.col("valid")).otherwise(F.transform("valid", lambda v: F.lit(False))))
    n = profiles.last_finite(profiles.class_profile(p, ["class"]), ["class"])
    return n.withColumn("cut", profiles.common_cut(n, views.WIDTH).scalar())


@query("w13_robust_limits", """
    WITH r AS (SELECT region, avg(score) AS v FROM plong JOIN regions ON pos >= "start" AND pos < "end" GROUP BY sample, region),
    q AS (SELECT region, quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM r GROUP BY region)
    SELECT region, round(lo - (hi - lo) * 0.12, 6) AS low, round(hi + (hi - lo) * 0.12, 6) AS high FROM q""", ("plong", "regions"))
def robust_limits(spark, sf):
    r = profiles.region_values(prof(spark, sf), ["sample"], views.region_array())
    return rounded(profiles.robust_limits(r, ["region"], "value"), "low", "high")


@query("q03_profile_run", """
    WITH z AS (SELECT sample, class, fold, pos, valid, CASE WHEN valid THEN abs(score) / sum(CASE WHEN valid THEN abs(score) ELSE 0 END) OVER (PARTITION BY sample) END AS v FROM plong),
    x AS (SELECT unnest(['dataset', 'fold ' || fold]) AS scope, class, pos, v FROM z),
    y AS (SELECT scope, unnest(['DENV-' || (class + 1), 'Overall']) AS profile, pos, v FROM x),
    m AS (SELECT scope, profile, pos, avg(v) AS value FROM y GROUP BY ALL),
    s AS (SELECT *, (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w) AS scaled,
        avg(value) OVER (PARTITION BY scope, profile ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS smoothed FROM m WINDOW w AS (PARTITION BY scope, profile))
    SELECT scope, profile, pos, round(value, 6) AS value, round(scaled, 6) AS scaled, round(smoothed, 6) AS smoothed FROM s""", ("plong",))
def profile_run(spark, sf):
    from strainlens.plans.profile_run import profile_tables
    out = profile_tables(prof(spark, sf), "abs_sum1", 11)
    return rounded(out, "value", "scaled", "smoothed")


@query("q04_overall_panel", """
    WITH a AS (SELECT pos, avg(score) FILTER (valid) AS v FROM plong GROUP BY pos),
    t AS (SELECT sample, sum(CASE WHEN valid THEN abs(score) ELSE 0 END) AS s FROM plong GROUP BY sample),
    g AS (SELECT pos, avg(CASE WHEN valid THEN abs(score) / s END) AS v FROM plong JOIN t USING (sample) GROUP BY pos),
    u AS (SELECT 'attention' AS signal, pos, v FROM a UNION ALL SELECT 'gradient', pos, v FROM g),
    s AS (SELECT signal, pos, avg(v) OVER (PARTITION BY signal ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM u)
    SELECT signal, pos, round(z, 6) AS value FROM (SELECT signal, pos, (v - min(v) OVER (PARTITION BY signal)) / (max(v) OVER (PARTITION BY signal) - min(v) OVER (PARTITION BY signal)) AS z FROM s)""", ("plong",))
def overall_panel(spark, sf):
    from strainlens.plans.profile_run import overall_panel as panel
    p = prof(spark, sf)
    return rounded(panel(p, p, 11, views.WIDTH), "value")


# the gradient signal is a profile of its own: every score weighted by its record and position
@query("q04_class_panels", """
    WITH x AS (SELECT strategy, class, sample, pos, valid, score, score * (1 + (sample + pos) % 3) AS grad FROM splong),
    a AS (SELECT strategy, class, pos, avg(score) FILTER (valid) AS v FROM x GROUP BY ALL),
    t AS (SELECT strategy, sample, sum(CASE WHEN valid THEN abs(grad) ELSE 0 END) AS s FROM x GROUP BY ALL),
    g AS (SELECT x.strategy, class, pos, avg(CASE WHEN valid THEN abs(grad) / s END) AS v FROM x JOIN t ON t.strategy = x.strategy AND t.sample = x.sample GROUP BY ALL),
    u AS (SELECT 'attention' AS signal, * FROM a UNION ALL SELECT 'gradient', * FROM g),
    s AS (SELECT signal, strategy, class, pos, avg(v) OVER (PARTITION BY signal, strategy, class ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS v FROM u)
    SELECT strategy, class, signal, pos, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS value FROM s WINDOW w AS (PARTITION BY signal, strategy, class)""", ("splong",))
def class_panels(spark, sf):
    from strainlens.plans.profile_run import overall_panel as panel
    p = prof(spark, sf)
    p = p.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in views.STRATEGIES]))).filter(F.col("sample") % 3 != F.col("strategy") - 1)
    weighted = p.withColumn("scores", F.transform("scores", lambda v, i: v * (1 + (F.col("sample") + i) % 3)))
    return rounded(panel(p, weighted, 11, views.WIDTH, ["strategy", "class"]), "value")


@query("a52_attention_reduction", """
    WITH w AS (SELECT sample, pos // 16 AS chunk, pos % 16 AS key, h, q, abs(score) * (1 + h + q) AS weight FROM plong, (SELECT unnest([0, 1]) AS h), (SELECT unnest([0, 1, 2]) AS q))
    SELECT sample, chunk * 16 + key AS pos, round(avg(weight) FILTER (q = 0), 6) AS cls, round(avg(weight), 6) AS mean_query FROM w GROUP BY ALL""", ("plong",))
def attention_reduction(spark, sf):
    w = attention_weights(spark, sf)
    a = profiles.reduce_attention(w, 1, 16, "cls", views.WIDTH).withColumnRenamed("score", "cls")
    b = profiles.reduce_attention(w, 1, 16, "mean_query", views.WIDTH).withColumnRenamed("score", "mean_query")
    return rounded(a.join(b, ["sample", "pos"]), "cls", "mean_query")


def attention_weights(spark, sf):
    p = prof(spark, sf).select("sample", F.posexplode("scores").alias("p", "s"))
    grid = F.explode(F.array(*[F.struct(F.lit(x).alias("layer"), F.lit(h).alias("head"), F.lit(q).alias("query")) for x in (0, 1) for h in (0, 1) for q in (0, 1, 2)]))
    w = p.select("sample", "p", "s", grid.alias("g")).select("sample", "g.*", F.expr("p div 16").alias("chunk"), (F.col("p") % 16).cast("bigint").alias("key"),
                                                             (F.abs("s") * (1 + F.col("g.head") + F.col("g.query")) + F.when(F.col("g.layer") == 0, 5).otherwise(0)).alias("weight"))
    return w


@query("a52_genome_intervals", """
    SELECT sample, pos, 'chr' || (pos // 32) AS chrom, pos * 3 AS "start", pos * 3 + 3 AS "end", round(abs(score) * 1.5, 6) AS score FROM plong""", ("plong",))
def genome_intervals(spark, sf):
    s = profiles.reduce_attention(attention_weights(spark, sf), 1, 16, "cls")
    # token map with one row per position of the profile
    tokens = prof(spark, sf).select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.size("scores").cast("bigint") - 1)).alias("pos")).distinct()
    tokens = tokens.select("pos", F.concat(F.lit("chr"), F.expr("pos div 32")).alias("chrom"), (F.col("pos") * 3).alias("start"), (F.col("pos") * 3 + 3).alias("end"))
    return rounded(profiles.genome_intervals(s, tokens), "score")


@query("a53_gradient_input", """
    SELECT sample, pos, round(score, 6) AS signed, round(abs(score), 6) AS abs, round(greatest(score, 0), 6) AS positive FROM plong""", ("plong",))
def gradient_input(spark, sf):
    p = prof(spark, sf)
    x = F.transform("scores", lambda v, i: F.array(*[F.when(i % 4 == c, 1.0).otherwise(0.0) for c in range(4)]))
    g = F.transform("scores", lambda v: F.array(v, v, v, v))
    w = p.select("sample", x.alias("x"), g.alias("g"))
    w = w.select("sample", *[profiles.gradient_times_input(F.col("g"), F.col("x"), m).alias(m) for m in ("signed", "abs", "positive")])
    out = w.select("sample", F.posexplode(F.arrays_zip("signed", "abs", "positive")).alias("pos", "z")).select("sample", F.col("pos").cast("bigint").alias("pos"), "z.*")
    return rounded(out, "signed", "abs", "positive")


@query("a55_projection_points", """
    WITH b AS (SELECT sample, class AS label, fold, scores[1] AS x, scores[2] AS y FROM prof),
    p AS (SELECT *, min(x) OVER w AS x0, max(x) OVER w AS x1, min(y) OVER w AS y0, max(y) OVER w AS y1 FROM b WINDOW w AS (PARTITION BY fold))
    SELECT sample, label, CASE WHEN fold IN (3, 4) THEN 'combined' ELSE CAST(fold AS VARCHAR) END AS entry, fold AS part,
      round(0.06 + (x - x0) / (x1 - x0) * 0.88, 6) AS x, round(0.06 + (y - y0) / (y1 - y0) * 0.88, 6) AS y FROM p""", ("prof",))
def projection_points(spark, sf):
    p = prof(spark, sf).select("sample", F.col("class").alias("label"), F.col("fold").alias("part"), F.get("scores", F.lit(0)).alias("x"), F.get("scores", F.lit(1)).alias("y"))
    p = p.withColumn("entry", F.when(F.col("part").isin(3, 4), "combined").otherwise(F.col("part").cast("string")))
    return rounded(profiles.scale_to_unit(p, ["part"], ["x", "y"]).select("sample", "label", "entry", "part", "x", "y"), "x", "y")
