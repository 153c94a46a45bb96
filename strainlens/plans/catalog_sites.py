"""Alignment variability: columns, class pairs, regions, maps, identities."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens.operators import checks, sites, windows
from strainlens.plans import views
from strainlens.plans.catalog_metrics import rounded
from strainlens.plans.registry import query

# Count, metric, pair and roll-up tables in SQL.
_CT = """
    WITH ct0 AS (SELECT region, class, site_pos AS pos, count(*) AS n, count(*) FILTER (symbol = 'A') AS a, count(*) FILTER (symbol = 'C') AS c, count(*) FILTER (symbol = 'G') AS g,
        count(*) FILTER (symbol = 'T') AS t, count(*) FILTER (symbol = '-') AS gap FROM site GROUP BY ALL),
    ct AS (SELECT *, a + c + g + t AS valid, n - (a + c + g + t) - gap AS unk FROM (SELECT * FROM ct0 UNION ALL
        SELECT region, 'GLOBAL', pos, sum(n), sum(a), sum(c), sum(g), sum(t), sum(gap) FROM ct0 GROUP BY region, pos)),
    pm AS (SELECT *, CASE WHEN valid > 0 THEN a / valid ELSE 0 END AS pa, CASE WHEN valid > 0 THEN c / valid ELSE 0 END AS pc, CASE WHEN valid > 0 THEN g / valid ELSE 0 END AS pg,
        CASE WHEN valid > 0 THEN t / valid ELSE 0 END AS pt, valid / n AS vf, gap / n AS gf, unk / n AS uf FROM ct),
    mt AS (SELECT *, h / 2 AS hn, 1 - h / 2 AS cons, pa * pa + pc * pc + pg * pg + pt * pt AS sim,
        CASE WHEN valid = 0 THEN '' WHEN a = greatest(a, c, g, t) THEN 'A' WHEN c = greatest(a, c, g, t) THEN 'C' WHEN g = greatest(a, c, g, t) THEN 'G' ELSE 'T' END AS top,
        CASE WHEN valid > 0 THEN greatest(a, c, g, t) / valid ELSE 0 END AS topf FROM (SELECT *, abs(
        CASE WHEN pa > 0 THEN pa * log2(pa) ELSE 0 END + CASE WHEN pc > 0 THEN pc * log2(pc) ELSE 0 END + CASE WHEN pg > 0 THEN pg * log2(pg) ELSE 0 END + CASE WHEN pt > 0 THEN pt * log2(pt) ELSE 0 END) AS h FROM pm)),
    pr AS (SELECT x.region, x.pos, x.class || 'v' || y.class AS pair, x.class AS class_a, y.class AS class_b, least(x.pa, y.pa) + least(x.pc, y.pc) + least(x.pg, y.pg) + least(x.pt, y.pt) AS ov,
        0.5 * (""" + " + ".join(f"CASE WHEN x.p{s} > 0 THEN x.p{s} * log2(x.p{s} / (0.5 * (x.p{s} + y.p{s}))) ELSE 0 END + CASE WHEN y.p{s} > 0 THEN y.p{s} * log2(y.p{s} / (0.5 * (x.p{s} + y.p{s}))) ELSE 0 END" for s in "acgt") + """) AS jsd,
        CASE WHEN x.sim * y.sim > 0 THEN (x.pa * y.pa + x.pc * y.pc + x.pg * y.pg + x.pt * y.pt) / (sqrt(x.sim) * sqrt(y.sim)) END AS cosine, least(x.vf, y.vf) AS mv, abs(x.gf - y.gf) AS gd
        FROM mt x JOIN mt y ON x.region = y.region AND x.pos = y.pos AND x.class < y.class WHERE x.class <> 'GLOBAL' AND y.class <> 'GLOBAL'),
    ru AS (SELECT *, jm * (1 - ggap) AS spec, emax - emin AS erange FROM (SELECT region, pos, max(hn) FILTER (class = 'GLOBAL') AS gh, max(cons) FILTER (class = 'GLOBAL') AS gc, max(gf) FILTER (class = 'GLOBAL') AS ggap,
        avg(hn) FILTER (class <> 'GLOBAL') AS em, max(hn) FILTER (class <> 'GLOBAL') AS emax, min(hn) FILTER (class <> 'GLOBAL') AS emin, avg(sim) FILTER (class <> 'GLOBAL') AS sm, avg(gf) FILTER (class <> 'GLOBAL') AS gm FROM mt GROUP BY region, pos)
        JOIN (SELECT region, pos, avg(jsd) AS jm, max(jsd) AS jx, avg(ov) AS om FROM pr GROUP BY region, pos) USING (region, pos))"""
V = ("site",)


def named_bounds(rows, scale):
    """struct(start, end) of the row's region, 1-based and closed."""
    out = F.lit(None)
    for name, _, s, e in reversed(rows):
        out = F.when(F.col("region") == name, F.struct(F.lit(s * scale + 1).alias("start"), F.lit(e * scale).alias("end"))).otherwise(out)
    return out


A = views.aligned


def metrics_of(spark, sf):
    return sites.column_metrics(sites.column_counts(A(spark, sf)))


def rollup_of(m):
    return sites.column_rollup(m, sites.pair_divergence(m))


@query("f04_aligned_length", "SELECT region, 1::BIGINT AS n_lengths, min(length(aligned)) AS min_length, max(length(aligned)) AS max_length, count(*) AS n_records, 'PASS' AS status FROM aligned GROUP BY region", ("aligned",))
def aligned_length(spark, sf):
    return checks.alignment_status(A(spark, sf), "aligned", ["region"])


@query("f04_length_histogram", "SELECT class, length(sequence) AS length, count(*) AS n FROM seq GROUP BY ALL", ("seq",))
def length_histogram(spark, sf):
    return checks.length_histogram(views.sequences(spark, sf), "sequence", ["class"])


@query("a22_column_counts", _CT + """
    SELECT region, class, pos, CAST(n AS BIGINT) AS n_sequences, CAST(a AS BIGINT) AS "s_A", CAST(c AS BIGINT) AS "s_C", CAST(g AS BIGINT) AS "s_G", CAST(t AS BIGINT) AS "s_T",
      CAST(gap AS BIGINT) AS gap_count, CAST(valid AS BIGINT) AS valid_count, CAST(unk AS BIGINT) AS unknown_count FROM ct""", V)
def column_counts(spark, sf):
    return sites.column_counts(A(spark, sf))


@query("a23_column_metrics", _CT + """
    SELECT region, class, pos, round(vf, 6) AS valid_fraction, round(gf, 6) AS gap_fraction, round(uf, 6) AS unknown_fraction, round(h, 6) AS entropy_bits, round(hn, 6) AS entropy_norm, round(cons, 6) AS conservation_norm,
      round(sim, 6) AS intra_similarity, top AS consensus, round(topf, 6) AS consensus_fraction, round(pow(2, h), 6) AS effective_symbols FROM mt""", V)
def column_metrics(spark, sf):
    cols = ["valid_fraction", "gap_fraction", "unknown_fraction", "entropy_bits", "entropy_norm", "conservation_norm", "intra_similarity", "consensus_fraction", "effective_symbols"]
    return rounded(metrics_of(spark, sf).select("region", "class", "pos", "consensus", *cols), *cols)


@query("a24_reference_columns", """
    WITH r AS (SELECT region, seq_id, site_pos AS pos, symbol, sum((symbol <> '-')::INTEGER) OVER (PARTITION BY region, seq_id ORDER BY site_pos) AS u FROM site WHERE seq_id IN (1, 2, 3)),
    k AS (SELECT region, pos, count(*) AS n, count(*) FILTER (symbol = '-') AS gap, count(*) FILTER (symbol = 'A') AS a, count(*) FILTER (symbol = 'C') AS c, count(*) FILTER (symbol = 'G') AS g, count(*) FILTER (symbol = 'T') AS t,
      max(symbol) FILTER (seq_id = 1) AS ref_1_base, max(symbol) FILTER (seq_id = 2) AS ref_2_base, max(CAST(u AS INTEGER)) FILTER (seq_id = 1 AND symbol <> '-') AS ref_1_ungapped_pos,
      max(CAST(u AS INTEGER)) FILTER (seq_id = 2 AND symbol <> '-') AS ref_2_ungapped_pos FROM r GROUP BY region, pos),
    p AS (SELECT *, a + c + g + t AS v FROM k)
    SELECT region, pos, round(CASE WHEN v = 0 THEN 0 ELSE abs(""" + " + ".join(f"CASE WHEN {s} > 0 THEN {s} / v * log2({s} / v) ELSE 0 END" for s in "acgt") + """) END, 6) AS entropy,
      round(CASE WHEN v = 0 THEN 0 ELSE greatest(a, c, g, t) / v END, 6) AS consensus_similarity, CASE WHEN (a > 0)::INTEGER + (c > 0)::INTEGER + (g > 0)::INTEGER + (t > 0)::INTEGER > 1 THEN 1 ELSE 0 END AS variable_site,
      round(gap / n, 6) AS gap_fraction, ref_1_base, ref_2_base, ref_1_ungapped_pos, ref_2_ungapped_pos FROM p""", V)
def reference_columns(spark, sf):
    a = A(spark, sf).withColumn("name", F.concat(F.lit("ref_"), "seq_id"))
    out = sites.reference_columns(a, ["ref_1", "ref_2", "ref_3"], "name").drop("ref_3_base", "ref_3_ungapped_pos")
    return rounded(out, "entropy", "consensus_similarity", "gap_fraction")


_POP = _CT + """
    , po AS (SELECT region, pos, max(h) FILTER (class = 'GLOBAL') AS gh, max(topf) FILTER (class = 'GLOBAL') AS gs, max(((a > 0)::INTEGER + (c > 0)::INTEGER + (g > 0)::INTEGER + (t > 0)::INTEGER > 1)::INTEGER) FILTER (class = 'GLOBAL') AS gv,
        max(gf) FILTER (class = 'GLOBAL') AS gg, max(n) FILTER (class = 'GLOBAL') AS n, sum(h) FILTER (class <> 'GLOBAL') / 4 AS wh, sum(topf) FILTER (class <> 'GLOBAL') / 4 AS ws,
        sum(((a > 0)::INTEGER + (c > 0)::INTEGER + (g > 0)::INTEGER + (t > 0)::INTEGER > 1)::INTEGER) FILTER (class <> 'GLOBAL') / 4 AS wv, max(nullif(top, '')) FILTER (class = 'DENV1') AS b1, max(topf) FILTER (class = 'DENV1' AND valid > 0) AS f1 FROM mt GROUP BY region, pos)"""


@query("a25_population_columns", _POP + """
    SELECT region, pos, CAST(n AS BIGINT) AS n_sequences, round(gh, 6) AS global_entropy, round(gs, 6) AS global_consensus_similarity, gv AS global_variable_site, round(gg, 6) AS gap_fraction, round(wh, 6) AS within_entropy_mean,
      round(ws, 6) AS within_similarity_mean, round(wv, 6) AS within_variable_mean, round(gh - wh, 6) AS informativeness, b1 AS "DENV1_major_base", round(f1, 6) AS "DENV1_major_freq" FROM po""", V)
def population_columns(spark, sf):
    p = sites.population_columns(sites.column_counts(A(spark, sf), with_global=False))
    cols = ["global_entropy", "global_consensus_similarity", "gap_fraction", "within_entropy_mean", "within_similarity_mean", "within_variable_mean", "informativeness", "DENV1_major_freq"]
    return rounded(p.select("region", "pos", "n_sequences", "global_variable_site", "DENV1_major_base", *cols), *cols)


@query("a26_pair_divergence", _CT + """
    SELECT region, pos, pair, class_a, class_b, round(ov, 6) AS distribution_overlap, round(jsd, 6) AS jsd, round(cosine, 6) AS cosine_similarity, round(mv, 6) AS min_valid_fraction,
      round(gd, 6) AS gap_fraction_absdiff, round(ov * mv, 6) AS coverage_weighted_overlap FROM pr""", V)
def pair_divergence(spark, sf):
    out = sites.pair_divergence(metrics_of(spark, sf))
    return rounded(out, "distribution_overlap", "jsd", "cosine_similarity", "min_valid_fraction", "gap_fraction_absdiff", "coverage_weighted_overlap")


@query("a27_column_rollup", _CT + """
    SELECT region, pos, round(gh, 6) AS global_entropy_norm, round(gc, 6) AS global_conservation_norm, round(ggap, 6) AS global_gap_fraction, round(em, 6) AS class_entropy_mean, round(emax, 6) AS class_entropy_max,
      round(emin, 6) AS class_entropy_min, round(erange, 6) AS class_entropy_range, round(sm, 6) AS intra_similarity_mean, round(gm, 6) AS gap_fraction_mean, round(jm, 6) AS pairwise_jsd_mean, round(jx, 6) AS pairwise_jsd_max,
      round(om, 6) AS pairwise_overlap_mean, round(spec, 6) AS specificity FROM ru""", V)
def column_rollup(spark, sf):
    r = rollup_of(metrics_of(spark, sf))
    return rounded(r, *[c for c in r.columns if c not in ("region", "pos")])


@query("a28_class_summary", _CT + """
    SELECT region, class, CAST(max(n) AS BIGINT) AS n_sequences, round(avg(hn), 6) AS mean_entropy_norm, round(quantile_cont(hn, 0.5), 6) AS median_entropy_norm, round(avg(cons), 6) AS mean_conservation_norm,
      round(avg(sim), 6) AS mean_intra_similarity, round(avg(gf), 6) AS mean_gap_fraction FROM mt WHERE class <> 'GLOBAL' GROUP BY region, class""", V)
def class_summary(spark, sf):
    s = sites.class_summary(metrics_of(spark, sf))
    return rounded(s, *[c for c in s.columns if c.startswith(("mean", "median"))])


@query("a28_pair_summary", _CT + """
    SELECT region, pair, class_a, class_b, round(avg(ov), 6) AS mean_distribution_overlap, round(quantile_cont(ov, 0.5), 6) AS median_distribution_overlap, round(avg(jsd), 6) AS mean_jsd, round(quantile_cont(jsd, 0.5), 6) AS median_jsd,
      round(avg(cosine), 6) AS mean_cosine, round(avg(ov * mv), 6) AS mean_coverage_weighted_overlap, round(avg(gd), 6) AS mean_gap_fraction_absdiff FROM pr GROUP BY ALL""", V)
def pair_summary(spark, sf):
    s = sites.pair_summary(sites.pair_divergence(metrics_of(spark, sf)))
    return rounded(s, *[c for c in s.columns if c.startswith(("mean", "median"))])


_ID = """
    , sp AS (SELECT seq_id, class, region, site_pos, symbol FROM site WHERE symbol IN ('A', 'C', 'G', 'T')),
    pw AS (SELECT x.region, x.class AS class_a, y.class AS class_b, avg((x.symbol = y.symbol)::INTEGER) AS id FROM sp x JOIN sp y ON x.region = y.region AND x.site_pos = y.site_pos
        AND (x.class < y.class OR (x.class = y.class AND x.seq_id < y.seq_id)) GROUP BY x.region, x.class, y.class, x.seq_id, y.seq_id),
    pi AS (SELECT region, CASE WHEN class_a = class_b THEN 'within' ELSE 'between' END AS comparison_type, CASE WHEN class_a = class_b THEN class_a ELSE class_a || '_vs_' || class_b END AS comparison,
        avg(id) AS identity, min(id) AS lo FROM pw GROUP BY region, class_a, class_b)"""


_POOLED = """
    , sp AS (SELECT seq_id, class, region, site_pos, symbol FROM site WHERE symbol IN ('A', 'C', 'G', 'T')),
    pi AS (SELECT x.region, CASE WHEN x.class = y.class THEN 'within' ELSE 'between' END AS comparison_type, avg((x.symbol = y.symbol)::INTEGER) AS identity FROM sp x JOIN sp y ON x.region = y.region
        AND x.site_pos = y.site_pos AND (x.class < y.class OR (x.class = y.class AND x.seq_id < y.seq_id)) GROUP BY x.region, x.class, y.class)"""


@query("a29_population_regions", _POP + _POOLED + """
    SELECT region, count(*) AS alignment_length, round(avg(gh), 6) AS mean_global_entropy, round(avg(wh), 6) AS mean_within_entropy, round(max(gh - wh), 6) AS max_informativeness, CAST(sum(gv) AS BIGINT) AS global_variable_sites,
      round(avg(gg), 6) AS mean_gap_fraction, round(sum(gv) / count(*), 6) AS global_variable_site_fraction, round(max(w), 6) AS mean_within_identity, round(max(b), 6) AS mean_between_identity, round(max(w) - max(b), 6) AS identity_gap
    FROM po JOIN (SELECT region, avg(identity) FILTER (comparison_type = 'within') AS w, avg(identity) FILTER (comparison_type = 'between') AS b FROM pi GROUP BY region) USING (region) GROUP BY region""", V)
def population_regions(spark, sf):
    a = A(spark, sf)
    counts = sites.column_counts(a, with_global=False)
    out = sites.population_regions(sites.population_columns(counts), sites.exact_identity(counts))
    cols = ["mean_global_entropy", "mean_within_entropy", "max_informativeness", "mean_gap_fraction", "global_variable_site_fraction", "mean_within_identity", "mean_between_identity", "identity_gap"]
    return rounded(out.select("region", "alignment_length", "global_variable_sites", *cols), *cols)


@query("a29_reference_regions", """
    WITH r AS (SELECT * FROM site WHERE seq_id IN (1, 2, 3)),
    k AS (SELECT region, site_pos AS pos, count(*) FILTER (symbol = '-') / count(*) AS gap, count(DISTINCT symbol) FILTER (symbol IN ('A', 'C', 'G', 'T')) AS d FROM r GROUP BY region, site_pos),
    i AS (SELECT x.region, avg((x.symbol = y.symbol)::INTEGER) AS id FROM r x JOIN r y ON x.region = y.region AND x.site_pos = y.site_pos AND x.seq_id < y.seq_id WHERE x.symbol <> '-' AND y.symbol <> '-' GROUP BY x.region, x.seq_id, y.seq_id)
    SELECT region, alignment_length, variable_sites, mean_gap_fraction, mean_pairwise_identity, min_pairwise_identity, max_pairwise_divergence FROM
      (SELECT region, count(*) AS alignment_length, count(*) FILTER (d > 1) AS variable_sites, round(avg(gap), 6) AS mean_gap_fraction FROM k GROUP BY region)
      JOIN (SELECT region, round(avg(id), 6) AS mean_pairwise_identity, round(min(id), 6) AS min_pairwise_identity, round(1 - min(id), 6) AS max_pairwise_divergence FROM i GROUP BY region) USING (region)""", V)
def reference_regions(spark, sf):
    a = A(spark, sf).filter(F.col("seq_id").isin(1, 2, 3)).withColumn("name", F.concat(F.lit("ref_"), "seq_id"))
    cols = sites.reference_columns(a, ["ref_1", "ref_2", "ref_3"], "name")
    ident = sites.reference_identities(a, ["ref_1", "ref_2", "ref_3"], "name")
    out = sites.region_divergence(cols, ident)
    f = ["mean_gap_fraction", "mean_pairwise_identity", "min_pairwise_identity", "max_pairwise_divergence"]
    return rounded(out.select("region", "alignment_length", "variable_sites", *f), *f)


@query("a30_region_recap", _CT + """
    SELECT region, round(avg(gh), 6) AS mean_global_entropy_norm, round(quantile_cont(gh, 0.5), 6) AS median_global_entropy_norm, round(avg(jm), 6) AS mean_pairwise_jsd_mean, round(quantile_cont(spec, 0.5), 6) AS median_specificity,
      round(avg((gh > 0.9)::INTEGER), 6) AS global_variable_site_fraction, count(*) AS n_alignment_positions FROM ru GROUP BY region""", V)
def region_recap(spark, sf):
    r = sites.region_recap(rollup_of(metrics_of(spark, sf)), 0.9)
    cols = ["mean_global_entropy_norm", "median_global_entropy_norm", "mean_pairwise_jsd_mean", "median_specificity", "global_variable_site_fraction"]
    return rounded(r.select("region", "n_alignment_positions", *cols), *cols)


@query("a31_class_versus_others", _CT + """
    , m AS (SELECT region, class_a, class_b, avg(jsd) AS j FROM pr GROUP BY ALL), x AS (SELECT region, class_a AS class, j FROM m UNION ALL SELECT region, class_b, j FROM m)
    SELECT class, """ + ", ".join(f"""round(avg(j) FILTER (region = '{r.replace("'", "''")}'), 6) AS "{r}\"""" for r in C.REGIONS) + " FROM x GROUP BY class", V)
def class_versus_others(spark, sf):
    s = sites.pair_summary(sites.pair_divergence(metrics_of(spark, sf)))
    return rounded(sites.class_versus_others(s, C.REGIONS), *C.REGIONS)


@query("a32_pairwise_identity_exact", """
    WITH sp AS (SELECT seq_id, class, region, site_pos, symbol FROM site WHERE symbol IN ('A', 'C', 'G', 'T'))
    SELECT x.region, CASE WHEN x.class = y.class THEN 'within' ELSE 'between' END AS comparison_type, CASE WHEN x.class = y.class THEN x.class ELSE x.class || '_vs_' || y.class END AS comparison,
      round(avg((x.symbol = y.symbol)::INTEGER), 6) AS identity FROM sp x JOIN sp y ON x.region = y.region AND x.site_pos = y.site_pos AND (x.class < y.class OR (x.class = y.class AND x.seq_id < y.seq_id)) GROUP BY x.region, x.class, y.class""", V)
def pairwise_identity_exact(spark, sf):
    return rounded(sites.exact_identity(sites.column_counts(A(spark, sf), with_global=False)), "identity")


@query("a32_pairwise_identity_sampled", "WITH " + _ID.strip()[1:] + " SELECT region, comparison_type, comparison, round(identity, 6) AS identity, round(lo, 6) AS min_identity FROM pi", V)
def pairwise_identity_sampled(spark, sf):
    return rounded(sites.sampled_identity(A(spark, sf), C.MAX_PAIRS).drop("n_pairs"), "identity", "min_identity")


@query("a33_genome_projection", _CT + """
    , b AS (SELECT region, "start" * 30 + 1 AS s, "end" * 30 AS e FROM regions), k AS (SELECT region, count(*) AS n FROM ru GROUP BY region),
    g AS (SELECT CAST(round_even(s + (pos - 1) * ((e - s) / (n - 1.0::DOUBLE)), 0) AS BIGINT) AS genome_pos, 1 - gh * 2 / 2 AS v FROM ru JOIN b USING (region) JOIN k USING (region))
    SELECT genome_pos, round(avg(v), 6) AS value FROM g GROUP BY genome_pos""", ("site", "regions"))
def genome_projection(spark, sf):
    r = rollup_of(metrics_of(spark, sf))
    v = sites.similarity_or_entropy(F.lit(None).cast("double"), F.col("global_entropy_norm") * 2)
    return rounded(sites.to_genome(r, v, named_bounds(views.region_rows(), 30)), "value")


@query("w01_rolling_mean", _CT + """
    SELECT region, pos, round(CASE WHEN count(gh) OVER w >= 1 THEN avg(gh) OVER w END, 6) AS rolled FROM ru WINDOW w AS (PARTITION BY region ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""", V)
def rolling_mean(spark, sf):
    r = rollup_of(metrics_of(spark, sf))
    return rounded(r.select("region", "pos", windows.rolling_mean(["region"], "pos", "global_entropy_norm", 3).alias("rolled")), "rolled")


@query("w06_position_table", """
    SELECT region, pos, CASE WHEN symbol <> '-' THEN CAST(u AS INTEGER) END AS ref_pos, symbol AS ref_symbol FROM (SELECT region, seq_id, site_pos AS pos, symbol, sum((symbol <> '-')::INTEGER) OVER (PARTITION BY region, seq_id ORDER BY site_pos) AS u,
      min(seq_id) OVER (PARTITION BY region) AS first_id FROM site WHERE class = 'DENV2') WHERE seq_id = first_id""", V)
def position_table(spark, sf):
    return sites.position_table(A(spark, sf), F.col("class") == "DENV2")


@query("w06_ungapped_counter", """
    SELECT region, seq_id, site_pos AS pos, CASE WHEN symbol <> '-' THEN sum((symbol <> '-')::INTEGER) OVER (PARTITION BY region, seq_id ORDER BY site_pos) END::BIGINT AS ungapped FROM site""", V)
def ungapped_counter(spark, sf):
    long = A(spark, sf).select("region", "seq_id", F.inline(sites.numbered_symbols(F.col("aligned"))))
    return long.select("region", "seq_id", "pos", F.col("ungapped").cast("bigint").alias("ungapped"))


def gapped_pairs(spark, sf):
    """Every region of a sequence beside its next region, as a gapped pair."""
    following = F.lead("aligned").over(Window.partitionBy("seq_id").orderBy("region_order"))
    pairs = A(spark, sf).select("region", "seq_id", F.col("aligned").alias("ref"), following.alias("target")).filter(F.col("target").isNotNull())
    # the last region is shorter by one column
    return pairs.withColumn("target", F.rpad("target", F.length("ref"), "-"))


PAIRED = ["region", "seq_id"]
_MAP = """
    WITH p AS (SELECT a.region, a.seq_id, a.site_pos AS pos, a.symbol AS rc, coalesce(b.symbol, '-') AS tc
      FROM site a LEFT JOIN site b ON a.seq_id = b.seq_id AND b.region_order = a.region_order + 1 AND a.site_pos = b.site_pos WHERE a.region_order < (SELECT max(region_order) FROM regions)),
    m AS (SELECT *, sum((rc <> '-')::INTEGER) OVER w AS ref_pos, sum((tc <> '-')::INTEGER) OVER w AS tp FROM p WINDOW w AS (PARTITION BY region, seq_id ORDER BY pos)),
    mp AS (SELECT region, seq_id, ref_pos, string_agg(replace(tc, '-', ''), '' ORDER BY pos) AS target_text, arg_min(tp, pos) FILTER (rc <> '-') AS target_pos FROM m WHERE ref_pos > 0 GROUP BY region, seq_id, ref_pos)"""


@query("w07_alignment_map", _MAP + " SELECT region, seq_id, CAST(ref_pos AS INTEGER) AS ref_pos, target_text, CAST(target_pos AS BIGINT) AS target_pos FROM mp", V)
def alignment_map(spark, sf):
    return sites.alignment_map(gapped_pairs(spark, sf), PAIRED)


@query("w07_region_text", _MAP + " SELECT region, seq_id, string_agg(target_text, '' ORDER BY ref_pos) AS region_text FROM mp WHERE ref_pos BETWEEN 2 AND 4 GROUP BY region, seq_id", V)
def region_text(spark, sf):
    texts = sites.mapped_texts(F.col("ref"), F.col("target"))
    g = gapped_pairs(spark, sf).select(*PAIRED, texts.alias("texts")).filter(F.size("texts") >= 2)
    return g.select(*PAIRED, sites.region_text(F.col("texts"), F.lit(2), F.lit(4)).alias("region_text"))


@query("j07_region_liftover", _MAP + """
    , r AS (SELECT * FROM (VALUES ('x', 1, 3), ('y', 4, 2), ('z', 2, 5)) v(name, s, e))
    SELECT a.region, a.seq_id, name, CAST(least(a.target_pos, b.target_pos) AS BIGINT) AS "start", CAST(greatest(a.target_pos, b.target_pos) AS BIGINT) AS "end", CAST(abs(a.target_pos - b.target_pos) + 1 AS BIGINT) AS length_nt
    FROM r JOIN mp a ON a.ref_pos = s JOIN mp b ON b.ref_pos = e AND a.seq_id = b.seq_id AND a.region = b.region""", V)
def region_liftover(spark, sf):
    from strainlens.operators.joins import lift_regions
    m = sites.alignment_map(gapped_pairs(spark, sf), PAIRED)
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s).alias("start"), F.lit(e).alias("end")) for n, s, e in (("x", 1, 3), ("y", 4, 2), ("z", 2, 5))])
    regions = gapped_pairs(spark, sf).select(*PAIRED, F.inline(rows))
    return lift_regions(regions, m, PAIRED)


_TXT = "string_agg(class || ':' || CASE WHEN top = '' THEN '?' ELSE top END || '(' || printf('%.2f', topf::DOUBLE) || ')', ';' ORDER BY class)"


@query("w08_top_positions", _CT + f"""
    , b AS (SELECT *, row_number() OVER (ORDER BY round(spec, 9) DESC, region, pos) AS rk FROM ru), c AS (SELECT region, pos, {_TXT} AS txt FROM mt WHERE class <> 'GLOBAL' GROUP BY region, pos)
    SELECT rk AS rank_specificity, region, pos, round(spec, 6) AS specificity, txt AS consensus_by_class FROM b JOIN c USING (region, pos) WHERE rk <= 20""", V)
def top_positions(spark, sf):
    m = metrics_of(spark, sf)
    t = sites.top_positions(rollup_of(m), m, 20)
    return rounded(t.select("rank_specificity", "region", "pos", "specificity", "consensus_by_class"), "specificity")


@query("w09_top_pair_positions", _CT + f"""
    , b AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY round(jsd, 9) DESC, region, pos) AS rk FROM pr), c AS (SELECT region, pos, {_TXT} AS txt FROM mt WHERE class <> 'GLOBAL' GROUP BY region, pos)
    SELECT pair, rk AS rank_pair_jsd, region, pos, round(jsd, 6) AS jsd, round(ov, 6) AS distribution_overlap, txt AS consensus_by_class FROM b JOIN c USING (region, pos) WHERE rk <= 5""", V)
def top_pair_positions(spark, sf):
    m = metrics_of(spark, sf)
    t = sites.top_pair_positions(sites.pair_divergence(m), m, 5)
    return rounded(t.select("pair", "rank_pair_jsd", "region", "pos", "jsd", "distribution_overlap", "consensus_by_class"), "jsd", "distribution_overlap")


_POS_SQL = """
    , pt AS (SELECT region, pos, CASE WHEN symbol <> '-' THEN u END AS ref_pos FROM (SELECT region, seq_id, site_pos AS pos, symbol, sum((symbol <> '-')::INTEGER) OVER (PARTITION BY region, seq_id ORDER BY site_pos) AS u,
        min(seq_id) OVER (PARTITION BY region) AS first_id FROM site WHERE class = 'DENV2') WHERE seq_id = first_id),
    sc AS (SELECT region, pos - "start" AS p0, abs(score) AS v FROM plong JOIN regions ON pos >= "start" AND pos < "end"),
    js AS (SELECT region, pt.pos, avg(v) AS score FROM sc JOIN pt USING (region) WHERE pt.ref_pos = p0 + 1 GROUP BY region, pt.pos)"""


def column_scores(spark, sf, coordinate="ref"):
    p = views.profiles(spark, sf).select(F.posexplode("scores").alias("p", "v"))
    r = views.region_rows()
    region = F.lit(None).cast("string")
    base = F.lit(None).cast("int")
    for name, _, s, e in reversed(r):
        inside = (F.col("p") >= s) & (F.col("p") < e)
        region, base = F.when(inside, name).otherwise(region), F.when(inside, F.col("p") - s).otherwise(base)
    rows = p.select(region.alias("region"), base.alias("p0"), F.abs("v").alias("v"))
    table = sites.position_table(A(spark, sf), F.col("class") == "DENV2") if coordinate == "ref" else None
    return sites.score_on_columns(rows, "p0", "v", table, zero_based=True)


@query("j06_reference_coordinates", "WITH " + _POS_SQL.strip()[1:] + " SELECT region, pos, round(score, 6) AS score FROM js", ("site", "plong", "regions"))
def reference_coordinates(spark, sf):
    return rounded(column_scores(spark, sf), "score")


@query("j09_score_site_join", _CT + _POS_SQL + """
    SELECT region, pos, round(score, 6) AS score, round(gh, 6) AS global_entropy_norm, round(jm, 6) AS pairwise_jsd_mean, round(spec, 6) AS specificity FROM ru JOIN js USING (region, pos)""", ("site", "plong", "regions"))
def score_site_join(spark, sf):
    j = rollup_of(metrics_of(spark, sf)).join(column_scores(spark, sf), ["region", "pos"])
    return rounded(j.select("region", "pos", "score", "global_entropy_norm", "pairwise_jsd_mean", "specificity"), "score", "global_entropy_norm", "pairwise_jsd_mean", "specificity")


CORR = ["global_entropy_norm", "global_conservation_norm", "class_entropy_mean", "class_entropy_range", "intra_similarity_mean", "pairwise_jsd_mean", "pairwise_jsd_max", "pairwise_overlap_mean", "specificity", "global_gap_fraction"]
_CORR_SQL = dict(zip(CORR, ["gh", "gc", "em", "erange", "sm", "jm", "jx", "om", "spec", "ggap"]))


@query("a43_correlations", _CT + _POS_SQL + ", jj AS (SELECT * FROM ru JOIN js USING (region, pos)), l AS (" + " UNION ALL ".join(
    f"SELECT '{k}' AS metric, round(score, 9) AS score, round({v}, 9) AS v FROM jj" for k, v in _CORR_SQL.items()) + """),
    r AS (SELECT *, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY metric ORDER BY score) + (count(*) OVER (PARTITION BY metric, score) - 1) / 2.0 AS rs FROM l)
    SELECT metric, count(*) AS n_positions, round(corr(score, v), 6) AS pearson_r, round(corr(rs, rv), 6) AS spearman_rho FROM r GROUP BY metric""", ("site", "plong", "regions"))
def correlations(spark, sf):
    j = rollup_of(metrics_of(spark, sf)).join(column_scores(spark, sf), ["region", "pos"])
    j = j.select("region", "pos", *[F.round(c, 9).alias(c) for c in ["score", *CORR]])
    return rounded(sites.correlations(j, "score", CORR), "pearson_r", "spearman_rho")


@query("j08_class_pairs", """
    SELECT r.region, a.class AS a, b.class AS b, a.n * b.n AS n_pairs FROM (SELECT DISTINCT region FROM aligned) r JOIN (SELECT region, class, count(*) AS n FROM aligned GROUP BY ALL) a USING (region)
    JOIN (SELECT region, class, count(*) AS n FROM aligned GROUP BY ALL) b ON b.region = r.region AND a.class < b.class""", ("aligned",))
def class_pairs(spark, sf):
    from strainlens.operators.joins import unordered_pairs
    n = A(spark, sf).groupBy("region").agg(*[F.count_if(F.col("class") == c).alias(c) for c in C.CLASSES])
    size = F.create_map(*[x for c in C.CLASSES for x in (F.lit(c), F.col(c))])
    rows = n.select("region", size.alias("_n"), F.inline(unordered_pairs(C.CLASSES)))
    return rows.select("region", "a", "b", (F.try_element_at("_n", F.col("a")) * F.try_element_at("_n", F.col("b"))).alias("n_pairs")).filter("n_pairs > 0")


@query("q05_variability_run", _CT + _POS_SQL + """
    SELECT region, count(*) AS n_columns, round(avg(gh), 6) AS mean_entropy, round(avg(jm), 6) AS mean_jsd, round(max(spec), 6) AS max_specificity, round(corr(score, spec), 6) AS score_specificity_r, min(b.top) AS first_top
    FROM ru LEFT JOIN js USING (region, pos) JOIN (SELECT region, min(pos) AS top FROM (SELECT region, pos, rank() OVER (PARTITION BY region ORDER BY round(spec, 9) DESC) AS k FROM ru) WHERE k = 1 GROUP BY region) b USING (region) GROUP BY region""", ("site", "plong", "regions"))
def variability_run(spark, sf):
    m = metrics_of(spark, sf)
    r = rollup_of(m).join(column_scores(spark, sf), ["region", "pos"], "left")
    out = r.groupBy("region").agg(
        F.count(F.lit(1)).alias("n_columns"), F.avg("global_entropy_norm").alias("mean_entropy"), F.avg("pairwise_jsd_mean").alias("mean_jsd"), F.max("specificity").alias("max_specificity"),
        F.corr("score", "specificity").alias("score_specificity_r"), F.min_by("pos", F.struct(-F.round("specificity", 9), "pos")).alias("first_top"))
    return rounded(out, "mean_entropy", "mean_jsd", "max_specificity", "score_specificity_r")
