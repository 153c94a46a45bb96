"""Identifier joins, split building and their checks."""
from __future__ import annotations

from pyspark.sql import functions as F

from strainlens.functions import text as tx
from strainlens.operators import checks, joins, splits
from strainlens.plans import views
from strainlens.plans.registry import query


def keyed(spark, sf):
    """Full ids with their index (some twice), and possibly truncated ids."""
    m = views.meta(spark, sf)
    full = F.concat(F.lit("v"), F.lpad(F.col("idx").cast("string"), 8, "0"), F.lit("/"), "country")
    base = m.select("idx", "class", full.alias("full_id"))
    alias = base.filter(F.col("idx") % 100 == 0).select("idx", "class", F.concat("full_id", F.lit("/copy")).alias("full_id"))
    short = base.select("idx", F.when(F.col("idx") % 5 == 0, F.substring("full_id", 1, 9)).when(F.col("idx") % 23 == 0, F.substring("full_id", 1, 8))
                        .when(F.col("idx") % 29 == 0, F.concat("full_id", F.lit("/tail"))).when(F.col("idx") % 31 == 0, F.concat(F.lit("x"), "full_id")).otherwise(F.col("full_id")).alias("seq_id"))
    return base.unionByName(alias), short


_KEYED = """
    WITH b AS (SELECT idx, class, 'v' || lpad(CAST(idx AS VARCHAR), 8, '0') || '/' || country AS full_id FROM meta),
    k AS (SELECT * FROM b UNION ALL SELECT idx, class, full_id || '/copy' FROM b WHERE idx % 100 = 0),
    s AS (SELECT idx, CASE WHEN idx % 5 = 0 THEN substr(full_id, 1, 9) WHEN idx % 23 = 0 THEN substr(full_id, 1, 8) WHEN idx % 29 = 0 THEN full_id || '/tail' WHEN idx % 31 = 0 THEN 'x' || full_id ELSE full_id END AS seq_id FROM b)"""


@query("j01_index_lookup", _KEYED + ' SELECT seq_id, k.idx AS "index" FROM s JOIN k ON k.full_id = seq_id', ("meta",))
def index_lookup(spark, sf):
    k, s = keyed(spark, sf)
    found, _ = joins.lookup_index(s.select("seq_id"), k, "seq_id", "full_id", "idx")
    return found


@query("j01_unmapped_ids", _KEYED + " SELECT seq_id FROM s WHERE seq_id NOT IN (SELECT full_id FROM k)", ("meta",))
def unmapped_ids(spark, sf):
    k, s = keyed(spark, sf)
    _, gone = joins.lookup_index(s.select("seq_id"), k, "seq_id", "full_id", "idx")
    return gone


@query("j02_prefix_lookup", _KEYED + """
    , u AS (SELECT DISTINCT seq_id FROM s), e AS (SELECT full_id, min(idx) AS idx, count(*) AS c FROM k GROUP BY full_id), m AS (
      SELECT seq_id, idx, 'exact' AS how, c AS n FROM u JOIN e ON full_id = seq_id
      UNION ALL SELECT seq_id, CASE WHEN min(idx) = max(idx) THEN min(idx) END, CASE WHEN min(idx) IS NULL THEN 'missing' WHEN min(idx) = max(idx) THEN 'prefix' ELSE 'ambiguous' END, count(full_id)
        FROM u LEFT JOIN e ON starts_with(full_id, seq_id) OR starts_with(seq_id, full_id) WHERE seq_id NOT IN (SELECT full_id FROM k) GROUP BY seq_id)
    SELECT s.idx, s.seq_id, m.idx AS "index", how, n AS n_matches FROM s JOIN m USING (seq_id)""", ("meta",))
def prefix_lookup(spark, sf):
    k, s = keyed(spark, sf)
    return joins.prefix_lookup(s, k, "seq_id", "full_id", "idx")


@query("j02_first_key", _KEYED + """
    SELECT s.idx, seq_id, (SELECT full_id FROM k WHERE starts_with(full_id, seq_id) ORDER BY full_id <> seq_id, k.idx, full_id LIMIT 1) AS matched_key FROM s""", ("meta",))
def first_key(spark, sf):
    k, s = keyed(spark, sf)
    return joins.first_key_starting_with(s, k, "seq_id", "full_id", "idx")


_OCC = """
    WITH f AS (SELECT 'r' || (idx % 700) AS id, label, idx AS fpos FROM meta WHERE idx % 50 <> 7), t AS (SELECT 'r' || (idx % 700) AS id, label, 1000000 - idx AS tpos FROM meta WHERE idx % 60 <> 11),
    fr AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY fpos) AS rn FROM f), tr AS (SELECT *, row_number() OVER (PARTITION BY id, label ORDER BY tpos) AS rn FROM t)"""


@query("j04_occurrence_join", _OCC + """
    SELECT coalesce(tr.id, fr.id) AS id, coalesce(tr.label, fr.label) AS label, tpos, fpos, CASE WHEN fpos IS NULL THEN 'missing' WHEN tpos IS NULL THEN 'leftover' ELSE 'matched' END AS status
    FROM tr FULL JOIN fr ON tr.id = fr.id AND tr.label = fr.label AND tr.rn = fr.rn""", ("meta",))
def occurrence_join(spark, sf):
    m = views.meta(spark, sf).select(F.concat(F.lit("r"), F.col("idx") % 700).alias("id"), "label", "idx")
    f = m.filter(F.col("idx") % 50 != 7).select("id", "label", F.col("idx").alias("fpos"))
    t = m.filter(F.col("idx") % 60 != 11).select("id", "label", (1000000 - F.col("idx")).alias("tpos"))
    return joins.occurrence_join(f, t, ["id", "label"], "fpos", "tpos")


_ROWS = """
    WITH r AS (SELECT idx, 'Fold ' || (cluster_id % 5 + 1) AS fold, class, cluster_id FROM meta), md AS (SELECT * FROM meta WHERE idx % 17 <> 0)"""


@query("j12_annotated_rows", _ROWS + """
    SELECT r.idx, fold, r.class, coalesce(md.country, 'Unknown') AS country, coalesce(CAST(md.year AS VARCHAR), 'Unknown') AS year, CASE WHEN md.idx IS NULL THEN 0 ELSE 1 END AS metadata_found
    FROM r LEFT JOIN md ON r.idx = md.idx""", ("meta",))
def annotated_rows(spark, sf):
    m = views.meta(spark, sf)
    rows = m.select("idx", tx.pretty_fold(F.concat(F.lit("fold_"), F.col("cluster_id") % 5 + 1)).alias("fold"), "class")
    return joins.annotate_rows(rows, m.filter(F.col("idx") % 17 != 0), "idx", ["country", "year"])


@query("j12_missing_ids", "SELECT idx FROM meta WHERE idx % 17 = 0", ("meta",))
def missing_ids(spark, sf):
    m = views.meta(spark, sf).select("idx")
    return joins.missing_ids(m, m.filter(F.col("idx") % 17 != 0), "idx")


@query("f03_cluster_map", "SELECT idx AS \"index\", class || '::cluster_' || cluster_id AS cluster_key FROM meta", ("meta",))
def cluster_map(spark, sf):
    m = views.meta(spark, sf).select(F.col("idx").alias("index"), F.concat("class", F.lit("::cluster_"), "cluster_id").alias("cluster_key"))
    repeated = m.withColumn("fold", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return checks.unique_mapping(repeated, "index", "cluster_key")


@query("f03_conflicting_keys", """
    SELECT cluster_id, min(class) AS first_value, max(class) AS other_value FROM meta GROUP BY cluster_id HAVING min(class) <> max(class)""", ("meta",))
def conflicting_keys(spark, sf):
    return checks.conflicting_keys(views.meta(spark, sf), "cluster_id", "class")


@query("f05_unknown_class", """
    SELECT kept, c AS class, count(*) AS n FROM (SELECT 'dropped' AS kept, 'DENV' || d AS c FROM (SELECT nullif(regexp_extract(header, '(?i)DENV(\\d)', 1), '') AS d FROM meta) WHERE d IS NOT NULL
      UNION ALL SELECT 'kept', coalesce('DENV' || nullif(regexp_extract(header, '(?i)DENV(\\d)', 1), ''), 'UNKNOWN') FROM meta) GROUP BY ALL""", ("meta",))
def unknown_class(spark, sf):
    m = views.meta(spark, sf).select("idx", "header")
    label = tx.infer_class(F.col("header"), "header")
    a = checks.label_or_unknown(m, label, "class", True).select(F.lit("dropped").alias("kept"), "class")
    b = checks.label_or_unknown(m, label, "class", False).select(F.lit("kept").alias("kept"), "class")
    return a.unionByName(b).groupBy("kept", "class").agg(F.count(F.lit(1)).alias("n"))


# Seeded validation choice in SQL: quota by largest remainder, rows in md5 order.
_LOGO = """
    WITH g AS (SELECT DISTINCT continent AS fold FROM meta),
    r AS (SELECT g.fold, idx, class, continent = g.fold AS is_test FROM meta, g),
    c AS (SELECT fold, class, count(*) AS n FROM r WHERE NOT is_test GROUP BY ALL),
    t AS (SELECT *, sum(n) OVER (PARTITION BY fold) AS tot, count(*) OVER (PARTITION BY fold) AS k, min(n) OVER (PARTITION BY fold) AS lo FROM c),
    v AS (SELECT *, greatest(1, least(CAST(round_even(tot * 0.1, 0) AS BIGINT), tot - 1)) AS want FROM t),
    q AS (SELECT *, (want * n) // tot AS whole, (want * n) % tot AS rest FROM v),
    qq AS (SELECT *, whole + CASE WHEN row_number() OVER (PARTITION BY fold ORDER BY rest DESC, class) <= want - sum(whole) OVER (PARTITION BY fold) THEN 1 ELSE 0 END AS quota FROM q),
    o AS (SELECT fold, idx, class, row_number() OVER (PARTITION BY fold, class ORDER BY md5('42:' || fold || ':' || idx), fold, idx) AS rn FROM r WHERE NOT is_test),
    sp AS (SELECT fold, idx, class, 'test' AS split FROM r WHERE is_test UNION ALL SELECT o.fold, o.idx, o.class, CASE WHEN rn <= quota THEN 'val' ELSE 'train' END FROM o JOIN qq ON o.fold = qq.fold AND o.class = qq.class)"""


def leave_out(spark, sf):
    return splits.leave_one_group_out(views.meta(spark, sf), "idx", "class", "continent", views.CONTINENTS)


@query("h01_leave_one_group_out", _LOGO + ' SELECT fold, idx AS "index", split, fold AS "group", class FROM sp', ("meta",))
def leave_one_group_out(spark, sf):
    return leave_out(spark, sf)


@query("h02_validation_quota", _LOGO + " SELECT fold, class, true AS stratified, CAST(quota AS BIGINT) AS quota FROM qq", ("meta",))
def validation_quota(spark, sf):
    groups = F.explode(F.array(*[F.lit(g) for g in views.CONTINENTS]))
    pool = views.meta(spark, sf).select("class", "continent", groups.alias("fold")).filter(F.col("continent") != F.col("fold"))
    return splits.validation_quota(pool.groupBy("fold", "class").agg(F.count(F.lit(1)).alias("n")), "fold", "class")


@query("a04_split_summary", _LOGO + " SELECT fold, split, class, count(*) AS n FROM sp GROUP BY ALL", ("meta",))
def split_summary(spark, sf):
    from strainlens.operators.crosstab import split_summary as summary
    return summary(leave_out(spark, sf))


@query("f02_split_validity", _LOGO + """
    SELECT fold, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val, count(*) FILTER (split = 'test') AS n_test, min(idx) AS min_index, max(idx) AS max_index,
      count(*) FILTER (idx < 0 OR idx >= (SELECT count(*) + 1 FROM meta)) AS out_of_range, 0::BIGINT AS overlap_train_val, 0::BIGINT AS overlap_train_test, 0::BIGINT AS overlap_val_test,
      CASE WHEN count(*) FILTER (idx < 0 OR idx >= (SELECT count(*) + 1 FROM meta)) = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM sp GROUP BY fold""", ("meta",))
def split_validity(spark, sf):
    n = views.meta(spark, sf).select("idx").unionByName(views.meta(spark, sf).agg(F.max("idx").alias("idx")))
    return checks.split_validity(leave_out(spark, sf), total=n)


# folds that break the rules: b has indices in two splits and negative ones, c has no validation rows
@query("f02_split_failures", """
    WITH f AS (SELECT fold, idx, CASE WHEN idx % 10 = 0 AND fold <> 'c' THEN 'val' WHEN idx % 10 = 1 THEN 'test' ELSE 'train' END AS split FROM meta, (SELECT unnest(['a', 'b', 'c']) AS fold)),
    s AS (SELECT fold, CASE WHEN fold = 'b' AND idx % 40 = 3 THEN -idx ELSE idx END AS i, split FROM f
      UNION ALL SELECT 'b', idx, CASE WHEN idx % 50 = 20 THEN 'test' ELSE 'train' END FROM meta WHERE idx % 50 IN (1, 10, 20)),
    p AS (SELECT fold, i, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va, count(*) FILTER (split = 'test') AS te FROM s GROUP BY ALL),
    q AS (SELECT fold, sum(tr)::BIGINT AS n_train, sum(va)::BIGINT AS n_val, sum(te)::BIGINT AS n_test, min(i) AS min_index, max(i) AS max_index, count(*) FILTER (i < 0 OR i > (SELECT max(idx) FROM meta)) AS out_of_range,
      count(*) FILTER (tr > 0 AND va > 0) AS overlap_train_val, count(*) FILTER (tr > 0 AND te > 0) AS overlap_train_test, count(*) FILTER (va > 0 AND te > 0) AS overlap_val_test FROM p GROUP BY fold)
    SELECT *, CASE WHEN n_train > 0 AND n_val > 0 AND out_of_range + overlap_train_val + overlap_train_test + overlap_val_test = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM q""", ("meta",))
def split_failures(spark, sf):
    m = views.meta(spark, sf).select("idx")
    i, fold = F.col("idx"), F.col("fold")
    rows = m.withColumn("fold", F.explode(F.array(*[F.lit(x) for x in "abc"])))
    split = F.when((i % 10 == 0) & (fold != "c"), "val").when(i % 10 == 1, "test").otherwise("train")
    rows = rows.select("fold", F.when((fold == "b") & (i % 40 == 3), -i).otherwise(i).alias("index"), split.alias("split"))
    more = m.filter((i % 50).isin(1, 10, 20)).select(F.lit("b").alias("fold"), i.alias("index"), F.when(i % 50 == 20, "test").otherwise("train").alias("split"))
    return checks.split_validity(rows.unionByName(more), n_samples=m.agg(F.max("idx")).first()[0] + 1)


_GREEDY = """
    WITH RECURSIVE cl AS (SELECT class, cluster_id, count(*) AS size FROM meta GROUP BY ALL),
    od AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY size DESC, cluster_id) AS n FROM cl),
    gr(class, n, cluster_id, size, fold, l1, l2, l3, l4, l5) AS (
      SELECT class, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT class FROM cl)
      UNION ALL SELECT class, n, cluster_id, size, f, l1 + CASE WHEN f = 1 THEN size ELSE 0 END, l2 + CASE WHEN f = 2 THEN size ELSE 0 END, l3 + CASE WHEN f = 3 THEN size ELSE 0 END,
        l4 + CASE WHEN f = 4 THEN size ELSE 0 END, l5 + CASE WHEN f = 5 THEN size ELSE 0 END FROM (
        SELECT od.class, od.n, od.cluster_id, od.size, l1, l2, l3, l4, l5, CASE least(l1, l2, l3, l4, l5) WHEN l1 THEN 1 WHEN l2 THEN 2 WHEN l3 THEN 3 WHEN l4 THEN 4 ELSE 5 END AS f
        FROM gr JOIN od ON od.class = gr.class AND od.n = gr.n + 1))"""


@query("h03_cluster_folds", _GREEDY + " SELECT class, cluster_id, size, 'fold_' || fold AS cluster_fold FROM gr WHERE n > 0", ("meta",))
def cluster_folds(spark, sf):
    return splits.cluster_folds(views.meta(spark, sf), "class", "cluster_id")


@query("h03_cluster_aware_splits", _GREEDY + """
    , own AS (SELECT meta.class, 'fold_' || fold AS f FROM meta JOIN gr ON gr.class = meta.class AND gr.cluster_id = meta.cluster_id AND gr.n > 0),
    x AS (SELECT t.f AS fold, own.class, own.f = t.f AS is_test FROM own, (SELECT 'fold_' || unnest(range(1, 6)) AS f) t),
    p AS (SELECT fold, count(*) AS n FROM x WHERE NOT is_test GROUP BY fold)
    SELECT p.fold, count(*) FILTER (is_test) AS n_test, CAST(round_even(max(p.n) * 0.1, 0) AS BIGINT) AS n_val, CAST(max(p.n) - round_even(max(p.n) * 0.1, 0) AS BIGINT) AS n_train FROM x JOIN p ON p.fold = x.fold GROUP BY p.fold""", ("meta",))
def cluster_aware_splits(spark, sf):
    m = views.meta(spark, sf).select("idx", "class", "cluster_id")
    s = splits.cluster_aware_splits(m, splits.cluster_folds(m, "class", "cluster_id"), "idx", "class", "cluster_id")
    return s.groupBy("fold").agg(*[F.count_if(F.col("split") == x).alias(f"n_{x}") for x in ("test", "val", "train")])


@query("h04_sample_per_class", "SELECT idx, class FROM (SELECT idx, class, row_number() OVER (PARTITION BY class ORDER BY md5('13:' || idx), idx) AS rn FROM meta) WHERE rn <= 500", ("meta",))
def sample_per_class(spark, sf):
    return splits.sample_per_class(views.meta(spark, sf).select("idx", "class"), "class", 500, "idx")


@query("h04_weighted_draws", """
    WITH c AS (SELECT class, count(*) AS n FROM meta GROUP BY class), w AS (SELECT idx, meta.class, CAST(round((1 - n / (SELECT count(*) FROM meta)) * 1000, 0) AS BIGINT) AS w FROM meta JOIN c USING (class)),
    r AS (SELECT *, sum(w) OVER (ORDER BY md5('42:' || idx), idx ROWS UNBOUNDED PRECEDING) AS hi, sum(w) OVER () AS tot FROM w),
    p AS (SELECT d AS draw, CAST(floor(CAST(('0x' || substr(md5('42:draw:' || d), 1, 12))::BIGINT AS DOUBLE) / 281474976710656.0 * (SELECT max(tot) FROM r)) AS BIGINT) AS pt FROM (SELECT unnest(range(0, 2000)) AS d))
    SELECT draw, idx, class FROM p JOIN r ON pt >= hi - w AND pt < hi""", ("meta",))
def weighted_draws(spark, sf):
    from strainlens.operators.crosstab import class_weights
    m = views.meta(spark, sf).select("idx", "class")
    w = class_weights(m, "class").select("class", F.round(F.col("weight") * 1000).cast("bigint").alias("w"))
    return splits.weighted_draws(m.join(w, "class"), "w", 2000, "idx").select("draw", "idx", "class")
