"""Cohort preparation: text rules, cleaning, de-duplication, count tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens import session
from strainlens.functions import sequence as sq
from strainlens.functions import text as tx
from strainlens.operators import checks, cohort, crosstab
from strainlens.plans import views
from strainlens.plans.registry import query

_SQL_LIST = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in C.COUNTRY_KEYWORDS) + "]"
_SQL_TITLES = "[" + ", ".join("'" + w.title().replace("'", "''") + "'" for w in C.COUNTRY_KEYWORDS) + "]"


@query("p01_normalise_value", r"""
    SELECT idx, CASE WHEN lower(v) IN ('', 'unknown', 'nan', 'un', 'not found', 'none') THEN 'Unknown' ELSE v END AS value,
      CASE WHEN lower(v) IN ('', 'unknown', 'nan', 'un', 'not found', 'none') THEN 'Unknown'
           WHEN v = 'DRC' THEN 'Democratic Republic of the Congo' ELSE v END AS country
    FROM (SELECT idx, trim(trim(trim(raw), '{}')) AS v FROM (
      SELECT idx, CASE WHEN idx % 3 = 0 THEN ' {' || c || '} ' ELSE c END AS raw
      FROM (SELECT idx, CASE WHEN country = 'EGYPT' THEN 'DRC' WHEN country = 'Unknown' AND idx % 2 = 0 THEN ' ' ELSE country END AS c FROM meta)))
    """, ("meta",))
def normalise_value(spark, sf):
    m = views.meta(spark, sf)
    c = (F.when(F.col("country") == "EGYPT", "DRC")
         .when((F.col("country") == "Unknown") & (F.col("idx") % 2 == 0), " ").otherwise(F.col("country")))
    raw = F.when(F.col("idx") % 3 == 0, F.concat(F.lit(" {"), c, F.lit("} "))).otherwise(c)
    return m.select("idx", tx.normalise_value(raw).alias("value"), tx.normalise_country(raw).alias("country"))


@query("p02_header_metadata", r"""
    SELECT idx, CASE WHEN lower(c) IN ('', 'unknown', 'nan', 'un', 'not found', 'none') THEN 'Unknown' ELSE c END AS country,
      has_country, CAST(nullif(y, '') AS INTEGER) AS year, y <> '' AS has_year
    FROM (SELECT idx, trim(coalesce(nullif(regexp_extract(header, 'META_COUNTRY=\{([^}]+)\}', 1), ''),
              regexp_extract(header, 'META_COUNTRY=([^|;]+?)(\s+META_|$|[|;])', 1))) AS c,
            header LIKE '%META_COUNTRY=%' AS has_country,
            regexp_extract(header, 'META_YEAR=\{?(\d{4})', 1) AS y FROM meta)
    """, ("meta",))
def header_metadata(spark, sf):
    h = F.col("header")
    return views.meta(spark, sf).select(
        "idx", tx.meta_country(h).alias("country"), tx.has_meta_country(h).alias("has_country"),
        tx.meta_year(h).alias("year"), tx.has_meta_year(h).alias("has_year"))


_SLASH = r"""
    SELECT pos, CASE WHEN lower(f) IN ('', 'un', 'unknown', 'na', 'n/a') THEN NULL ELSE replace(f, '_', ' ') END AS country,
      regexp_extract_all(h, '\b(?:19|20)\d{2}\b')[-1] AS year
    FROM (SELECT pos, header AS h, trim(split_part(split_part(header, '|', 1), '/', 2)) AS f FROM seq WHERE source = 'A')"""


@query("p03_slash_header", _SLASH, ("seq",))
def slash_header(spark, sf):
    s = views.sequences(spark, sf).filter(F.col("source") == "A")
    h = F.col("header")
    return s.select("pos", tx.slash_country(h).alias("country"), tx.last_year(h).alias("year"))


_FREE = rf"""
    SELECT pos, nullif(regexp_extract(header, '(^|[^0-9])((?:19|20)[0-9]{{2}})([^0-9]|$)', 2), '') AS year,
      ({_SQL_TITLES})[list_position({_SQL_LIST}, list_filter({_SQL_LIST},
         lambda k: regexp_matches(replace(lower(header), '_', ' '), '\b' || k || '\b'))[1])] AS country
    FROM seq WHERE source = 'B'"""


@query("p04_free_text_header", _FREE, ("seq",))
def free_text_header(spark, sf):
    s = views.sequences(spark, sf).filter(F.col("source") == "B")
    h = F.col("header")
    return s.select("pos", tx.first_year(h).alias("year"), tx.named_country(h).alias("country"))


_CLASS_TEXT = """
    SELECT idx, CASE idx % 9 WHEN 0 THEN 'x denv-' || d || ' y' WHEN 1 THEN 'Serotype: ' || d WHEN 2 THEN 'a_type' || d || '.fa'
      WHEN 3 THEN 'dengue virus ' || d || ' strain' WHEN 4 THEN 'hDenV' || d WHEN 5 THEN 'DENV' || d || '|id|E'
      WHEN 6 THEN 'q D' || d || ' z' WHEN 7 THEN 'none' ELSE 'den-v' || d END AS t
    FROM (SELECT idx, label + 1 AS d FROM meta)"""


@query("p05_class_inference", rf"""
    WITH txt AS ({_CLASS_TEXT})
    SELECT idx,
      'DENV' || nullif(regexp_extract(t, '(?i)DENV(\d)', 1), '') AS by_header,
      'DENV' || coalesce(nullif(regexp_extract(t, '(?i)DENV[-_ ]?([1-4])', 1), ''), nullif(regexp_extract(t, '(?i)SEROTYPE[-_ ]?([1-4])', 1), ''),
        nullif(regexp_extract(t, '(?i)TYPE[-_ ]?([1-4])', 1), '')) AS by_file,
      'DENV' || coalesce(nullif(regexp_extract(t, '(?i)\bDENV[-_ ]?([1-4])\b', 1), ''), nullif(regexp_extract(t, '(?i)\bDEN[-_ ]?V[-_ ]?([1-4])\b', 1), ''),
        nullif(regexp_extract(t, '(?i)\bDENGUE[-_ ]?VIRUS[-_ ]?([1-4])\b', 1), ''), nullif(regexp_extract(t, '(?i)\bH?DENV([1-4])\b', 1), '')) AS by_word,
      'DENV' || coalesce(nullif(regexp_extract(t, '(?i)\bDENV[-_ ]?([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)\bDENGUE[-_ ]?VIRUS[-_ ]?([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)\bSEROTYPE[:=_ -]*([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)\bSERO[:=_ -]*([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)\bTYPE[:=_ -]*([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)\bST[:=_ -]*([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)(?:^|[^A-Z0-9])D([1-4])(?:[^A-Z0-9]|$)', 1), '')) AS by_long,
      CASE WHEN split_part(t, '|', 1) IN ('DENV1','DENV2','DENV3','DENV4') THEN split_part(t, '|', 1) END AS by_field,
      'DENV' || coalesce(nullif(regexp_extract(t, '(?i)a_type(\d)', 1), ''), nullif(regexp_extract(t, '(?i)\bDENV[-_ ]?([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)\bDENGUE[-_ ]?VIRUS[-_ ]?([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)\bSEROTYPE[:=_ -]*([1-4])($|[^A-Z0-9])', 1), ''),
        nullif(regexp_extract(t, '(?i)(?:^|[^A-Z0-9])D([1-4])(?:[^A-Z0-9]|$)', 1), '')) AS by_custom
    FROM txt""", ("meta",))
def class_inference(spark, sf):
    i, d = F.col("idx") % 9, F.col("label") + 1
    text = (
        F.when(i == 0, F.concat(F.lit("x denv-"), d, F.lit(" y"))).when(i == 1, F.concat(F.lit("Serotype: "), d))
        .when(i == 2, F.concat(F.lit("a_type"), d, F.lit(".fa"))).when(i == 3, F.concat(F.lit("dengue virus "), d, F.lit(" strain")))
        .when(i == 4, F.concat(F.lit("hDenV"), d)).when(i == 5, F.concat(F.lit("DENV"), d, F.lit("|id|E")))
        .when(i == 6, F.concat(F.lit("q D"), d, F.lit(" z"))).when(i == 7, "none").otherwise(F.concat(F.lit("den-v"), d))
    )
    t = views.meta(spark, sf).select("idx", text.alias("t"))
    return t.select(
        "idx", *[tx.infer_class(F.col("t"), r).alias(f"by_{r}") for r in ("header", "file", "word", "long", "field")],
        tx.infer_class(F.col("t"), "long", custom=r"a_type(\d)").alias("by_custom"))


@query("p06_class_conflict", r"""
    SELECT idx, class, coalesce('DENV' || nullif(regexp_extract(header, '(?i)DENV(\d)', 1), ''), 'Unknown') AS header_class,
      coalesce('DENV' || nullif(regexp_extract(header, '(?i)DENV(\d)', 1), '') <> class, false) AS conflict FROM meta""", ("meta",))
def class_conflict(spark, sf):
    hc = tx.infer_class(F.col("header"), "header")
    return views.meta(spark, sf).select(
        "idx", "class", F.coalesce(hc, F.lit(C.UNKNOWN)).alias("header_class"),
        tx.class_conflict(hc, F.col("class")).alias("conflict"))


@query("p07_clean_sequence", r"""
    SELECT pos, md5(regexp_replace(translate(upper(raw), 'U-', 'T'), '[^ACGTN]', 'N', 'g')) AS clean_md5,
      md5(translate(upper(raw), 'U-', 'T')) AS bare_md5, length(translate(upper(raw), 'U-', 'T')) AS clean_length FROM seq""", ("seq",))
def clean_sequence(spark, sf):
    s = views.sequences(spark, sf)
    return s.select("pos", F.md5(sq.clean_sequence(F.col("raw")).cast("binary")).alias("clean_md5"),
                    F.md5(sq.clean_sequence(F.col("raw"), mask_other=False).cast("binary")).alias("bare_md5"),
                    F.length(sq.clean_sequence(F.col("raw"))).cast("bigint").alias("clean_length"))


@query("p08_identifiers", r"""
    SELECT pos, regexp_replace(trim(x), '^>+', '') AS seq_id,
      regexp_replace(x, '[^A-Za-z0-9_.:-]+', '_', 'g') AS record_id,
      replace(regexp_replace(x, '[<>:"/\\|?*]', '_', 'g'), ' ', '_') AS safe_name,
      CASE WHEN trim(regexp_replace(x, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') = '' THEN 'profile'
           ELSE trim(regexp_replace(x, '[^A-Za-z0-9_.-]+', '_', 'g'), '_') END AS safe_filename
    FROM (SELECT pos, CASE WHEN pos % 10 = 0 THEN ' >' || header || '?:' || header ELSE '>>' || header END AS x FROM seq)""", ("seq",))
def identifiers(spark, sf):
    x = F.when(F.col("pos") % 10 == 0, F.concat(F.lit(" >"), "header", F.lit("?:"), "header")).otherwise(F.concat(F.lit(">>"), "header"))
    s = views.sequences(spark, sf).select("pos", x.alias("x"))
    x = F.col("x")
    return s.select("pos", tx.normalise_id(x).alias("seq_id"), tx.record_id(x).alias("record_id"),
                    tx.safe_name(x).alias("safe_name"), tx.safe_filename(x).alias("safe_filename"))


@query("p09_sort_keys", r"""
    SELECT idx, CASE WHEN b = 0 THEN 'Fold ' || (idx % 12) ELSE 'holdout' END AS fold_label,
      CASE WHEN b = 0 THEN CAST(idx % 12 AS INTEGER) ELSE 9999 END AS fold_no,
      CASE WHEN year IS NULL THEN 9999 WHEN year < 1998 THEN 0 ELSE 1998 + ((year - 1998) // 2) * 2 END AS bin_order,
      CASE WHEN idx % 3 = 0 THEN 99 ELSE label + 1 END AS class_no,
      (CASE idx % 5 WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 3 THEN 9 ELSE 999 END)::INTEGER AS region_no,
      (['5''UTR','E','3''UTR','2K','other'])[idx % 5 + 1] AS region
    FROM (SELECT *, idx % 2 AS b FROM meta)""", ("meta",))
def sort_keys(spark, sf):
    m = views.meta(spark, sf)
    fold = F.when(F.col("idx") % 2 == 0, F.concat(F.lit("fold_"), F.col("idx") % 12)).otherwise("holdout")
    bin_ = tx.time_bin(F.col("year"), F.lit(2001), 1998, 2)
    region = views.pick(["5_UTR.aln.fasta", "E.fasta", "out/3UTR", "2K", "other.txt"], F.col("idx") % 5)
    label = F.when(F.col("idx") % 3 == 0, "no class").otherwise(F.col("class"))
    return m.select(
        "idx", tx.pretty_fold(fold).alias("fold_label"), tx.fold_number(fold).alias("fold_no"),
        tx.time_bin_order(bin_, 1998).alias("bin_order"), tx.class_order(label).alias("class_no"),
        tx.region_order(region).alias("region_no"), tx.clean_region(region).alias("region"))


@query("p10_year_bins", """
    SELECT idx, CASE WHEN y IS NULL THEN 'Unknown' WHEN y < 2000 THEN '<2000' WHEN y <= 2009 THEN '2000-2009'
        WHEN y <= 2019 THEN '2010-2019' ELSE '2020+' END AS year_bin,
      CASE WHEN y IS NULL THEN 'Unknown' WHEN y < 2006 THEN '<2006'
        ELSE (2006 + ((y - 2006) // 5) * 5) || '-' || least(2006 + ((y - 2006) // 5) * 5 + 4, (SELECT max(year + label * 8) FROM meta)) END AS time_bin
    FROM (SELECT idx, year + label * 8 AS y FROM meta)""", ("meta",))
def year_bins(spark, sf):
    m = views.meta(spark, sf).select("idx", (F.col("year") + F.col("label") * 8).alias("y"))
    top = m.agg(F.max("y")).scalar()
    return m.select("idx", tx.year_bin(F.col("y")).alias("year_bin"), tx.time_bin(F.col("y"), top).alias("time_bin"))


@query("p11_continent_lookup", "SELECT idx, country, continent FROM meta", ("meta",))
def continent_lookup(spark, sf):
    n, r = views.table(spark, sf, "nation"), views.table(spark, sf, "region")
    dim = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("_country"), F.col("r_name").alias("_continent"))
    m = views.meta(spark, sf).select("idx", "country")
    found = m.join(dim, m.country == F.col("_country"), "left")
    return found.select("idx", "country", F.coalesce("_continent", F.lit(C.UNKNOWN)).alias("continent"))


_FEAT_SQL = """
    SELECT pos, class, length(s) AS sequence_length, n_c AS n_count, i_c AS iupac_count, g_c AS gap_count,
      greatest(0, length(s) - acgt - n_c - i_c - g_c) AS other_count, length(s) - acgt AS non_acgt_count, acgt AS acgt_count,
      CASE WHEN length(s) > 0 THEN round(n_c / length(s), 6) ELSE 0 END AS n_fraction,
      CASE WHEN length(s) > 0 THEN round((length(s) - acgt) / length(s), 6) ELSE 0 END AS non_acgt_fraction,
      CASE WHEN acgt > 0 THEN round(gc / acgt, 6) ELSE 0 END AS gc_fraction,
      (SELECT max(length(sequence)) FROM seq) - length(s) AS padding_length,
      round(((SELECT max(length(sequence)) FROM seq) - length(s)) / (SELECT max(length(sequence)) FROM seq), 6) AS padding_fraction
    FROM (SELECT pos, class, sequence AS s, length(sequence) - length(translate(sequence, 'ACGT', '')) AS acgt,
        length(sequence) - length(translate(sequence, 'GC', '')) AS gc, length(sequence) - length(replace(sequence, 'N', '')) AS n_c,
        length(sequence) - length(translate(sequence, 'RYWSKMBDHV', '')) AS i_c, length(sequence) - length(translate(sequence, '-.', '')) AS g_c
      FROM seq)"""


@query("p12_composition", _FEAT_SQL, ("seq",))
def composition(spark, sf):
    s = views.sequences(spark, sf).select("pos", "class", "sequence")
    f = sq.with_padding(sq.composition(s))
    ints = ["sequence_length", "n_count", "iupac_count", "gap_count", "other_count", "non_acgt_count", "acgt_count", "padding_length"]
    fr = ["n_fraction", "non_acgt_fraction", "gc_fraction", "padding_fraction"]
    return f.select("pos", "class", *[F.col(c).cast("bigint").alias(c) for c in ints], *[F.round(c, 6).alias(c) for c in fr])


@query("p13_one_hot", """
    SELECT pos, length(sequence) AS rows_n, length(sequence) - length(replace(sequence, 'A', '')) AS a_n,
      length(sequence) - length(replace(sequence, 'C', '')) AS c_n, length(sequence) - length(replace(sequence, 'G', '')) AS g_n,
      length(sequence) - length(replace(sequence, 'T', '')) AS t_n,
      CASE WHEN instr(sequence, 'T') > 0 THEN instr(sequence, 'T') ELSE 0 END AS first_t,
      CAST(substr(class, 5) AS INTEGER) - 1 AS label, (SELECT max(length(sequence)) FROM seq) AS padded_to FROM seq""", ("seq",))
def one_hot(spark, sf):
    s = session.cut_lineage(views.sequences(spark, sf).select("pos", "class", "sequence"), "one-hot-sequences")
    longest = s.agg(F.max(F.length("sequence"))).first()[0] or 0
    ohe = sq.one_hot(F.col("sequence"))
    e = s.select("pos", "class", sq.channel_summary(ohe).alias("ohe"), sq.encoded_length(sq.pad_one_hot(ohe, longest)).alias("padded_to"))
    with session.arrow_batches(spark, sq.padded_records(longest)):
        e = session.cut_lineage(e, "one-hot")
    return e.select("pos", F.col("ohe.rows").alias("rows_n"), *[F.col("ohe.totals")[k].alias(f"{b}_n") for k, b in enumerate("acgt")],
                    F.col("ohe.first")[3].alias("first_t"), (F.substring("class", 5, 1).cast("int") - 1).alias("label"), "padded_to")


@query("p14_position_mask", """
    SELECT pos, length(sequence) AS mask_length, length(sequence) - length(translate(sequence, 'ACGT', '')) AS n_real,
      least(length(sequence), 64) AS common_length,
      length(substr(sequence, 1, 64)) - length(translate(substr(sequence, 1, 64), 'ACGT', '')) AS n_real_common FROM seq""", ("seq",))
def position_mask(spark, sf):
    s = views.sequences(spark, sf).select("pos", "sequence")
    m = s.select("pos", sq.position_mask(sq.one_hot(F.col("sequence"))).alias("mask"), F.sequence(F.lit(1), F.lit(64)).alias("scores"))
    mask, scores = sq.cut_to_common(F.col("mask"), F.col("scores"))
    def real(a):
        return F.size(F.filter(a, lambda v: v)).cast("bigint")
    counts = m.select("pos", F.size("mask").cast("bigint").alias("mask_length"), real(F.col("mask")).alias("n_real"),
                      F.size(scores).cast("bigint").alias("common_length"), real(mask).alias("n_real_common"))
    with session.arrow_batches(spark, sq.ENCODED_RECORDS):
        return session.cut_lineage(counts, "position-mask")


@query("p18_display_names", """
    SELECT idx, CAST(label + 1 AS VARCHAR) AS class_norm, (['Cluster-aware','Geographical','Temporal','other'])[idx % 4 + 1] AS protocol_display
    FROM meta""", ("meta",))
def display_names(spark, sf):
    from strainlens.functions.annotate import display_name
    raw = (F.when(F.col("idx") % 3 == 0, F.concat(F.lit(" DENV-"), F.col("label") + 1))
           .when(F.col("idx") % 3 == 1, F.col("class")).otherwise(F.concat(F.col("label") + 1, F.lit(".0"))))
    names = {"cluster": "Cluster-aware", "geographical": "Geographical", "temporal": "Temporal"}
    return views.meta(spark, sf).select(
        "idx", tx.normalise_class_label(raw).alias("class_norm"),
        display_name(views.pick(["cluster", "geographical", "temporal", "other"], F.col("idx") % 4), names).alias("protocol_display"))


@query("p19_detect_alphabet", """
    SELECT source, CASE WHEN list_has_all(['A','C','G','T','U','N','R','Y','S','W','K','M','B','D','H','V'], list(DISTINCT ch)) THEN 'nt' ELSE 'aa' END AS name
    FROM (SELECT 'alignment' AS source, symbol AS ch FROM site WHERE symbol NOT IN ('-', '.')
          UNION ALL SELECT 'text', unnest(string_split(sequence, '')) FROM seq) WHERE ch NOT IN ('-', '.', '*', ' ', '')
    GROUP BY source""", ("site", "seq"))
def detect_alphabet(spark, sf):
    a = sq.detect_alphabet(views.aligned(spark, sf), "aligned").select(F.lit("alignment").alias("source"), "name")
    return a.unionByName(sq.detect_alphabet(views.sequences(spark, sf), "sequence").select(F.lit("text").alias("source"), "name"))


@query("d01_dedup_in_source", """
    SELECT class, source, md5(sequence) AS seq_md5, min(pos) AS pos, count(*) AS copies FROM seq GROUP BY class, source, sequence""", ("seq",))
def dedup_in_source(spark, sf):
    u = cohort.unique_in_source(views.sequences(spark, sf).select("class", "source", "sequence", "pos", "header"), ["class", "source"])
    return u.select("class", "source", F.md5(F.col("sequence").cast("binary")).alias("seq_md5"), "pos", "copies")


@query("d01_dedup_counts", """
    SELECT source, count(*) AS input_records, count(DISTINCT sequence) AS unique_sequences, count(*) - count(DISTINCT sequence) AS duplicates
    FROM seq GROUP BY source""", ("seq",))
def dedup_counts(spark, sf):
    return cohort.dedup_counts(views.sequences(spark, sf), ["source"])


@query("d02_priority_merge", """
    WITH u AS (SELECT source, sequence, min(pos) AS pos FROM seq GROUP BY source, sequence),
    g AS (SELECT sequence, min(pos) FILTER (source = 'B') AS b, min(pos) FILTER (source = 'A') AS a FROM u GROUP BY sequence)
    SELECT md5(sequence) AS seq_md5, CASE WHEN a IS NOT NULL THEN 'A' ELSE 'B' END AS source, coalesce(a, b) AS pos,
      CASE WHEN b IS NOT NULL THEN 0 ELSE 1 END AS merge_part, coalesce(b, a) AS merge_pos,
      (a IS NOT NULL)::BIGINT + (b IS NOT NULL)::BIGINT AS n_sources FROM g""", ("seq",))
def priority_merge(spark, sf):
    s = views.sequences(spark, sf).select("source", "sequence", "pos", "header")
    u = cohort.unique_in_source(s, ["source"]).drop("copies")
    m = cohort.merge_sources(u, [], base="B", override="A")
    return m.select(F.md5(F.col("sequence").cast("binary")).alias("seq_md5"), "source", "pos", "merge_part", "merge_pos", "n_sources")


@query("d03_cross_source_duplicates", """
    SELECT class, count(*) AS shared FROM (SELECT class, sequence FROM seq WHERE source = 'A' INTERSECT SELECT class, sequence FROM seq WHERE source = 'B')
    GROUP BY class""", ("seq",))
def cross_source_duplicates(spark, sf):
    s = views.sequences(spark, sf).select("class", "sequence", "source")
    return cohort.shared_sequences(s, ["class"], "source", "AB")


@query("d05_cluster_summary", """
    SELECT class, CAST(sum(n) AS BIGINT) AS n_input_sequences, count(*) AS n_clusters, count(*) AS n_representative_sequences,
      CAST(sum(n) - count(*) AS BIGINT) AS n_removed, round((sum(n) - count(*)) / sum(n), 6) AS fraction_removed,
      count(*) FILTER (n = 1) AS singleton_clusters, count(*) FILTER (n > 1) AS multi_sequence_clusters, max(n) AS max_cluster_size,
      round(avg(n), 6) AS mean_cluster_size FROM (SELECT class, cluster_id, count(*) AS n FROM meta GROUP BY ALL) GROUP BY class""", ("meta",))
def cluster_summary(spark, sf):
    out = cohort.cluster_summary(views.meta(spark, sf))
    return out.withColumn("fraction_removed", F.round("fraction_removed", 6)).withColumn("mean_cluster_size", F.round("mean_cluster_size", 6))


@query("d06_union_tables", """
    SELECT part, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM (SELECT 'meta' AS part, label AS v FROM meta UNION ALL
      SELECT 'seq', length(sequence) FROM seq UNION ALL SELECT 'profiles', class FROM prof) GROUP BY part""", ("meta", "seq", "prof"))
def union_tables(spark, sf):
    parts = [views.meta(spark, sf).select(F.lit("meta").alias("part"), F.col("label").alias("v")),
             views.sequences(spark, sf).select(F.lit("seq").alias("part"), F.length("sequence").alias("v")),
             views.profiles(spark, sf).select(F.lit("profiles").alias("part"), F.col("class").alias("v"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query("d07_first_fold_wins", """
    SELECT sample, fold, strategy FROM (SELECT sample, fold, strategy, row_number() OVER (PARTITION BY sample ORDER BY fold, strategy) AS rn
      FROM (SELECT DISTINCT sample, fold, strategy FROM splong)) WHERE rn = 1""", ("splong",))
def first_fold_wins(spark, sf):
    p = views.strategy_profiles(spark, sf).select("sample", "fold", "strategy")
    return cohort.first_wins(p, ["sample"], ["fold", "strategy"])


@query("d08_ordered_distinct", """
    SELECT value, row_number() OVER (ORDER BY first_at) AS place FROM (
      SELECT trim(header_country) AS value, min(idx) AS first_at FROM (SELECT idx, CASE WHEN idx % 5 = 0 THEN '  ' ELSE ' ' || country END AS header_country FROM meta)
      WHERE trim(header_country) <> '' GROUP BY 1)""", ("meta",))
def ordered_distinct(spark, sf):
    v = F.when(F.col("idx") % 5 == 0, "  ").otherwise(F.concat(F.lit(" "), "country"))
    return cohort.ordered_distinct(views.meta(spark, sf).select("idx", v.alias("value")), "value", ["idx"])


@query("w10_longest_record", """
    SELECT class, record_id, pos, length_nt FROM (SELECT class, record_id, pos, length(translate(sequence, 'U-', 'T')) AS length_nt,
      row_number() OVER (PARTITION BY class ORDER BY length(translate(sequence, 'U-', 'T')) DESC, pos) AS rn FROM seq) WHERE rn = 1
    UNION ALL SELECT 'ALL', record_id, pos, length_nt FROM (SELECT record_id, pos, length(translate(sequence, 'U-', 'T')) AS length_nt,
      row_number() OVER (ORDER BY length(translate(sequence, 'U-', 'T')) DESC, class, pos) AS rn FROM seq) WHERE rn = 1""", ("seq",))
def longest_record(spark, sf):
    s = views.sequences(spark, sf)
    per = cohort.longest_record(
        s.select("class", "record_id", "pos", F.length(sq.clean_sequence(F.col("sequence"), False)).alias("n")), ["class"], F.col("n"))
    per = per.select("class", "record_id", "pos", F.col("length_nt").cast("bigint").alias("length_nt"))
    # a handful of rows: the winner per class, then over all classes
    best = per.orderBy(F.desc("length_nt"), "class", "pos").limit(1).withColumn("class", F.lit("ALL"))
    return per.unionByName(best)


_Q01_BASE = rf"""
    WITH g AS (SELECT class, sequence, count(*) FILTER (source = 'B') AS nb, count(*) FILTER (source = 'A') AS na,
        coalesce(arg_min(header, pos) FILTER (source = 'A'), arg_min(header, pos) FILTER (source = 'B')) AS header
      FROM seq GROUP BY class, sequence),
    f AS (SELECT class, nb, na, CASE WHEN na > 0 THEN split_part(header, ' ', 1) ELSE header END AS h FROM g),
    m AS (SELECT class, nb, na, h, CASE WHEN na > 0 THEN regexp_extract_all(h, '\b(?:19|20)\d{{2}}\b')[-1]
          ELSE nullif(regexp_extract(h, '(^|[^0-9])((?:19|20)[0-9]{{2}})([^0-9]|$)', 2), '') END AS y,
        CASE WHEN na > 0 THEN CASE WHEN lower(split_part(split_part(h, '|', 1), '/', 2)) IN ('', 'un', 'unknown', 'na', 'n/a') THEN NULL
            ELSE replace(split_part(split_part(h, '|', 1), '/', 2), '_', ' ') END
          ELSE ({_SQL_TITLES})[list_position({_SQL_LIST}, list_filter({_SQL_LIST},
            lambda k: regexp_matches(replace(lower(h), '_', ' '), '\b' || k || '\b'))[1])] END AS c FROM f)"""


@query("q01_cohort_preparation", _Q01_BASE + """
    SELECT class, CAST(sum(nb) AS BIGINT) AS base_input_records, CAST(sum(na) AS BIGINT) AS override_input_records,
      count(*) FILTER (nb > 0) AS base_unique_sequences, count(*) FILTER (na > 0) AS override_unique_sequences,
      CAST(sum(nb) - count(*) FILTER (nb > 0) AS BIGINT) AS base_within_source_duplicates,
      CAST(sum(na) - count(*) FILTER (na > 0) AS BIGINT) AS override_within_source_duplicates,
      count(*) FILTER (na > 0 AND nb > 0) AS cross_source_exact_duplicates, count(*) AS merged_unique_sequences,
      count(*) FILTER (y IS NULL) AS discarded_missing_year, count(*) FILTER (c IS NULL) AS discarded_missing_country,
      count(*) FILTER (y IS NULL OR c IS NULL) AS discarded_total,
      count(*) FILTER (y IS NOT NULL AND c IS NOT NULL AND na = 0) AS retained_from_base,
      count(*) FILTER (y IS NOT NULL AND c IS NOT NULL AND na > 0) AS retained_from_override,
      count(*) FILTER (y IS NOT NULL AND c IS NOT NULL) AS final_retained FROM m GROUP BY class""", ("seq",))
def cohort_preparation(spark, sf):
    return cohort.cohort_summary(views.sequences(spark, sf).select("class", "source", "sequence", "pos", "header"), "class")


@query("q01_cohort_records", _Q01_BASE + """
    SELECT class, h || '|META_YEAR=' || y || '|META_COUNTRY=' || c || '|META_SOURCE=' || CASE WHEN na > 0 THEN 'A' ELSE 'B' END AS header
    FROM m WHERE y IS NOT NULL AND c IS NOT NULL""", ("seq",))
def cohort_records(spark, sf):
    s = views.sequences(spark, sf).select("class", "source", "sequence", "pos", "header")
    merged = cohort.merge_sources(cohort.unique_in_source(s, ["class", "source"]).drop("copies"), ["class"], "B", "A")
    kept, _ = cohort.split_retained(cohort.with_source_metadata(merged))
    return kept.select("class", cohort.annotated_header().alias("header"))


@query("f01_discard_audit", """
    SELECT idx, class, CASE WHEN y IS NULL AND c IS NULL THEN 'missing_year_and_country' WHEN y IS NULL THEN 'missing_year' ELSE 'missing_country' END AS reason
    FROM (SELECT idx, class, year AS y, nullif(country, 'Unknown') AS c FROM meta) WHERE y IS NULL OR c IS NULL""", ("meta",))
def discard_audit(spark, sf):
    m = views.meta(spark, sf).withColumn("country", F.nullif("country", F.lit(C.UNKNOWN)))
    _, gone = cohort.split_retained(m)
    return gone.select("idx", "class", "reason")


@query("f01_retention_counts", """
    SELECT class, count(*) AS n_input, count(*) FILTER (year IS NULL) AS missing_year, count(*) FILTER (country = 'Unknown') AS missing_country,
      count(*) FILTER (year IS NULL OR country = 'Unknown') AS discarded_total,
      count(*) FILTER (year IS NOT NULL AND country <> 'Unknown') AS final_retained FROM meta GROUP BY class""", ("meta",))
def retention_counts(spark, sf):
    return cohort.retention_summary(views.meta(spark, sf).withColumn("country", F.nullif("country", F.lit(C.UNKNOWN))), "class")


@query("f07_totals_reconciliation", """
    SELECT coalesce(a.class, b.class) AS class, coalesce(a.n, 0) AS from_labels, coalesce(b.n, 0) AS from_headers,
      abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS difference,
      CASE WHEN coalesce(a.n, 0) = coalesce(b.n, 0) THEN 'PASS' ELSE 'differs from from_labels' END AS status
    FROM (SELECT class, count(*) AS n FROM meta GROUP BY class) a FULL JOIN (SELECT coalesce('DENV' || nullif(regexp_extract(header, '(?i)DENV(\\d)', 1), ''), class) AS class, count(*) AS n FROM meta GROUP BY 1) b
    ON a.class = b.class""", ("meta",))
def totals_reconciliation(spark, sf):
    m = views.meta(spark, sf)
    a = m.groupBy("class").agg(F.count(F.lit(1)).alias("n"))
    hc = F.coalesce(tx.infer_class(F.col("header"), "header"), F.col("class"))
    b = m.groupBy(hc.alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return checks.reconcile_totals([("from_labels", a), ("from_headers", b)], "class")


@query("f08_missing_audit", """
    SELECT 'country' AS "check", count(*) FILTER (country = 'Unknown') AS n FROM meta
    UNION ALL SELECT 'continent', count(*) FILTER (continent = 'Unknown') FROM meta
    UNION ALL SELECT 'year', count(*) FILTER (year IS NULL) FROM meta
    UNION ALL SELECT 'class_conflict', count(*) FILTER (regexp_extract(header, '(?i)DENV(\\d)', 1) NOT IN ('', CAST(label + 1 AS VARCHAR))) FROM meta""", ("meta",))
def missing_audit(spark, sf):
    hc = tx.infer_class(F.col("header"), "header")
    return checks.missing_audit(views.meta(spark, sf), {
        "country": F.col("country") == C.UNKNOWN, "continent": F.col("continent") == C.UNKNOWN,
        "year": F.col("year").isNull(), "class_conflict": tx.class_conflict(hc, F.col("class"))})


@query("o02_preview_missing", "SELECT idx, class, country FROM meta WHERE year IS NULL ORDER BY idx", ("meta",))
def preview_missing(spark, sf):
    return checks.preview(views.meta(spark, sf).select("idx", "class", "country", "year"), F.col("year").isNull(), ["idx"]).drop("year")


_TAB = ", ".join(f"count(*) FILTER (class = '{c}') AS {c}" for c in C.CLASSES)


@query("a01_class_by_continent", f"""
    SELECT continent, {_TAB}, row_number() OVER (ORDER BY CASE WHEN continent = 'Unknown' THEN 2 ELSE 1 END, continent) AS row_place
    FROM meta GROUP BY continent""", ("meta",))
def class_by_continent(spark, sf):
    return crosstab.cross_tab(views.meta(spark, sf), "continent", "class", C.CLASSES)


@query("a02_continent_by_fold", """
    SELECT fold, count(*) FILTER (continent = 'AFRICA') AS AFRICA, count(*) FILTER (continent = 'AMERICA') AS AMERICA,
      count(*) FILTER (continent = 'ASIA') AS ASIA, row_number() OVER (ORDER BY CASE fold WHEN 'fold_3' THEN 1 WHEN 'fold_1' THEN 2 ELSE 3 END, fold) AS row_place
    FROM (SELECT 'fold_' || (cluster_id % 5 + 1) AS fold, continent FROM meta) WHERE continent <> 'Unknown' GROUP BY fold""", ("meta",))
def continent_by_fold(spark, sf):
    m = views.meta(spark, sf).select(F.concat(F.lit("fold_"), F.col("cluster_id") % 5 + 1).alias("fold"), "continent")
    return crosstab.cross_tab(m, "fold", "continent", ["AFRICA", "AMERICA", "ASIA"], ["fold_3", "fold_1"], drop_unknown=True)


_FOLD_SQL = ", ".join([f"count(*) FILTER (class = '{c}') AS \"{c}_sequences\"" for c in C.CLASSES]
                      + [f"count(*) FILTER (continent = '{c}') AS \"{c}_sequences\"" for c in views.CONTINENTS[:-1]]
                      + [f"count(*) FILTER (year_bin = '{b}') AS \"{b}_sequences\"" for b in C.YEAR_BINS])


@query("a03_fold_profile", f"""
    SELECT fold, count(*) AS total_sequences, CAST(sum(found) AS BIGINT) AS metadata_found, count(*) FILTER (found = 0) AS metadata_missing, {_FOLD_SQL},
      count(*) FILTER (continent = 'Unknown') AS "Unknown_continent_sequences", count(*) FILTER (year_bin = 'Unknown') AS "Unknown_year_sequences",
      CAST(substr(fold, 6) AS INTEGER) AS fold_no
    FROM (SELECT 'fold_' || (cluster_id % 5 + 1) AS fold, class, continent, CASE WHEN idx % 17 = 0 THEN 0 ELSE 1 END AS found,
      CASE WHEN year IS NULL THEN 'Unknown' WHEN year < 2000 THEN '<2000' ELSE '2000-2009' END AS year_bin FROM meta) GROUP BY fold""", ("meta",))
def fold_profile(spark, sf):
    m = views.meta(spark, sf).select(
        F.concat(F.lit("fold_"), F.col("cluster_id") % 5 + 1).alias("fold"), "class", "continent",
        F.when(F.col("idx") % 17 == 0, 0).otherwise(1).alias("metadata_found"), tx.year_bin(F.col("year")).alias("year_bin"))
    return crosstab.fold_profile(m, C.CLASSES, views.CONTINENTS[:-1], C.YEAR_BINS)


@query("a05_class_shares", """
    SELECT c.class, coalesce(n, 0) AS n, round(coalesce(n, 0) / (SELECT count(*) FROM meta), 6) AS share
    FROM (SELECT unnest(['DENV1','DENV2','DENV3','DENV4','DENV5']) AS class) c LEFT JOIN (SELECT class, count(*) AS n FROM meta GROUP BY class) m USING (class)""", ("meta",))
def class_shares(spark, sf):
    return crosstab.class_shares(views.meta(spark, sf), "class", [*C.CLASSES, "DENV5"]).withColumn("share", F.round("share", 6))


@query("a51_class_weights", """
    SELECT label, count(*) AS n, round(1 - count(*) / (SELECT count(*) FROM meta), 6) AS weight FROM meta GROUP BY label""", ("meta",))
def class_weights(spark, sf):
    return crosstab.class_weights(views.meta(spark, sf), "label").withColumn("weight", F.round("weight", 6))


@query("a12_feature_description", """
    WITH f AS (SELECT class, length(sequence)::DOUBLE AS sequence_length, length(sequence) - length(translate(sequence, 'ACGT', '')) AS acgt,
        length(sequence) - length(translate(sequence, 'GC', '')) AS gc, length(sequence) - length(replace(sequence, 'N', '')) AS n FROM seq),
    u AS (SELECT class, 'sequence_length' AS feature, sequence_length AS v FROM f UNION ALL SELECT class, 'n_fraction', n / sequence_length FROM f
      UNION ALL SELECT class, 'gc_fraction', CASE WHEN acgt > 0 THEN gc / acgt ELSE 0 END FROM f)
    SELECT class, feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, round(min(v), 6) AS min,
      round(quantile_cont(v, 0.25), 6) AS q25, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.75), 6) AS q75, round(max(v), 6) AS max
    FROM u GROUP BY class, feature""", ("seq",))
def feature_description(spark, sf):
    from strainlens.operators.metrics import describe_features
    f = sq.composition(views.sequences(spark, sf).select("class", "sequence"))
    out = describe_features(f, "class", ["sequence_length", "n_fraction", "gc_fraction"])
    return out.select("class", "feature", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "min", "q25", "median", "q75", "max")])
