"""Scans and sinks: FASTA, cluster listings, split tables, predictions, runs,
coordinates, reports.  Each query writes data derived from the given tables to
the shared scratch folder and reads it back through the scan under test."""
from __future__ import annotations

from pyspark.sql import functions as F

from strainlens import constants as C
from strainlens.functions import ranking as rk
from strainlens.functions import sequence as sq
from strainlens.operators import checks, crosstab, joins
from strainlens.plans import views
from strainlens.plans.catalog_metrics import rounded
from strainlens.plans.registry import query
from strainlens.session import cut_lineage, open_files, scratch_path
from strainlens.sources import clusters, fasta, predictions, reports
from strainlens.sources import splits as split_files

# predictions that one task of a join or sort holds
ROWS_A_TASK = 1_500_000
FILES = [(f"{lang}.fasta", c) for lang, c in zip(views.LANG_FILES, C.CLASSES)]


def fasta_folder(spark, sf):
    """Documents as FASTA text, one folder per file name."""
    path = scratch_path(spark, "fasta")
    s = views.sequences(spark, sf)
    # raw text keeps its own line breaks and blanks
    text = F.concat(F.lit(">"), "header", F.lit("\n"), "raw")
    s.select(text.alias("value"), "file").write.mode("overwrite").partitionBy("file").text(path)
    return path


def scan(spark, sf):
    """Records with ``source_file`` taken from the folder name."""
    r = fasta.read_fasta(spark, fasta_folder(spark, sf) + "/*/", strict=True)
    return r.withColumn("source_file", F.regexp_extract("file_path", r"file=([^/]+)/", 1))


@query("s01_fasta_scan", """
    SELECT file AS source_file, header, CASE WHEN header LIKE '% %' THEN split_part(header, ' ', 1) ELSE header END AS record_id, length(sequence) AS n, md5(sequence) AS seq_md5 FROM seq""", ("seq",))
def fasta_scan(spark, sf):
    return scan(spark, sf).select("source_file", "header", "record_id", F.length("sequence").cast("bigint").alias("n"), F.md5(F.col("sequence").cast("binary")).alias("seq_md5"))


@query("s01_fasta_problems", "SELECT file AS source_file, count(*) AS n_records, 0::BIGINT AS n_problems FROM seq GROUP BY file", ("seq",))
def fasta_problems(spark, sf):
    r = scan(spark, sf)
    bad = fasta.fasta_problems(r).withColumn("source_file", F.regexp_extract("file_path", r"file=([^/]+)/", 1)).groupBy("source_file").agg(F.count(F.lit(1)).alias("n_problems"))
    n = r.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_records"))
    return n.join(bad, "source_file", "left").na.fill(0, ["n_problems"])


@query("s02_global_index", """
    SELECT class, min(i) AS first_index, max(i) AS last_index, count(*) AS n, count(DISTINCT i) AS n_distinct FROM (
      SELECT class, row_number() OVER (ORDER BY class, pos) - 1 AS i FROM seq) GROUP BY class""", ("seq",))
def global_index(spark, sf):
    r = fasta.with_global_index(scan(spark, sf), FILES, by="source_file")
    return r.groupBy("class").agg(F.min("index").alias("first_index"), F.max("index").alias("last_index"), F.count(F.lit(1)).alias("n"), F.countDistinct("index").alias("n_distinct"))


@query("s03_fasta_wrap", r"""
    SELECT pos, md5('>' || header || chr(10) || rtrim(regexp_replace(sequence, '(.{80})', '\1' || chr(10), 'g'), chr(10))) AS record_md5 FROM seq""", ("seq",))
def fasta_wrap(spark, sf):
    s = views.sequences(spark, sf)
    return s.select("pos", F.md5(sq.wrap_fasta(F.col("header"), F.col("sequence")).cast("binary")).alias("record_md5"))


@query("s03_fasta_round_trip", "SELECT header, md5(sequence) AS seq_md5 FROM seq", ("seq",))
def fasta_round_trip(spark, sf):
    path = scratch_path(spark, "wrapped")
    fasta.write_fasta(views.sequences(spark, sf), path, partition="class")
    return fasta.read_fasta(spark, path + "/*/").select("header", F.md5(F.col("sequence").cast("binary")).alias("seq_md5"))


def members(spark, sf):
    m = views.meta(spark, sf)
    first = m.groupBy("class", "cluster_id").agg(F.min("idx").alias("_rep"), F.count(F.lit(1)).alias("cluster_size"))
    rows = m.select("class", "cluster_id", "idx").join(first, ["class", "cluster_id"])
    return rows.select("class", "cluster_id", "cluster_size", F.concat(F.lit("v"), "_rep").alias("representative"), F.concat(F.lit("v"), "idx").alias("sequence_id"),
                       (F.col("idx") == F.col("_rep")).alias("is_representative"))


_MEMBERS = """
    WITH r AS (SELECT class, cluster_id, min(idx) AS rep, count(*) AS n FROM meta GROUP BY ALL)"""


def listing(spark, sf):
    path = scratch_path(spark, "listing")
    clusters.write_listing(members(spark, sf), path)
    m = clusters.read_listing(spark, path + "/*/")
    return m.withColumn("class", F.regexp_extract("file_path", r"class=([^/]+)/", 1))


@query("s04_cluster_listing", _MEMBERS + """
    SELECT m.class, m.cluster_id, 'v' || idx AS sequence_id, idx = rep AS is_representative FROM meta m JOIN r ON m.class = r.class AND m.cluster_id = r.cluster_id""", ("meta",))
def cluster_listing(spark, sf):
    return listing(spark, sf).select("class", "cluster_id", "sequence_id", "is_representative")


@query("s04_listing_summary", _MEMBERS + " SELECT class, cluster_id, n AS size, 'v' || rep AS representative FROM r", ("meta",))
def listing_summary(spark, sf):
    return clusters.listing_summary(listing(spark, sf))


@query("s05_membership_table", _MEMBERS + """
    SELECT m.class, m.cluster_id, max(n) AS cluster_size, count(*) AS n_members, min('v' || idx) AS first_member, max('v' || idx) AS last_member, count(*) FILTER (idx = rep) AS n_representatives
    FROM meta m JOIN r ON m.class = r.class AND m.cluster_id = r.cluster_id GROUP BY m.class, m.cluster_id""", ("meta",))
def membership_table(spark, sf):
    path = scratch_path(spark, "membership")
    clusters.write_membership(members(spark, sf), path)
    m = clusters.read_membership(spark, path)
    return m.groupBy("class", "cluster_id").agg(F.max("cluster_size").alias("cluster_size"), F.count(F.lit(1)).alias("n_members"), F.min("sequence_id").alias("first_member"),
                                                F.max("sequence_id").alias("last_member"), F.sum("is_representative").alias("n_representatives"))


@query("s06_delimited_sinks", """
    SELECT continent, count(*) AS n, count(year) AS n_year, CAST(sum(year) AS BIGINT) AS year_sum FROM meta GROUP BY continent""", ("meta",))
def delimited_sinks(spark, sf):
    path = scratch_path(spark, "table")
    m = views.meta(spark, sf).select("idx", "continent", "year")
    reports.write_delimited(m, path, "\t", "NA")
    back = reports.read_delimited(spark, path, m.schema, "\t", "NA")
    return back.groupBy("continent").agg(F.count(F.lit(1)).alias("n"), F.count("year").alias("n_year"), F.sum("year").alias("year_sum"))


_SPLIT_CASE = "CASE idx % 10 WHEN 0 THEN 'val' WHEN 1 THEN 'test' ELSE 'train' END"


@query("s07_split_long", f"SELECT 'fold_' || (cluster_id % 5 + 1) AS fold, {_SPLIT_CASE} AS split, idx AS \"index\" FROM meta", ("meta",))
def split_long(spark, sf):
    name = views.pick([" Valid", "TE", "training", "tr", "train", "Train ", "tr", "train", "training", "tr"], F.col("idx") % 10)
    m = views.meta(spark, sf).select(F.concat(F.lit("fold_"), F.col("cluster_id") % 5 + 1).alias("fold_id"), F.col("idx").alias("sample_idx"), name.alias("set"))
    path = scratch_path(spark, "split-long")
    reports.write_delimited(m, path)
    return split_files.read_split_csv(spark, path)


def wide_splits(spark, sf):
    """Folds as list cells; a large fold takes several rows of bounded cells."""
    i = F.col("idx")
    m = views.meta(spark, sf).select("idx", F.concat(F.lit("fold_"), F.col("cluster_id") % 5 + 1).alias("fold"), F.expr("idx div 1000").alias("chunk"))
    def cell(cond):
        return F.sort_array(F.collect_list(F.when(cond, i)))
    return m.groupBy("fold", "chunk").agg(cell(i % 10 > 1).alias("train_idx"), cell(i % 10 == 0).alias("val_idx"), cell(i % 10 == 1).alias("test_idx")).drop("chunk")


@query("s07_split_wide", f"SELECT 'fold_' || (cluster_id % 5 + 1) AS fold, {_SPLIT_CASE} AS split, idx AS \"index\" FROM meta", ("meta",))
def split_wide(spark, sf):
    w = wide_splits(spark, sf)
    text = lambda c, l, r, sep: F.concat(F.lit(l), F.array_join(c, sep), F.lit(r))
    path = scratch_path(spark, "split-wide")
    reports.write_delimited(w.select("fold", text("train_idx", "[", "]", ", ").alias("train_idx"), text("val_idx", "", "", ";").alias("val_idx"), text("test_idx", "(", ")", " ").alias("test_idx")), path)
    return split_files.read_split_csv(spark, path)


@query("s07_split_json", f"SELECT 'fold_' || (cluster_id % 5 + 1) AS fold, {_SPLIT_CASE} AS split, idx AS \"index\" FROM meta", ("meta",))
def split_json(spark, sf):
    path = scratch_path(spark, "split-json")
    split_files.write_split_json(split_files.canonical(wide_splits(spark, sf)), path, cell=1000)
    return split_files.read_split_json(spark, path, lines=True)


@query("s08_recovered_predictions", """
    SELECT protocol, model, "index", fold, y_true, y_pred, CASE WHEN model = 'm1' THEN 'prediction_file' ELSE 'split_file_fallback' END AS index_source FROM pred""", ("pred",))
def recovered_predictions(spark, sf):
    records = views.prediction_records(spark, sf)
    order = rk.with_row_number(records.select("protocol", "fold", "index"), ["protocol", "fold"], [F.col("index")], "ordinal")
    # the stored order of the test splits, read by the writer, by the lengths and by the recovery
    order = cut_lineage(order, "test-order")
    tasks = -(-order.count() * len(views.MODELS) // ROWS_A_TASK) + 1
    # the legacy files: records meet their ordinals before their models become rows
    keys = ["index", "fold", "protocol"]
    numbered = predictions.dealt(records, keys, tasks).join(predictions.dealt(order, keys, tasks).hint("shuffle_hash"), keys)
    stored = views.model_rows(numbered, [m for m in views.MODELS if m != "m1"]).select("protocol", "model", "fold", "y_true", "y_pred", "ordinal")
    path = scratch_path(spark, "legacy-predictions")
    with open_files(spark):
        stored.write.mode("overwrite").partitionBy("protocol", "model").parquet(path)
    legacy = spark.read.schema("fold string, y_true int, y_pred int, ordinal bigint, protocol string, model string").parquet(path)
    found = predictions.recover_index(legacy, order, tasks).drop("ordinal")
    now = views.predictions(spark, sf).select("protocol", "model", "fold", "index", "y_true", "y_pred").filter(F.col("model") == "m1").withColumn("index_source", F.lit("prediction_file"))
    return predictions.unique_out_of_fold(now.unionByName(found.select(*now.columns)), tasks)


@query("s09_prediction_sink", """
    SELECT protocol, model, count(*) AS n, count(DISTINCT fold) AS n_folds, CAST(sum((y_true = y_pred)::INTEGER) AS BIGINT) AS n_correct, round(sum(CASE WHEN y_pred = 0 THEN 0.7 ELSE 0.1 END), 6)::DOUBLE AS prob_0_sum
    FROM pred GROUP BY protocol, model""", ("pred",))
def prediction_sink(spark, sf):
    p = views.predictions(spark, sf)
    prob = F.array(*[F.when(F.col("y_pred") == c, 0.7).otherwise(0.1) for c in range(4)])
    path = scratch_path(spark, "predictions")
    predictions.write_predictions(p.withColumn("prob", prob), path)
    r = predictions.read_predictions(spark, path)
    out = r.groupBy("protocol", "model").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("fold").alias("n_folds"), F.count_if(F.col("y_true") == F.col("y_pred")).alias("n_correct"), F.sum("prob_0").alias("prob_0_sum"))
    return rounded(out, "prob_0_sum")


@query("s10_run_summaries", """
    SELECT model, CAST(fold AS VARCHAR) AS fold, accuracy, CASE WHEN fold % 3 <> 0 THEN macro_f1 END AS f1_0, balanced_accuracy AS f1_1, 'gpu' || fold AS device, round(accuracy * 100, 6) AS total_time_sec FROM foldm""", ("foldm",))
def run_summaries(spark, sf):
    f = views.fold_metrics(spark, sf)
    one = lambda v: F.struct(v.alias("f1-score"), F.lit(10.0).alias("support"))
    report = F.when(F.col("fold") % 3 != 0, F.create_map(F.lit("0"), one(F.col("macro_f1")), F.lit("1"), one(F.col("balanced_accuracy")))).otherwise(F.create_map(F.lit("1"), one(F.col("balanced_accuracy"))))
    item = F.struct(
        F.col("fold").cast("string").alias("fold"),
        F.struct("accuracy", report.alias("classification_report"), F.array(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(1))).alias("confusion_matrix")).alias("test"),
        F.struct((F.col("accuracy") * 100).alias("total_time_sec"), F.lit(5.0).alias("samples_per_sec")).alias("test_timing"), F.struct(F.concat(F.lit("gpu"), "fold").alias("name")).alias("device_info"))
    # one JSON list per model: its folds, a handful of rows
    docs = f.groupBy("model").agg(F.to_json(F.collect_list(item)).alias("value"))
    path = scratch_path(spark, "runs")
    docs.repartition("model").write.mode("overwrite").partitionBy("model").text(path)
    out = reports.read_runs(spark, path, ["0", "1"])
    return rounded(out.select("model", "fold", "accuracy", "f1_0", "f1_1", "device", "total_time_sec"), "total_time_sec")


@query("s12_profile_compaction", """
    SELECT fold, 'test' AS subset, 'gxi' AS score_type, label, count(*) AS n, CAST(sum(batch) AS BIGINT) AS batch_sum, CAST(sum(tgt) AS BIGINT) AS target_sum FROM (
      SELECT fold, class AS label, sample // 32 AS batch, (class + 1) % 4 AS tgt FROM prof) GROUP BY ALL""", ("prof",))
def profile_compaction(spark, sf):
    p = views.profiles(spark, sf)
    s, c = F.col("sample"), F.col("class")
    name = F.concat(F.lit("test_batch"), F.expr("sample div 32"), F.lit("_sample"), s % 32, F.lit("_class"), c, F.lit("_target"), (c + 1) % 4, F.lit("_pred"), c, F.lit("_gxi.npy"))
    path = scratch_path(spark, "compact")
    singles = p.select("fold", "scores", name.alias("file"))
    reports.compact_profiles(singles, path)
    reports.compact_profiles(singles, path)  # kept: the table exists
    r = spark.read.schema("file string, scores array<double>, batch_idx bigint, sample_idx bigint, label int, target int, pred int, score_type string, subset string, fold int").parquet(path)
    return r.groupBy("fold", "subset", "score_type", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("batch_idx").alias("batch_sum"), F.sum("target").alias("target_sum"))


PRODUCTS = ["anchored capsid protein ancC", "Membrane glycoprotein precursor prM", "envelope protein E", "non-structural protein NS1", "putative NS2A protein", "NS3", "protein 2K",
            "RNA-dependent RNA polymerase NS5", "hypothetical protein"]
_PROD_REGION = ["C", "prM", "E", "NS1", "NS2A", "NS3", "2K", "NS5", None]


def features(spark, sf):
    """A feature table per order: one feature per line item."""
    li = views.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
    start = F.col("l_linenumber") * 100 + F.col("l_suppkey") % 10
    f = li.select(
        F.col("l_orderkey").alias("genome"), F.when((F.col("l_partkey") + F.col("l_suppkey")) % 5 == 0, "CDS").otherwise("mat_peptide").alias("type"),
        views.pick(PRODUCTS, F.col("l_partkey") % 9).alias("product"), start.cast("bigint").alias("start"), (start + F.col("l_quantity").cast("int")).cast("bigint").alias("end"),
        F.col("l_linenumber").alias("feature_no"))
    g = views.table(spark, sf, "orders").select(F.col("o_orderkey").alias("genome"), F.lit(1000).cast("bigint").alias("genome_length"))
    return f, g


_FEATURES = f"""
    WITH f AS (SELECT l_orderkey AS genome, CASE WHEN (l_partkey + l_suppkey) % 5 = 0 THEN 'CDS' ELSE 'mat_peptide' END AS type, ({[x for x in PRODUCTS]})[l_partkey % 9 + 1] AS product,
        (['C', 'prM', 'E', 'NS1', 'NS2A', 'NS3', '2K', 'NS5', NULL])[l_partkey % 9 + 1] AS region, l_linenumber * 100 + l_suppkey % 10 AS s, l_linenumber * 100 + l_suppkey % 10 + CAST(l_quantity AS INTEGER) AS e, l_linenumber AS n FROM lineitem),
    b AS (SELECT genome, region, s, e FROM (SELECT *, row_number() OVER (PARTITION BY genome, region ORDER BY n, s, e, product) AS rn FROM f WHERE type = 'mat_peptide' AND region IS NOT NULL) WHERE rn = 1),
    x AS (SELECT genome, min(s) AS first_s, arg_max(e, s * 100000 + e) AS last_e FROM b GROUP BY genome),
    rt AS (SELECT * FROM b UNION ALL SELECT genome, '5''UTR', 1, first_s - 1 FROM x WHERE first_s > 1 UNION ALL SELECT genome, '3''UTR', last_e + 1, 1000 FROM x WHERE last_e < 1000)"""
_ORDER = "list_position(['5''UTR', 'C', 'prM', 'E', 'NS1', 'NS2A', 'NS2B', 'NS3', 'NS4A', '2K', 'NS4B', 'NS5', '3''UTR'], region) - 1"


@query("s15_region_table", _FEATURES + f" SELECT genome, region, CAST(s AS BIGINT) AS \"start\", CAST(e AS BIGINT) AS \"end\", CAST(e - s + 1 AS BIGINT) AS length_nt, CAST({_ORDER} AS INTEGER) AS region_order FROM rt")
def region_table(spark, sf):
    f, g = features(spark, sf)
    return joins.region_table(f, g, "genome").drop("product")


_FILLED = """
    , z AS (SELECT genome, region, CASE WHEN region = '5''UTR' THEN 0 ELSE s END AS s, e FROM rt), gs AS (SELECT DISTINCT genome FROM z), w AS (
      SELECT * FROM z UNION ALL SELECT genome, '5''UTR', 0, 78 FROM gs ANTI JOIN (SELECT genome FROM z WHERE region = '5''UTR') q USING (genome)
      UNION ALL SELECT gs.genome, '3''UTR', coalesce(n.e, 10255) + 1, 11195 FROM gs LEFT JOIN (SELECT genome, e FROM z WHERE region = 'NS5') n ON n.genome = gs.genome ANTI JOIN (SELECT genome FROM z WHERE region = '3''UTR') q ON q.genome = gs.genome),
    hv AS (SELECT genome, list(region) AS had FROM w GROUP BY genome),
    ms AS (SELECT genome, array_to_string(list_filter(['5''UTR', 'C', 'prM', 'E', 'NS1', 'NS2A', 'NS2B', 'NS3', 'NS4A', '2K', 'NS4B', 'NS5', '3''UTR'], lambda x: NOT list_contains(had, x)), ',') AS missing FROM hv)"""


@query("s14_region_bounds", _FEATURES + _FILLED + f"""
    SELECT w.genome, region, CAST({_ORDER} AS INTEGER) AS region_order, CAST(s AS BIGINT) AS "start", CAST(e AS BIGINT) AS "end", missing FROM w JOIN ms ON w.genome = ms.genome""")
def region_bounds(spark, sf):
    f, g = features(spark, sf)
    return joins.region_bounds(joins.region_table(f, g, "genome"), "genome", strict=False)


def coordinates(spark, sf):
    """13 regions per class over the shortest record of the class."""
    s = views.sequences(spark, sf).groupBy("class").agg(F.min(F.length("sequence")).alias("n"))
    r = F.explode(F.array(*[F.struct(F.lit(x).alias("region"), F.lit(i).alias("i")) for i, x in enumerate(C.REGIONS)]))
    return s.select("class", "n", r.alias("r")).select("class", "r.region", F.expr("(r.i * (n + 20)) div 13 + 1").alias("start"), F.expr("((r.i + 1) * (n + 20)) div 13").alias("end"))


_PIECES = """
    WITH n AS (SELECT class, min(length(sequence)) AS n FROM seq GROUP BY class),
    co AS (SELECT class, region, (region_order * (n + 20)) // 13 + 1 AS s, ((region_order + 1) * (n + 20)) // 13 AS e FROM n, regions),
    pc AS (SELECT seq.class, record_id, pos, region, s, e, substr(sequence, s, e - s + 1) AS piece FROM seq JOIN co USING (class))"""


def pieces(spark, sf):
    s = views.sequences(spark, sf).select("class", "record_id", "sequence")
    return joins.region_pieces(s, coordinates(spark, sf), ["class"])


@query("s16_region_pieces", _PIECES + " SELECT class || '|' || record_id || '|' || region || '|' || s || '-' || e AS fasta_id, region, md5(piece) AS piece_md5 FROM pc", ("seq", "regions"))
def region_pieces(spark, sf):
    return pieces(spark, sf).select("fasta_id", "region", F.md5(F.col("piece").cast("binary")).alias("piece_md5"))


@query("s16_region_files", _PIECES + " SELECT replace(region, '''', '') AS region, count(*) AS n, CAST(sum(length(piece)) AS BIGINT) AS symbols FROM pc GROUP BY region", ("seq", "regions"))
def region_files(spark, sf):
    path = scratch_path(spark, "regions")
    p = pieces(spark, sf).withColumn("region", F.regexp_replace("region", "'", ""))
    fasta.write_fasta(p, path, "fasta_id", "piece", "region")
    r = fasta.read_fasta(spark, path + "/*/").withColumn("region", F.regexp_extract("file_path", r"region=([^/]+)/", 1))
    return r.groupBy("region").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("sequence")).alias("symbols"))


@query("f06_minimum_region_length", _PIECES + " SELECT region, count(*) FILTER (length(piece) >= (e - s + 1) * 0.65) AS written, count(*) FILTER (length(piece) < (e - s + 1) * 0.65) AS skipped_short FROM pc GROUP BY region", ("seq", "regions"))
def minimum_region_length(spark, sf):
    p = pieces(spark, sf)
    return checks.minimum_length_counts(p, "region", "piece", F.col("end") - F.col("start") + 1)


@query("s17_report_tables", """
    SELECT 'class_by_continent' AS "table", count(DISTINCT continent) AS n_rows FROM meta UNION ALL SELECT 'class_shares', 4 UNION ALL SELECT 'class_weights', count(DISTINCT label) FROM meta""", ("meta",))
def report_tables(spark, sf):
    m = views.meta(spark, sf)
    root = scratch_path(spark, "report")
    tables = {"class_by_continent": crosstab.cross_tab(m, "continent", "class", C.CLASSES), "class_shares": crosstab.class_shares(m, "class", C.CLASSES), "class_weights": crosstab.class_weights(m, "label")}
    manifest = reports.write_report(tables, root, {"seed": C.SEED})
    reports.export_report(spark, root, root + "-csv", list(tables), ";")
    return manifest.select("table", "n_rows")
