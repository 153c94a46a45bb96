"""Stand-in views over the given tables (record metadata, clusters,
predictions, sequences, profiles, alignments), all lazy DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strainlens.constants import REGIONS, UNKNOWN

PROTOCOLS = ["cluster", "geographical", "temporal"]
MODELS = [f"m{i}" for i in range(1, 8)]
STRATEGIES = [1, 2, 3]
CONTINENTS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", UNKNOWN]
LANG_FILES = ["en", "fr", "de", "es"]
WIDTH = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# rows of a scan that one task expands into predictions, scores or features
ROWS_A_TASK = 150_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows spread over all cores, and over more tasks where a split holds very many narrow rows.

    The views expand a row many times, so a task's memory goes with its rows,
    not with the bytes of its split.  A large table with enough splits passes
    through unchanged; the count reads file footers only.
    """
    tasks = tasks_for(df)
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks, key)


def tasks_for(df: DataFrame) -> int:
    """Tasks for the rows of a scan, one per core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK))


def pick(values: list[str], pos) -> F.Column:
    """Literal list element by 0-based position."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (pos + 1).cast("int"))


def meta(spark: SparkSession, sf: str) -> DataFrame:
    """One labelled record per order: class, country, continent, year, header."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf, "region").select("r_regionkey", "r_name")
    joined = (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .join(r, n.n_regionkey == r.r_regionkey)
        # behind the joins: a shuffled join deals few tasks, as its rows are narrow until the views expand them
        .repartition(tasks_for(o), "o_orderkey")
    )
    d = F.col("o_orderkey") % 10
    label = F.when(d < 4, 0).when(d < 7, 1).when(d < 9, 2).otherwise(3)
    unknown = F.col("o_custkey") % 37 == 0
    base = joined.select(
        F.col("o_orderkey").alias("idx"),
        label.cast("int").alias("label"),
        F.concat(F.lit("DENV"), label + 1).alias("class"),
        F.when(unknown, F.lit(UNKNOWN)).otherwise(F.col("n_name")).alias("country"),
        F.when(unknown, F.lit(UNKNOWN)).otherwise(F.col("r_name")).alias("continent"),
        F.when(F.col("o_custkey") % 41 == 0, F.lit(None)).otherwise(F.year("o_orderdate")).cast("int").alias("year"),
        F.col("o_custkey").alias("cluster_id"),
    )
    idx = F.col("idx")
    token = (
        F.when(idx % 7 == 0, F.concat(F.lit(" hDenV"), F.col("label") + 1))
        .when(idx % 11 == 0, F.concat(F.lit(" denv"), idx % 4 + 1))
        .otherwise("")
    )
    year_part = (
        F.when(F.col("year").isNull(), "")
        .when(idx % 3 == 0, F.concat(F.lit("|META_YEAR={"), F.col("year"), F.lit("}")))
        .otherwise(F.concat(F.lit("|META_YEAR="), F.col("year")))
    )
    shown = F.when(
        F.col("country") == UNKNOWN, pick(["unknown", "NaN", "un", "Not Found", "NONE", " "], idx % 6)
    ).otherwise(F.col("country"))
    country_part = (
        F.when(idx % 3 == 0, F.concat(F.lit("|META_COUNTRY={"), shown, F.lit("}")))
        .when(idx % 3 == 1, F.concat(F.lit("|META_COUNTRY="), shown, F.lit(" META_SOURCE=b")))
        .otherwise(F.concat(F.lit("|META_COUNTRY="), shown, F.lit(";x")))
    )
    return base.withColumn(
        "header",
        F.concat(F.lit("v"), F.lpad(idx.cast("string"), 8, "0"), token, year_part, country_part),
    )


def _fold(p: F.Column) -> F.Column:
    """Held-out fold of a record under protocol number ``p``."""
    return (
        F.when(p == 0, F.concat(F.lit("fold_"), F.col("cluster_id") % 5 + 1))
        .when(p == 1, F.col("continent"))
        .otherwise(F.coalesce((F.col("year") - F.col("year") % 2).cast("string"), F.lit(UNKNOWN)))
    )


def _y_pred(p: F.Column, m: F.Column) -> F.Column:
    """Class that model number ``m`` predicts under protocol number ``p``."""
    wrong = (F.col("idx") * 31 + m * 17 + (p - 1) * 7 + 7) % 100 < 3 + 2 * m
    return F.when(wrong, (F.col("label") + 1) % 4).otherwise(F.col("label")).cast("int")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out predictions of seven models under three split protocols."""
    m = meta(spark, sf).select("idx", "label", "class", "continent", "year", "cluster_id")
    grid = F.array(*[
        F.struct(F.lit(p).alias("p"), F.lit(name).alias("protocol"), F.lit(i + 1).alias("m"), F.lit(model).alias("model"))
        for p, name in enumerate(PROTOCOLS) for i, model in enumerate(MODELS)
    ])
    rows = m.select("*", F.explode(grid).alias("g")).select("*", "g.*").drop("g")
    return rows.select(
        "protocol", "model", F.col("m").alias("model_no"), F.col("idx").alias("index"), _fold(F.col("p")).alias("fold"),
        F.col("label").alias("y_true"),
        _y_pred(F.col("p"), F.col("m")).alias("y_pred"),
        "cluster_id",
        F.concat(F.col("class"), F.lit("::cluster_"), F.col("cluster_id")).alias("cluster_key"),
    )


def prediction_records(spark: SparkSession, sf: str) -> DataFrame:
    """Records of :func:`predictions` before models are told apart: one row per record and protocol ``p``."""
    m = meta(spark, sf).select("idx", "label", "continent", "year", "cluster_id")
    grid = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(name).alias("protocol")) for p, name in enumerate(PROTOCOLS)])
    return m.select("*", F.inline(grid)).select("p", "protocol", F.col("idx").alias("index"), _fold(F.col("p")).alias("fold"), "label")


def model_rows(records: DataFrame, models: list[str]) -> DataFrame:
    """Rows of :func:`prediction_records` as the predictions of some of the models."""
    grid = F.array(*[F.struct(F.lit(MODELS.index(model) + 1).alias("m"), F.lit(model).alias("model")) for model in models])
    rows = records.withColumnsRenamed({"index": "idx"}).select("*", F.inline(grid))
    return rows.select("*", F.col("label").alias("y_true"), _y_pred(F.col("p"), F.col("m")).alias("y_pred")).drop("p", "m", "label").withColumnRenamed("idx", "index")


def class_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Score of every class per prediction of every protocol, long."""
    p = predictions(spark, sf)
    c = F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("c")
    return p.select("protocol", "model", "model_no", "index", "y_true", "y_pred", c).select(
        "protocol", "model", "index", F.col("c").alias("class_index"),
        (F.col("y_true") == F.col("c")).cast("int").alias("positive"),
        (((F.col("index") * 13 + F.col("c") * 29 + F.col("model_no") * 7) % 1000) / 1000.0
         + (F.col("c") == F.col("y_pred")).cast("double")).alias("score"),
    )


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """One sequence record per document."""
    d = spread(table(spark, sf, "documents").select("doc_id", "text", "lang"), "doc_id")
    ascii_text = F.regexp_replace("text", r"[^\x00-\x7F]", "N")
    i = F.col("doc_id")
    lang_no = F.array_position(F.array(*[F.lit(x) for x in LANG_FILES]), F.col("lang"))
    slash_country = pick(["Brazil", "Sri_Lanka", "un", "Viet_Nam", "", "USA", "New_Caledonia"], i % 7)
    text_country = pick(["french_guiana isolate", "no place", "from Cote d'Ivoire", "INDIA strain", "peru/usa", "nigeria"], i % 6)
    slash_head = F.concat(
        F.lit("virus/"), slash_country, F.lit("/"), F.lit("d"), i,
        F.when(i % 5 == 0, F.lit("|x12345")).otherwise(F.concat(F.lit("/1987-"), 1990 + i % 30)), F.lit("|ref rest"),
    )
    text_head = F.concat(
        F.lit("d"), i, F.lit(" "), text_country,
        F.when(i % 9 == 1, F.lit(" n120055")).otherwise(F.concat(F.lit(" coll "), 1995 + i % 25, F.lit(" dep 2021"))),
    )
    return d.select(
        i.alias("pos"),
        F.concat(F.lit("d"), i).alias("record_id"),
        F.concat(F.col("lang"), F.lit(".fasta")).alias("file"),
        F.concat(F.lit("DENV"), lang_no).alias("class"),
        F.when(i % 2 == 0, "A").otherwise("B").alias("source"),
        F.when(i % 2 == 0, slash_head).otherwise(text_head).alias("header"),
        ascii_text.alias("raw"),
        F.regexp_replace(F.upper(ascii_text), r"\s+", "").alias("sequence"),
    )


def region_rows() -> list[tuple[str, int, int, int]]:
    """(region, order, start, end), half open, over the 64 positions."""
    return [(name, i, 5 * i, min(5 * i + 5, WIDTH)) for i, name in enumerate(REGIONS)]


def region_array() -> F.Column:
    return F.array(*[
        F.struct(F.lit(n).alias("region"), F.lit(o).alias("region_order"), F.lit(s).alias("start"), F.lit(e).alias("end"))
        for n, o, s, e in region_rows()
    ])


def profiles(spark: SparkSession, sf: str) -> DataFrame:
    """One score profile with its validity mask per embedding."""
    e = spread(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")
    n_valid = 64 - F.col("vec_id") % 8
    return e.select(
        F.col("vec_id").alias("sample"),
        (F.col("label") % 4).cast("int").alias("class"),
        (F.col("vec_id") % 5).cast("int").alias("fold"),
        F.transform("embedding", lambda x: x.cast("double")).alias("scores"),
        F.transform("embedding", lambda x, i: i < n_valid).alias("valid"),
    )


def strategy_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles seen by three strategies, each leaving out a third."""
    s = F.explode(F.array(*[F.lit(x) for x in STRATEGIES])).alias("strategy")
    return profiles(spark, sf).select("*", s).filter(F.col("sample") % 3 != F.col("strategy") - 1)


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Aligned symbol strings per (region, class, sequence)."""
    e = spread(table(spark, sf, "embeddings").select("vec_id", "embedding", "label"), "vec_id")
    vec = F.col("vec_id")

    def symbol(x, i):
        v = x.cast("double")
        return (
            F.when((vec + i) % 53 == 0, "N").when(F.abs(v) < 0.01, "-").when(v < -0.1, "A")
            .when(v < 0, "C").when(v < 0.1, "G").otherwise("T")
        )

    full = e.select(
        vec.alias("seq_id"),
        F.concat(F.lit("DENV"), F.col("label") % 4 + 1).alias("class"),
        F.array_join(F.transform("embedding", symbol), "").alias("symbols"),
    )
    return full.select("seq_id", "class", "symbols", F.explode(region_array()).alias("r")).select(
        "r.region", "r.region_order", "class", "seq_id",
        F.expr("substring(symbols, r.start + 1, r.end - r.start)").alias("aligned"),
    )


def fold_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Fold-level metrics of six models (one fold per ship year)."""
    li = table(spark, sf, "lineitem").select(
        "l_returnflag", "l_linestatus", "l_shipdate", "l_discount", "l_tax", "l_quantity"
    )
    return (
        li.groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("model"), F.year("l_shipdate").alias("fold")
        ).agg(
            F.round(F.avg("l_discount") * 10, 9).alias("accuracy"),
            F.round(F.avg("l_tax") * 10, 9).alias("balanced_accuracy"),
            F.round(F.avg("l_quantity") / 50, 9).alias("macro_f1"),
        )
    )
