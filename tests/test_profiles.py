"""Profiles, cuts and panels on hand-worked cases."""
import pytest
from pyspark.sql import functions as F

from strainlens import session
from strainlens.functions import sequence as sq
from strainlens.operators import profiles
from strainlens.plans import catalog_cohort  # noqa: F401
from strainlens.plans.profile_run import overall_panel
from strainlens.plans.registry import QUERIES


def samples(spark):
    rows = [(1, "x", [1.0, 2.0, 3.0, 9.0], [True, True, True, False]), (2, "x", [3.0, 0.0, 5.0], [True, False, True]), (3, "y", [2.0], [True])]
    return spark.createDataFrame(rows, "sample bigint, class string, scores array<double>, valid array<boolean>")


def test_class_profiles_are_means_over_valid_samples(spark):
    got = {(r["class"], r.pos): (r.value, r.n_valid, r.n_samples) for r in profiles.class_profile(samples(spark), ["class"]).collect()}
    assert got == {("x", 0): (2.0, 2, 2), ("x", 1): (2.0, 1, 2), ("x", 2): (4.0, 2, 2), ("x", 3): (None, 0, 1), ("y", 0): (2.0, 1, 1)}


def test_common_cut(spark):
    lengths = spark.createDataFrame([("a", "s", 7), ("a", "t", 5), ("b", "s", 0), ("b", "t", 9)], "k string, signal string, length bigint")
    assert profiles.common_cut(lengths, 60).first().cut == 5 and profiles.common_cut(lengths, 3).first().cut == 3
    assert {tuple(r) for r in profiles.common_cut(lengths, 8, ["k"]).collect()} == {("a", 5), ("b", 8)}


def test_attention_is_cut_at_the_given_length(spark):
    w = spark.createDataFrame([(1, 0, q, p // 4, p % 4, float(p + q)) for p in range(10) for q in (0, 1)], "sample int, layer int, query int, chunk bigint, key bigint, weight double")
    assert {r.pos: r.score for r in profiles.reduce_attention(w, 0, 4, "cls", 6).collect()} == {p: float(p) for p in range(6)}
    assert {r.pos: r.score for r in profiles.reduce_attention(w, 0, 4, "mean_query").collect()} == {p: p + 0.5 for p in range(10)}


def test_panels_are_cut_to_the_shorter_signal(spark):
    a = samples(spark)
    g = a.withColumn("scores", F.slice("scores", 1, 2)).withColumn("valid", F.slice("valid", 1, 2))
    got = {(r["class"], r.signal): r.n for r in overall_panel(a, g, 1, 50, ["class"]).groupBy("class", "signal").agg(F.count("*").alias("n")).collect()}
    assert got == {("x", "attention"): 2, ("x", "gradient"): 2, ("y", "attention"): 1, ("y", "gradient"): 1}
    whole = overall_panel(a, a, 1, 3).collect()
    assert sorted((r.signal, r.pos) for r in whole) == [(s, p) for s in ("attention", "gradient") for p in range(3)]
    assert {r.pos: r.value for r in whole if r.signal == "attention"} == pytest.approx({0: 0.0, 1: 0.0, 2: 1.0})


def test_one_hot_rows_are_padded(spark):
    df = spark.createDataFrame([("ACN",), ("",), ("T",)], "s string")
    got = [r[0] for r in df.select(sq.pad_one_hot(sq.one_hot(F.col("s")), F.lit(3))).collect()]
    assert got == [[[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 0]], [[0] * 4] * 3, [[0, 0, 0, 1], [0] * 4, [0] * 4]]
    assert df.select(F.size(sq.pad_one_hot(sq.one_hot(F.col("s")), F.lit(2)))).collect()[0][0] == 3


def test_one_hot_rows_are_padded_and_counted_where_they_are_made(spark):
    df = spark.createDataFrame([(1, "aCNt"), (2, ""), (3, None), (4, "TT"), (5, "é😀G"), (6, "ACGTACGT")], "i int, s string").repartition(1)
    ohe = sq.one_hot(F.col("s"))
    got = df.select("i", ohe.alias("e"), sq.pad_one_hot(ohe, 5).alias("p"), sq.pad_one_hot(ohe, F.lit(5)).alias("c"),
                    sq.encoded_length(sq.pad_one_hot(ohe, 5)).alias("n"), sq.channel_summary(ohe).alias("s")).orderBy("i").collect()
    none, a, c, g, t = [0] * 4, [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]
    assert [r.e for r in got] == [[a, c, none, t], [], None, [t, t], [none, none, g], [a, c, g, t] * 2]
    assert [r.p for r in got] == [r.c for r in got] == [[a, c, none, t, none], [none] * 5, None, [t, t] + [none] * 3, [none, none, g, none, none], [a, c, g, t] * 2]
    assert [r.n for r in got] == [5, 5, None, 5, 5, 8]
    assert [r.s and tuple(r.s) for r in got] == [
        (4, [1, 1, 0, 1], [1, 2, 0, 4]), (0, [0] * 4, [0] * 4), None, (2, [0, 0, 0, 2], [0, 0, 0, 1]), (3, [0, 0, 1, 0], [0, 0, 3, 0]), (8, [2] * 4, [1, 2, 3, 4])]


@pytest.mark.parametrize("held", [1, 1 << 20])
def test_one_hot_query_holds_few_padded_rows_at_once(spark, tmp_path, monkeypatch, held):
    rows = [(1, "a c\ngt", "en"), (2, None, "fr"), (3, "", None), (4, "T" * 9, "es"), (4, "T" * 9, "es"), (5, "éA", "xx")]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sq, "PADDED_BYTES", held)
    assert sq.padded_records(9) == max(1, held // 72)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = sorted(tuple(r) for r in QUERIES["p13_one_hot"](spark, str(tmp_path)).collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    fours = (4, 9, 0, 0, 0, 9, 1, 3, 9)
    assert got == [(1, 4, 1, 1, 1, 1, 4, 0, 9), (2, *[None] * 6, 1, None), (3, 0, 0, 0, 0, 0, 0, None, 9), fours, fours, (5, 2, 1, 0, 0, 0, 0, -1, 9)]


def test_arrow_batches_are_never_larger_than_set(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for given, inside in (("0", "7"), ("5", "5"), ("9", "7")):
        spark.conf.set(key, given)
        with session.arrow_batches(spark, 7):
            assert spark.conf.get(key) == inside
        assert spark.conf.get(key) == given
    spark.conf.set(key, before)
