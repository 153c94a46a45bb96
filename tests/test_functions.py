import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strainlens.functions import adjust, annotate, tails
from strainlens.functions import sequence as sq
from strainlens.functions import text as tx


def one(df, col):
    return [r[0] for r in df.select(col).collect()]


def test_composition_of_a_mixed_sequence(spark):
    row = sq.composition(spark.createDataFrame([("ACGTNNRY-.",)], "sequence string")).collect()[0]
    assert (row.sequence_length, row.acgt_count, row.n_count, row.iupac_count, row.gap_count, row.non_acgt_count) == (10, 4, 2, 2, 2, 6)
    assert row.gc_fraction == 0.5 and row.other_count == 0
    empty = sq.composition(spark.createDataFrame([("",)], "sequence string")).collect()[0]
    assert empty.gc_fraction == 0 and empty.n_fraction == 0


def test_holm_is_monotone_and_bounded(spark):
    df = spark.createDataFrame([("f", 1, .01), ("f", 2, .04), ("f", 3, .03), ("g", 4, .9), ("f", 5, None)], "fam string, i int, p double")
    got = {r.i: r.h for r in adjust.holm(df, ["fam"], "p", "h", ["i"]).collect()}
    assert got == {1: pytest.approx(.03), 2: pytest.approx(.06), 3: pytest.approx(.06), 4: pytest.approx(.9), 5: None}


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(1, .01), (2, .04), (3, .03), (4, .005)], "i int, p double")
    got = {r.i: r.q for r in adjust.benjamini_hochberg(df, [], "p", "q", ["i"]).collect()}
    assert got == {4: pytest.approx(.02), 1: pytest.approx(.02), 3: pytest.approx(.04), 2: pytest.approx(.04)}


@pytest.mark.parametrize("x, df, p", [(3.841459, 1, .05), (5.991465, 2, .05), (7.814728, 3, .05), (11.344867, 3, .01), (9.487729, 4, .05), (15.086272, 5, .01)])
def test_chi_square_tail_against_tables(x, df, p):
    assert tails.chi2_tail(x, df) == pytest.approx(p, rel=1e-5)


def test_exact_tails():
    assert tails.binomial_half_two_sided(1, 3) == 1.0
    for k, n in [(2, 12), (0, 7), (40, 100), (5, 40)]:
        assert tails.binomial_half_two_sided(k, n) == pytest.approx(min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n), rel=1e-9)
    # published two-sided values: complete separation of 3 and 3, five same signs
    assert tails.mann_whitney_exact(0, 3, 3) == pytest.approx(0.1)
    assert tails.mann_whitney_exact(9, 3, 3) == pytest.approx(0.1)
    assert tails.signed_rank_exact(15, 0, [1] * 5) == pytest.approx(0.0625)


def test_text_rules(spark):
    df = spark.createDataFrame([
        ("a|META_YEAR={2010}|META_COUNTRY={ DRC }", "Democratic Republic of the Congo", 2010),
        ("a|META_COUNTRY=Sri Lanka META_SOURCE=x|META_YEAR=1999", "Sri Lanka", 1999),
        ("a|META_COUNTRY=not found;x", "Unknown", None),
        ("nothing", "Unknown", None),
    ], "h string, c string, y int")
    for r in df.select("*", tx.meta_country(F.col("h")).alias("gc"), tx.meta_year(F.col("h")).alias("gy")).collect():
        assert (r.gc, r.gy) == (r.c, r.y)


def test_years_and_countries_of_sources(spark):
    df = spark.createDataFrame([("hDenV1/Cote_d_Ivoire/x-1987/2010|EPI|2011-05", )], "h string")
    h = F.col("h")
    assert one(df, tx.slash_country(h)) == ["Cote d Ivoire"] and one(df, tx.last_year(h)) == ["2011"]
    free = spark.createDataFrame([("x120055 from_Cote d'Ivoire 1997 2003",), ("nigeria 20011",), ("USA peru",)], "h string")
    assert one(free, tx.named_country(h)) == ["Cote D'Ivoire", None, "Peru"]
    assert one(free, tx.first_year(h)) == ["1997", None, None]


def test_class_rules(spark):
    df = spark.createDataFrame([("x hdenv3/y",), ("SEROTYPE: 2",), ("none",)], "t string")
    assert one(df, tx.infer_class(F.col("t"), "header")) == ["DENV3", None, None]
    assert one(df, tx.infer_class(F.col("t"), "long")) == [None, "DENV2", None]
    with pytest.raises(Exception, match="no class"):
        df.select(tx.infer_class(F.col("t"), "file", strict=True)).collect()


def test_bins_and_labels(spark):
    df = spark.createDataFrame([(1999,), (2006,), (2012,), (None,)], "y int")
    assert one(df, tx.time_bin(F.col("y"), F.lit(2013))) == ["<2006", "2006-2010", "2011-2013", "Unknown"]
    lab = spark.createDataFrame([("DENV-1",), ("DENV2",), ("3.0",), ("other",)], "s string")
    assert one(lab, tx.normalise_class_label(F.col("s"))) == ["1", "2", "3", "other"]


def test_annotation(spark):
    df = spark.createDataFrame([(0.0005,), (0.005,), (0.05,), (None,)], "p double")
    assert one(df, annotate.stars(F.col("p"))) == ["***", "**", "", ""]
    assert one(df, annotate.stars(F.col("p"), "ns")) == ["***", "**", "ns", ""]
    assert one(df, annotate.p_text(F.col("p"))) == ["<0.001", "0.005", "0.050", ""]
    v = spark.createDataFrame([(0.2, -0.1, 0.5, 0.01), (0.0, -0.1, 0.1, 0.5)], "d double, lo double, hi double, p double")
    assert one(v, annotate.verdict(F.col("d"), F.col("lo"), F.col("hi"), F.col("p"))) == [
        "No statistically supported accuracy difference", "No observed accuracy difference"]


def test_exact_rank_tests_with_ties_enumerate_all_arrangements():
    import itertools
    import random

    rng = random.Random(1)
    for _ in range(25):
        values = [rng.randint(0, 4) for _ in range(rng.randint(4, 9))]
        n1 = rng.randint(1, len(values) - 1)
        u_of = lambda x, y: sum((a > b) + .5 * (a == b) for a in x for b in y)
        all_u = []
        for pick in itertools.combinations(range(len(values)), n1):
            x, y = [values[i] for i in pick], [v for i, v in enumerate(values) if i not in pick]
            all_u.append(u_of(x, y))
        u = all_u[0]
        ties = [values.count(v) for v in sorted(set(values))]
        want = min(1, 2 * min(sum(w <= u for w in all_u), sum(w >= u for w in all_u)) / len(all_u))
        assert tails.mann_whitney_exact_tied(u, n1, ties) == pytest.approx(want)
        if max(ties) == 1:
            assert tails.mann_whitney_exact(u, n1, len(values) - n1) == pytest.approx(want)
        sizes = sorted(rng.randint(1, 4) for _ in values)
        ranks = [sum(s < t for s in sizes) + (sizes.count(t) + 1) / 2 for t in sizes]
        signs = [rng.choice([1, -1]) for _ in sizes]
        plus, total = sum(r for r, s in zip(ranks, signs) if s > 0), sum(ranks)
        sums = [sum(r for r, s in zip(ranks, m) if s > 0) for m in itertools.product([1, -1], repeat=len(ranks))]
        want = min(1, 2 * np.mean([w <= min(plus, total - plus) for w in sums]))
        assert tails.signed_rank_exact(plus, total - plus, [sizes.count(t) for t in sorted(set(sizes))]) == pytest.approx(want)


def test_normal_forms_approach_the_exact_ones():
    assert tails.signed_rank_normal(250, 215, 30, 0) == pytest.approx(tails.signed_rank_exact(250, 215, [1] * 30), abs=.02)
    assert tails.mann_whitney_normal(180, 20, 20, 0) == pytest.approx(tails.mann_whitney_exact(180, 20, 20), abs=.01)
    assert np.isnan(tails.signed_rank_exact(0, 0, []))
    with pytest.raises(ValueError):
        tails.signed_rank_udf("auto")
