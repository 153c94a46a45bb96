"""Alignment columns, pair divergence and identity on hand-worked cases."""
import math

import pytest
from pyspark.sql import functions as F

from strainlens.operators import consensus, sites


def aligned(spark):
    rows = [("r", "x", 1, "AC-N"), ("r", "x", 2, "AGTU"), ("r", "y", 3, "cC.t"), ("r", "y", 4, "CCTA")]
    return spark.createDataFrame(rows, "region string, class string, seq_id bigint, aligned string")


def test_columns_count_symbols_gaps_and_the_rest(spark):
    got = {(r["class"], r.pos): r for r in sites.column_counts(aligned(spark)).collect()}
    assert {c for c, _ in got} == {"x", "y", sites.GLOBAL} and len(got) == 12
    r = got["x", 4]
    # U counts as T, N is unknown
    assert (r.n_sequences, r.s_T, r.gap_count, r.valid_count, r.unknown_count) == (2, 1, 0, 1, 1)
    r = got[sites.GLOBAL, 3]
    assert (r.n_sequences, r.s_T, r.gap_count, r.valid_count, r.unknown_count) == (4, 2, 2, 2, 0)
    assert (got["y", 1].s_C, got["y", 1].valid_count) == (2, 2)


def test_metrics_of_a_column(spark):
    m = sites.column_metrics(sites.column_counts(aligned(spark)))
    got = {(r["class"], r.pos): r for r in m.collect()}
    r = got[sites.GLOBAL, 2]
    # C G C C
    want = -(0.75 * math.log2(0.75) + 0.25 * math.log2(0.25))
    assert (r.p_C, r.p_G, r.consensus, r.consensus_fraction) == (0.75, 0.25, "C", 0.75)
    assert r.entropy_bits == pytest.approx(want) and r.entropy_norm == pytest.approx(want / 2) and r.intra_similarity == pytest.approx(0.625) and r.effective_symbols == pytest.approx(2 ** want)
    # ties go to the first of the alphabet, a column without valid symbols has none
    assert got["x", 2].consensus == "C" and got[sites.GLOBAL, 1].consensus == "A"
    none = sites.column_metrics(sites.column_counts(aligned(spark).filter("class = 'x'").withColumn("aligned", F.lit("--")))).first()
    assert (none.consensus, none.valid_fraction, none.gap_fraction, none.entropy_bits) == ("", 0.0, 1.0, 0.0)


def test_divergence_of_two_classes(spark):
    m = sites.column_metrics(sites.column_counts(aligned(spark)))
    got = {r.pos: r for r in sites.pair_divergence(m).collect()}
    assert {r.pair for r in got.values()} == {"xvy"}
    # all A against all C; C and G against all C
    assert (got[1].distribution_overlap, got[1].jsd, got[1].cosine_similarity) == pytest.approx((0.0, 1.0, 0.0))
    p, q = (0.5, 0.5), (1.0, 0.0)
    mid = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
    kl = lambda x: sum(a * math.log2(a / m) for a, m in zip(x, mid, strict=True) if a)
    assert (got[2].distribution_overlap, got[2].jsd, got[2].cosine_similarity) == pytest.approx((0.5, kl(p) / 2 + kl(q) / 2, math.sqrt(0.5)))
    assert got[3].gap_fraction_absdiff == 0.0 and got[4].coverage_weighted_overlap == pytest.approx(0.5 * 0.5)


@pytest.mark.parametrize(("a", "b", "bases", "other"), [("ACGT", "ACGA", 0.75, 0.75), ("AC-T", "ACGN", 1.0, 2 / 3), ("--", "AC", None, None), ("ac", "AC", 1.0, 1.0), ("A" * 130 + "C", "A" * 130 + "G", 130 / 131, 130 / 131)])
def test_identity_of_two_rows(spark, a, b, bases, other):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    x, y = F.col("a"), F.col("b")
    got = df.select(sites.identity_of(x, y), sites.identity_of(x, y, bases_only=False), sites.masked_identity(sites.base_masks(x), sites.base_masks(y))).first()
    assert tuple(got) == pytest.approx((bases, other, bases))


def test_consensus_needs_every_strategy_and_one_sign(spark):
    kw = [(s, r, 0.01 if r != "weak" or s != 3 else 0.2, None, 0.1 * s) for s in (1, 2, 3) for r in ("good", "weak", "mixed")]
    kw = consensus.kruskal_consensus(spark.createDataFrame(kw, "strategy int, region string, p double, p_fdr double, epsilon_squared_R double"), [1, 2, 3])
    assert {r.region: (r.kw_all_significant, r.kw_p_worst, r.kw_epsilon_min, r.kw_epsilon_median) for r in kw.collect()} == {
        "good": (True, 0.01, 0.1, 0.2), "weak": (False, 0.2, 0.1, 0.2), "mixed": (True, 0.01, 0.1, 0.2)}
    pairs = [(s, r, "1v2", 0.02, None, -0.5 - s / 10 if r != "mixed" or s != 2 else 0.5) for s in (1, 2, 3) for r in ("good", "weak", "mixed")]
    pairs = consensus.pairwise_consensus(spark.createDataFrame(pairs, "strategy int, region string, comparison string, p double, p_fdr double, rank_biserial double"), kw, [1, 2, 3])
    got = {r.region: r for r in pairs.collect()}
    assert {k: (r.pair_pvalue_consensus_pass, r.pair_effect_consensus_pass) for k, r in got.items()} == {"good": (True, True), "weak": (False, False), "mixed": (True, False)}
    assert (got["good"].pair_effect_worst_signed, got["good"].pair_effect_median, got["mixed"].pair_effect_worst_signed) == pytest.approx((-0.6, -0.7, None))
    assert consensus.star_mismatches(kw, pairs).count() == 0
