import numpy as np
import pytest
from pyspark.sql import functions as F

from strainlens.functions import ranking as rk
from strainlens.operators import metrics, rank_tests


def skewed(spark, n=3000, seed=5):
    """One group holds most rows; values repeat, change sign and magnitude."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 10 else f"k{i % 7}"
        rows.append((key, int(rng.integers(0, 4)), float(round(rng.normal() * 10.0 ** rng.integers(-3, 4), 3))))
    return rows, spark.createDataFrame(rows, "k string, g int, v double")


def mean_ranks(values):
    values = np.asarray(values)
    return np.array([(values < v).sum() + ((values == v).sum() + 1) / 2 for v in values])


def spread(df, name="_part"):
    return [r["count"] for r in df.groupBy(name).count().collect()]


@pytest.mark.parametrize("kind", ["near one", "sparse", "text"])
def test_ranges_are_even_where_values_lie_densely(spark, kind):
    rng = np.random.default_rng(2)
    n = 20_000
    if kind == "near one":
        # nine of ten scores between 0.9998 and 1, all in one group
        values = [float(1 - 2e-4 * rng.random()) if i % 10 else float(rng.random()) for i in range(n)]
        df = spark.createDataFrame([("hot", v) for v in values], "k string, v double")
    elif kind == "sparse":
        df = spark.createDataFrame([("hot", int(v)) for v in rng.integers(-2**62, 2**62, n)], "k string, v bigint")
    else:
        df = spark.createDataFrame([("hot", f"cluster-{v:07d}") for v in rng.permutation(n)], "k string, v string")
    sizes = spread(rk.ordered_ranges(df, [F.col("k"), F.col("v")], parts=16))
    assert sum(sizes) == n and max(sizes) < 2 * n / 16
    got = rk.with_row_number(df, ["k"], [F.col("v")], parts=16).toPandas().sort_values("v")
    assert list(got["rn"]) == list(range(1, n + 1))


def test_percentiles_of_scores_near_one(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([1 - 2e-4 * rng.random(4500), rng.random(500)])
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("b", 0.5)], "k string, v double")
    q = {r.k: r for r in rk.exact_percentiles(df, ["k"], "v", {"low": .05, "mid": .5, "top": .999}).collect()}
    assert (q["a"].low, q["a"].mid, q["a"].top) == pytest.approx(tuple(np.percentile(values, [5, 50, 99.9])), rel=1e-12)
    assert (q["b"].low, q["b"].top) == (0.5, 0.5)


def test_average_rank_and_percentiles_match_brute_force(spark):
    rows, df = skewed(spark)
    got = rk.average_rank(df, ["k"], "v").collect()
    by = {}
    for k, _, v in rows:
        by.setdefault(k, []).append(v)
    want = {(k, v): r for k, vs in by.items() for v, r in zip(vs, mean_ranks(vs))}
    assert all(r.avg_rank == want[(r.k, r.v)] for r in got) and len(got) == len(rows)
    q = {r.k: r for r in rk.exact_percentiles(df, ["k"], "v", {"a": .25, "b": .5, "c": .975}).collect()}
    for k, vs in by.items():
        assert (q[k].a, q[k].b, q[k].c) == pytest.approx(tuple(np.percentile(vs, [25, 50, 97.5])))


def test_row_numbers_are_contiguous(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("k"), "id")
    out = rk.with_row_number(df, ["k"], [F.col("id")], parts=9)
    for k, part in out.toPandas().groupby("k"):
        assert list(part.sort_values("id")["rn"]) == list(range(1, len(part) + 1))


def test_rank_tests_match_brute_force(spark):
    rows, df = skewed(spark, 600)
    t = rank_tests.group_value_table(df, ["k"], "g", [0, 1, 2, 3], "v")
    kw = {r.k: r for r in rank_tests.kruskal(t, ["k"], [0, 1, 2, 3]).collect()}
    mw = {(r.k, r.class_a, r.class_b): r for r in rank_tests.mann_whitney_pairs(t, ["k"], [0, 1, 2, 3]).collect()}
    for k in {r[0] for r in rows}:
        groups = [[v for kk, g, v in rows if kk == k and g == c] for c in range(4)]
        used = [x for x in groups if len(x) >= 2]
        allv = np.concatenate(used)
        n, r, at, acc = len(allv), mean_ranks(allv), 0, 0.0
        for x in used:
            acc += r[at:at + len(x)].sum() ** 2 / len(x)
            at += len(x)
        ties = sum(c**3 - c for c in np.unique(allv, return_counts=True)[1])
        assert kw[k].H == pytest.approx((12 / (n * (n + 1)) * acc - 3 * (n + 1)) / (1 - ties / (n**3 - n)))
        for a in range(4):
            for b in range(a + 1, 4):
                u = sum((x > y) + .5 * (x == y) for x in groups[a] for y in groups[b])
                got = mw[(k, str(a), str(b))].U
                assert (got is None) == (min(len(groups[a]), len(groups[b])) < 2) and (got is None or got == pytest.approx(u))


def test_auroc_matches_pair_counting(spark):
    rng = np.random.default_rng(1)
    rows = [(int(rng.integers(0, 2)), float(rng.integers(0, 30)) / 10) for _ in range(400)]
    df = spark.createDataFrame([("m", p, s) for p, s in rows], "m string, positive int, score double")
    got = metrics.ranking_quality(metrics.score_steps(df, ["m"]), ["m"]).collect()[0]
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    assert got.auroc == pytest.approx(np.mean([(a > b) + .5 * (a == b) for a in pos for b in neg]))
    one = spark.createDataFrame([("m", 1, .5)], "m string, positive int, score double")
    assert metrics.ranking_quality(metrics.score_steps(one, ["m"]), ["m"]).collect()[0].auroc is None
