"""Boosted trees against a plain booster that reads all rows."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from strainlens.operators import boosting, learning


def table(n, seed, classes=3):
    r = np.random.default_rng(seed)
    x = np.round(r.standard_normal((n, 3)), 2)
    label = (x[:, 0] + 0.5 * x[:, 1] ** 2 + 0.3 * r.standard_normal(n) > 0.6).astype(int) + (x[:, 2] > 1.1)
    x[r.random(n) < 0.05, 1] = np.nan
    return x, np.minimum(label, classes - 1)


def plain(x, y, edges, medians, k, s):
    """One best-first tree per class and round, by scanning all rows of every node."""
    x = np.where(np.isnan(x), medians, x)
    bins = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], axis=1)
    scores = np.tile(np.log(np.bincount(y, minlength=k) / len(y)), (len(y), 1))
    losses = []
    for _ in range(s.rounds):
        p = boosting.softmax(scores)
        for c in range(k):
            g, h = p[:, c] - (y == c), p[:, c] * (1 - p[:, c])

            def best(rows, g=g, h=h):
                top = (1e-12, None)
                value = lambda r: g[r].sum() ** 2 / (h[r].sum() + s.l2)
                for j in range(x.shape[1]):
                    for b in np.unique(bins[rows, j])[:-1]:
                        left, right = rows[bins[rows, j] <= b], rows[bins[rows, j] > b]
                        if min(len(left), len(right)) >= s.min_rows and min(h[left].sum(), h[right].sum()) >= s.min_curvature:
                            gain = value(left) + value(right) - value(rows)
                            if gain > top[0] + 1e-9:
                                top = (gain, left, right)
                return top

            leaves = [(np.arange(len(y)), best(np.arange(len(y))))]
            while len(leaves) < s.max_leaves:
                i = max(range(len(leaves)), key=lambda i: leaves[i][1][0])
                if leaves[i][1][1] is None:
                    break
                _, left, right = leaves.pop(i)[1]
                leaves += [(left, best(left)), (right, best(right))]
            for rows, _ in leaves:
                scores[rows, c] -= s.rate * g[rows].sum() / (h[rows].sum() + s.l2)
        losses.append(-np.log(boosting.softmax(scores)[np.arange(len(y)), y]).mean())
    return scores, losses


def frame(spark, parts):
    rows = [(f, "train" if i % 4 else "test", i, int(y), *[None if np.isnan(v) else float(v) for v in x]) for f, (xs, ys) in parts.items() for i, (x, y) in enumerate(zip(xs, ys, strict=True))]
    return spark.createDataFrame(rows, "fold string, split string, index long, label int, a double, b double, c double")


@pytest.mark.parametrize("direct", [True, False])
def test_trees_equal_a_plain_booster(spark, monkeypatch, direct):
    if not direct:
        monkeypatch.setattr(boosting, "DIRECT_TASKS", 0)
        monkeypatch.setattr(boosting, "KEPT_ROUNDS", 2)
    parts = {"p": table(400, 1), "q": table(260, 2)}
    s = boosting.Settings(rounds=5, max_leaves=6)
    model = boosting.fit(frame(spark, parts).repartition(3), ["a", "b", "c"], ["p", "q"], 3, s)
    for i, (x, y) in enumerate(parts.values()):
        train = np.arange(len(y)) % 4 > 0
        assert all(len(e) < boosting.BINS for e in model.edges[i])
        # bins as by plain reading: edges halfway between neighbouring values, unless they are many
        v = np.unique(x[train, 0])
        if len(v) <= boosting.BINS:
            assert np.allclose(model.edges[i][0], (v[1:] + v[:-1]) / 2)
        want, losses = plain(x[train], y[train], model.edges[i], model.medians[i], 3, s)
        got = model.scores(i, model.binned(i, x[train]))
        assert np.allclose(got, want, atol=1e-9)
        assert all(b < a for a, b in zip(losses, losses[1:], strict=False))


@pytest.mark.parametrize("way", ["three tasks", "job per level"])
def test_ways_to_grow_give_the_same_trees(spark, monkeypatch, way):
    parts = {"p": table(400, 1), "q": table(260, 2)}
    rows, s = frame(spark, parts), boosting.Settings(rounds=12, max_leaves=6)
    jobs = []
    sums, together = boosting._histograms, boosting._grow_together
    monkeypatch.setattr(boosting, "_histograms", lambda *a: jobs.append("level") or sums(*a))
    monkeypatch.setattr(boosting, "_grow_together", lambda *a: jobs.append(a[1]) or together(*a))
    one = boosting.fit(rows, ["a", "b", "c"], ["p", "q"], 3, s)
    # two barrier jobs of one task: the jobs do not go with the levels
    assert jobs == [1, 1] and len(one.rounds) == 12
    monkeypatch.setattr(boosting, "BARRIER_CELLS", 200)
    if way == "job per level":
        monkeypatch.setattr(boosting, "MOST_CELLS", 100)
    jobs.clear()
    other = boosting.fit(rows, ["a", "b", "c"], ["p", "q"], 3, s)
    assert jobs == [3, 3] if way == "three tasks" else set(jobs) == {"level"} and len(jobs) > 12
    for i, (x, _) in enumerate(parts.values()):
        bins = one.binned(i, x)
        assert np.allclose(one.scores(i, bins), other.scores(i, bins), atol=1e-9)


def test_predictions(spark):
    x, y = table(600, 3)
    rows = frame(spark, {"only": (x, y)})
    model = boosting.fit(rows, ["a", "b", "c"], ["only"], 4, boosting.Settings(rounds=30))
    got = boosting.predict(rows.where("split = 'test'"), ["a", "b", "c"], model, ["index"], 4).collect()
    assert len(got) == 150 and got[0].fold == "only"
    for r in got:
        p = [r[f"prob_{c}"] for c in range(4)]
        assert abs(sum(p) - 1) < 1e-12 and p[3] == 0 and r.y_pred == int(np.argmax(p))
    right = np.mean([r.y_pred == r.y_true for r in got])
    assert right > np.bincount(y).max() / len(y) + 0.15


def test_odd_tables(spark):
    rows = frame(spark, {"one": (np.full((50, 3), np.nan), np.zeros(50, int))})
    model = boosting.fit(rows, ["a", "b", "c"], ["one", "none"], 2, boosting.Settings(rounds=2))
    got = boosting.predict(rows, ["a", "b", "c"], model, ["index"], 2).collect()
    assert len(got) == 50 and {(r.y_pred, r.prob_0) for r in got} == {(0, 1.0)}
    empty = boosting.fit(rows.where("false"), ["a", "b", "c"], ["one"], 2, boosting.Settings(rounds=2))
    assert empty.rounds == [] and boosting.predict(rows, ["a", "b", "c"], empty, ["index"], 2).agg(F.count_if(F.col("prob_0") == 0.5)).first()[0] == 50


def test_boosted_baseline_beside_the_others(spark):
    x, y = table(300, 5)
    rows = frame(spark, {"f": (x, y)})
    features, splits = rows.select("index", "label", "a", "b", "c"), rows.select("index", "fold", "split")
    specs = [learning.Spec("majority", "majority"), learning.Spec("lin", "logistic", ("a", "c")), learning.Spec("trees", "boosted", ("a", "b", "c"))]
    got = learning.evaluate(features, splits, specs, ["f"], rounds=5)
    counts = {r.model: r["count"] for r in got.groupBy("model").count().collect()}
    assert counts == {"majority": 75, "lin": 75, "trees": 75}


def test_logistic_fit_is_at_the_minimum(spark):
    x, y = table(400, 7)
    x = np.where(np.isnan(x), 0, x)
    rows = frame(spark, {"f": (x, y)}).where("split = 'train'")
    spec = learning.Spec("lin", "logistic", ("a", "c"))
    out = learning.coefficients(learning.fit_predict(rows, rows, spec, ["index"], 3)[1], spec, spark).collect()
    w, b = np.zeros((3, 2)), np.zeros(3)
    for r in out:
        w[r.class_index, spec.features.index(r.feature)], b[r.class_index] = r.standardized_coefficient, r.intercept
    train = np.arange(400) % 4 > 0
    z, t = x[train][:, [0, 2]], y[train]
    z = (z - z.mean(axis=0)) / z.std(axis=0, ddof=1)
    p = boosting.softmax(z @ w.T + b) - np.eye(3)[t]
    assert np.abs(p.T @ z + w).max() < 1e-3 * len(t) and np.abs(p.sum(axis=0)).max() < 1e-3 * len(t)


def test_a_fold_grows_in_one_task(spark, monkeypatch):
    parts = {"p": table(400, 1), "q": table(260, 2)}
    rows, s = frame(spark, parts), boosting.Settings(rounds=90, max_leaves=4)
    jobs, together = [], boosting._grow_together
    monkeypatch.setattr(boosting, "_grow_together", lambda *a: jobs.append(a[1]) or together(*a))
    one = boosting.fit(rows, ["a", "b", "c"], ["p", "q"], 3, s)
    assert jobs == [1] * 8
    monkeypatch.setattr(boosting, "BARRIER_CELLS", 200)
    jobs.clear()
    other = boosting.fit(rows.repartition(5), ["a", "b", "c"], ["p", "q"], 3, s)
    assert jobs == [3] * 8
    # tasks share no sums, so their number changes no bit
    for i, (x, _) in enumerate(parts.values()):
        bins = one.binned(i, x)
        assert len(one.rounds) == 90 and np.array_equal(one.scores(i, bins), other.scores(i, bins))


@pytest.mark.parametrize("cells", [2_000_000, 10])
def test_large_children_have_what_is_left_of_their_parent(spark, monkeypatch, cells):
    monkeypatch.setattr(boosting, "DERIVED_ROWS", 0)
    monkeypatch.setattr(boosting, "MOST_CELLS", cells)
    x, y = table(400, 1)
    s = boosting.Settings(rounds=4, max_leaves=6)
    model = boosting.fit(frame(spark, {"p": (x, y)}), ["a", "b", "c"], ["p"], 3, s)
    train = np.arange(400) % 4 > 0
    want, _ = plain(x[train], y[train], model.edges[0], model.medians[0], 3, s)
    assert np.allclose(model.scores(0, model.binned(0, x[train])), want, atol=1e-9)
    asked = boosting.Growing(s, sums=[(0, 9, 90), (0, 1, 30), (0, 8, 60)], children={0: (1, 2)})
    assert asked.summed([1, 2]) == ([1], {2: (0, 1)}) and asked.summed([2]) == ([1], {2: (0, 1)}) and asked.summed([1]) == ([1], {})
