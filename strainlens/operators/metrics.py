"""Classification metrics from confusion counts, feature and fold summaries.

Everything starts from one aggregate over (keys, true, predicted): the C x C
counts are tiny, so the later arithmetic costs nothing at any data size.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strainlens.functions import annotate
from strainlens.functions import ranking as rk


def confusion_row(df: DataFrame, keys: Sequence[str], n_classes: int = 4, y: str = "y_true", p: str = "y_pred", weight: str | None = None) -> DataFrame:
    """One row per key with the C x C counts as ``cm`` (array of arrays).

    ``weight`` names a column of how often a row counts, once without it.
    """
    def times(cond: Column | None) -> Column:
        if weight is None:
            return F.count(F.lit(1)) if cond is None else F.count_if(cond)
        return F.sum(weight if cond is None else F.when(cond, F.col(weight)).otherwise(0))
    cells = [times((F.col(y) == t) & (F.col(p) == q)).alias(f"_c{t}_{q}") for t in range(n_classes) for q in range(n_classes)]
    out = df.groupBy(*keys).agg(times(None).alias("n_rows"), *cells)
    cm = F.array(*[F.array(*[F.col(f"_c{t}_{q}") for q in range(n_classes)]) for t in range(n_classes)])
    return out.select(*keys, "n_rows", cm.alias("cm"))


def confusion_long(rows: DataFrame, keys: Sequence[str], mode: str = "none") -> DataFrame:
    """Long form with zero cells; share by none, true row or all."""
    t = rows.select(*keys, "n_rows", F.posexplode("cm").alias("y_true", "_row"))
    cells = t.select(*keys, "n_rows", "y_true", F.expr("aggregate(_row, 0L, (a, x) -> a + x)").alias("_row_n"),
                     F.posexplode("_row").alias("y_pred", "n"))
    if mode == "none":
        return cells.select(*keys, "y_true", "y_pred", "n")
    base = {"row": F.col("_row_n"), "all": F.col("n_rows")}[mode]
    return cells.select(*keys, "y_true", "y_pred", "n", F.when(base > 0, F.col("n") / base).otherwise(0.0).alias("share"))


def _tp(k: int) -> Column:
    return F.col("cm")[k][k]


def _row(k: int, n: int) -> Column:
    return sum((F.col("cm")[k][j] for j in range(1, n)), F.col("cm")[k][0])


def _colsum(k: int, n: int) -> Column:
    return sum((F.col("cm")[j][k] for j in range(1, n)), F.col("cm")[0][k])


def _ratio(num: Column, den: Column, empty=0.0) -> Column:
    return F.when(den > 0, num / den).otherwise(F.lit(empty).cast("double"))


def f1_of(k: int, n: int) -> Column:
    return _ratio(2.0 * _tp(k), _row(k, n) + _colsum(k, n))


def _mean(cols: list[Column]) -> Column:
    return sum(cols[1:], cols[0]) / float(len(cols))


def _mean_where(cols: list[Column], conds: list[Column]) -> Column:
    num = sum((F.when(c, v).otherwise(0.0) for v, c in zip(cols[1:], conds[1:])), F.when(conds[0], cols[0]).otherwise(0.0))
    den = sum((c.cast("int") for c in conds[1:]), conds[0].cast("int"))
    return F.when(den > 0, num / den)


def accuracy_of(n: int) -> Column:
    hits = sum((_tp(k) for k in range(1, n)), _tp(0))
    return _ratio(hits.cast("double"), F.col("n_rows"), None)


def with_f1(rows: DataFrame, n: int = 4) -> DataFrame:
    """accuracy, macro_f1 and f1_0 .. f1_{C-1}; an undefined F1 is 0."""
    f1 = [f1_of(k, n) for k in range(n)]
    out = rows.withColumn("accuracy", accuracy_of(n)).withColumn("macro_f1", _mean(f1))
    for k in range(n):
        out = out.withColumn(f"f1_{k}", f1[k])
    return out


def with_balanced(rows: DataFrame, n: int = 4) -> DataFrame:
    """accuracy, balanced accuracy, macro-F1 over classes present and over all."""
    present = [_row(k, n) > 0 for k in range(n)]
    recall = [_ratio(_tp(k).cast("double"), _row(k, n)) for k in range(n)]
    f1 = [f1_of(k, n) for k in range(n)]
    return (
        rows.withColumn("accuracy", accuracy_of(n))
        .withColumn("balanced_accuracy", _mean_where(recall, present))
        .withColumn("macro_f1_present", _mean_where(f1, present))
        .withColumn("macro_f1_all4", _mean(f1))
    )


def class_report(rows: DataFrame, keys: Sequence[str], n: int = 4) -> DataFrame:
    """Precision, recall, specificity, F1, support per class and the overall,
    macro and weighted rows (missing ratios are left out of macro means)."""
    def entry(k):
        tp, row, col = _tp(k).cast("double"), _row(k, n), _colsum(k, n)
        fp = col - tp
        tn = F.col("n_rows") - row - fp
        return F.struct(
            F.lit(str(k)).alias("entry"), _ratio(tp, col, None).alias("precision"), _ratio(tp, row, None).alias("recall"),
            _ratio(tn, tn + fp, None).alias("specificity"), f1_of(k, n).alias("f1"), row.cast("bigint").alias("support"))
    per = rows.select(*keys, F.inline(F.array(*[entry(k) for k in range(n)])))
    w = F.col("support")
    f = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0.0)) * w) / F.sum(w)
    macro = per.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "specificity", "f1")], F.sum("support").alias("support"))
    weighted = per.groupBy(*keys).agg(*[f(c).alias(c) for c in ("precision", "recall", "specificity", "f1")], F.sum("support").alias("support"))
    whole = rows.select(*keys, accuracy_of(n).alias("f1"), F.col("n_rows").alias("support"))
    none = F.lit(None).cast("double")
    whole = whole.select(*keys, F.lit("accuracy").alias("entry"), none.alias("precision"), none.alias("recall"), none.alias("specificity"), "f1", "support")
    return (per.unionByName(macro.withColumn("entry", F.lit("macro"))).unionByName(weighted.withColumn("entry", F.lit("weighted")))
            .unionByName(whole))


def score_steps(df: DataFrame, keys: Sequence[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """Distinct scores per key with cumulative true and false positives of the
    rule "score at or above this one"."""
    work = df.groupBy(*keys, F.col(score).alias("score")).agg(
        F.sum(positive).cast("bigint").alias("pos"), (F.count(F.lit(1)) - F.sum(positive)).cast("bigint").alias("neg"))
    out = rk.with_prefix_sums(work, keys, [F.col("score").desc()], {"pos": F.col("pos"), "neg": F.col("neg")})
    return (out.withColumn("tp", F.col("pos_before") + F.col("pos")).withColumn("fp", F.col("neg_before") + F.col("neg")))


def ranking_quality(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One-vs-rest AUROC (ties count half) and average precision; null when
    only one class occurs."""
    p, n = F.max("pos_total"), F.max("neg_total")
    area = F.sum(F.col("pos") * (F.col("neg_total") - F.col("fp") + F.col("neg") / 2.0))
    ap = F.sum(F.col("pos") * (F.col("tp") / (F.col("tp") + F.col("fp"))))
    both = (p > 0) & (n > 0)
    return steps.groupBy(*keys).agg(F.when(both, area / (p * n)).alias("auroc"), F.when(both, ap / p).alias("average_precision"),
                                    p.alias("n_pos"), n.alias("n_neg"))


def curve_points(steps: DataFrame) -> DataFrame:
    """ROC and PR points per distinct score, with the chance level."""
    def r(a, b):
        return F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return (
        steps.withColumn("tpr", r("tp", "pos_total")).withColumn("fpr", r("fp", "neg_total"))
        .withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp")))
        .withColumn("chance", F.col("pos_total") / (F.col("pos_total") + F.col("neg_total")))
        .drop("pos_before", "neg_before", "pos", "neg", "pos_total", "neg_total")
    )


def describe_features(df: DataFrame, key: str, features: Sequence[str]) -> DataFrame:
    """n, mean, sample sd, min, quartiles, max per (key, feature)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])).alias("p")
    # value counts first: one map-side combine serves moments and quartiles
    long = df.select(key, pairs).select(key, "p.feature", "p.value")
    base = long.groupBy(key, "feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    q = rk.exact_percentiles(long, [key, "feature"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75})
    return base.join(q, [key, "feature"])


def fold_summary(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """mean, median, population sd, min, max per metric over finite values.

    One row per fold goes in, so the exact percentile is over a few values.
    """
    long = unpivot(df, list(keys), metrics)
    return summarise_values(long, [*keys, "metric"], "value")


def summarise_values(long: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    v = F.col(value)
    ok = long.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return ok.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.percentile(v, F.lit(0.5)).alias("median"),
                                 F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))


def error_bounds(summary: DataFrame, center: str = "mean", mode: str = "std") -> DataFrame:
    if mode == "std":
        return summary.withColumn("low", F.col(center) - F.col("std")).withColumn("high", F.col(center) + F.col("std"))
    return summary.withColumn("low", F.col("min")).withColumn("high", F.col("max"))


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def fold_wide(df: DataFrame, model: str, fold: str, metrics: Sequence[str]) -> DataFrame:
    """Fold rows with a Mean row and an SD row per model; ``label`` repeats the
    model name on its first row only."""
    body = df.select(F.col(model), F.col(fold).cast("string").alias("fold"), *[annotate.fixed(F.col(m), 4).alias(m) for m in metrics],
                     F.lit(0).alias("_part"))
    tail = df.groupBy(model).agg(*[F.avg(m).alias(f"{m}_mean") for m in metrics], *[F.stddev_pop(m).alias(f"{m}_sd") for m in metrics])
    tail = tail.select(model, F.lit("Mean +/- SD").alias("fold"),
                       *[annotate.mean_sd_text(F.col(f"{m}_mean"), F.col(f"{m}_sd")).alias(m) for m in metrics], F.lit(1).alias("_part"))
    both = body.unionByName(tail)
    w = Window.partitionBy(model).orderBy("_part", "fold")
    place = F.row_number().over(w)
    return both.withColumn("row_in_model", place).withColumn("label", F.when(F.col("row_in_model") == 1, F.col(model)).otherwise("")).drop("_part")


def baseline_table(summary: DataFrame, model: str, protocol: str, protocols: Sequence[str], metrics: dict[str, str]) -> DataFrame:
    """Percent with one decimal (half to even): one row per (model, metric),
    one column per protocol; a missing or repeated cell raises."""
    long = unpivot(summary, [model, protocol], list(metrics), "metric", "value")
    aggs = []
    for p in protocols:
        here = F.col(protocol) == p
        n = F.count_if(here & F.col("value").isNotNull())
        value = F.bround(F.max(F.when(here, F.col("value"))) * 100.0, 1)
        aggs.append(F.when(n == 1, value).otherwise(F.raise_error(F.concat(
            F.lit(f"expected one value for {p}, found "), n.cast("string")))).alias(p))
    out = long.groupBy(model, "metric").agg(*aggs)
    names = F.create_map(*[F.lit(x) for kv in metrics.items() for x in kv])
    return out.withColumn("metric", names[F.col("metric")])


def run_costs(runs: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """n, mean, median, population sd, min, max per (keys, cost column)."""
    long = unpivot(runs, list(keys), list(values), "metric", "value")
    by = [*keys, "metric"]
    base = long.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"),
                                 F.min("value").alias("min"), F.max("value").alias("max"))
    return base.join(rk.exact_percentiles(long, by, "value", {"median": 0.5}), by, "left")


def run_overview(runs: DataFrame, keys: Sequence[str], timing: str, first: Sequence[str], order: str) -> DataFrame:
    """Runs with and without timing, and the first non-null description fields."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"), F.count(timing).alias("runs_with_timing"),
        F.count_if(F.col(timing).isNull()).alias("runs_without_timing"),
        *[F.min_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in first])


def batch_timing(batches: DataFrame, keys: Sequence[str], seconds: str, samples) -> DataFrame:
    """Total, mean and population sd of batch time, samples per second, latency."""
    total, n = F.sum(seconds), F.sum(samples)
    return batches.groupBy(*keys).agg(
        total.alias("total_seconds"), F.avg(seconds).alias("batch_mean"), F.stddev_pop(seconds).alias("batch_std"),
        n.alias("n_samples"), F.count(F.lit(1)).alias("n_batches"),
        F.when(total > 0, n / total).alias("samples_per_second"), F.when(n > 0, total / n * 1000.0).alias("ms_per_sample"))


def split_qc(splits: DataFrame, keys: Sequence[str], n_rows) -> DataFrame:
    """Folds, distinct test indices and test assignments.

    Counted through (keys, index) partial sums, so no distinct set of indices
    is held in one task.
    """
    zero = F.lit(0).cast("bigint")
    per_index = splits.groupBy(*keys, "index").agg(F.count_if(F.col("split") == "test").alias("_t"))
    a = per_index.select(*keys, zero.alias("_f"), (F.col("_t") > 0).cast("bigint").alias("_u"), "_t")
    b = splits.groupBy(*keys, "fold").agg(F.count(F.lit(1))).select(*keys, F.lit(1).cast("bigint").alias("_f"), zero.alias("_u"), zero.alias("_t"))
    out = a.unionByName(b).groupBy(*keys).agg(F.sum("_f").alias("n_folds"), F.sum("_u").alias("n_unique_test_indices"), F.sum("_t").alias("n_test_assignments"))
    return out.withColumn("n_feature_rows", n_rows)
