"""Feature baselines: majority, logistic regression by Spark ML, boosted trees,
fold evaluation, projection."""
from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strainlens import session
from strainlens.operators import boosting


# Fits that the driver keeps running at a time; each is a series of Spark jobs.
_FITS = 4


@dataclass(frozen=True)
class Spec:
    """A baseline: name, kind (majority, logistic or boosted) and features."""

    name: str
    kind: str
    features: tuple[str, ...] = ()


# The planned baselines.
SPECS = [
    Spec("majority", "majority"),
    Spec("length_logreg", "logistic", ("sequence_length",)),
    Spec("n_logreg", "logistic", ("n_fraction",)),
    Spec("gc_logreg", "logistic", ("gc_fraction",)),
    Spec("length_gc_logreg", "logistic", ("sequence_length", "gc_fraction")),
    Spec("length_n_gc_logreg", "logistic", ("sequence_length", "n_fraction", "gc_fraction")),
    Spec("quality_logreg", "logistic", ("sequence_length", "n_fraction", "iupac_fraction", "gap_fraction", "other_fraction", "gc_fraction")),
    Spec("quality_boosted", "boosted", ("sequence_length", "n_fraction", "iupac_fraction", "gap_fraction", "other_fraction", "gc_fraction")),
]


def majority_label(train: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Most frequent training label per key, the lowest on ties."""
    n = train.groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(*keys).agg(F.max_by(F.col(label), F.struct("n", -F.col(label))).alias("majority"), F.max("n").alias("n_majority"))


def logistic_pipeline(features: Sequence[str], n_rows: int, max_iter: int = 5000, tolerance: float = 1e-9) -> Pipeline:
    """Median imputation, standardisation, multinomial logistic regression.

    The penalty 1/n in the mean loss is the usual unit penalty in the summed loss.
    """
    filled = [f"_{f}" for f in features]
    return Pipeline(stages=[
        Imputer(strategy="median", inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="features"),
        LogisticRegression(family="multinomial", standardization=False, regParam=1.0 / max(1, n_rows), elasticNetParam=0.0, maxIter=max_iter, tol=tolerance, labelCol="label"),
    ])


def _probabilities(scored: DataFrame, n_classes: int) -> DataFrame:
    """Class probabilities aligned to all classes; absent classes get 0."""
    scored = scored.withColumn("_p", vector_to_array("probability"))
    return scored.select("*", *[F.coalesce(F.get("_p", F.lit(c)), F.lit(0.0)).alias(f"prob_{c}") for c in range(n_classes)]).drop("_p")


def fit_predict(train: DataFrame, test: DataFrame, spec: Spec, keep: Sequence[str], n_classes: int = 4):
    """Predictions on the test rows and the fitted model (None for majority) of a majority or logistic baseline."""
    if spec.kind == "majority":
        top = majority_label(train, [])
        out = test.withColumn("prediction", top.select("majority").scalar().cast("double"))
        out = out.select(*keep, F.col("label").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
                         *[(F.col("prediction") == c).cast("double").alias(f"prob_{c}") for c in range(n_classes)])
        return out, None
    n = train.count()
    model = logistic_pipeline(spec.features, n).fit(train.withColumn("label", F.col("label").cast("double")))
    scored = _probabilities(model.transform(test.withColumn("label", F.col("label").cast("double"))), n_classes)
    return scored.select(*keep, F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"), *[f"prob_{c}" for c in range(n_classes)]), model


def coefficients(model, spec: Spec, spark) -> DataFrame:
    """(class_index, feature, standardized_coefficient, intercept) of a fitted
    logistic pipeline: classes x features numbers."""
    last = model.stages[-1]
    m, b = last.coefficientMatrix.toArray(), last.interceptVector.toArray()
    rows = [(c, f, float(m[c][i]), float(b[c])) for c in range(m.shape[0]) for i, f in enumerate(spec.features)]
    return spark.createDataFrame(rows, "class_index int, feature string, standardized_coefficient double, intercept double")


def fold_rows(features: DataFrame, splits: DataFrame, folds: Sequence[str]) -> DataFrame:
    """Features with fold and split, joined and written once for the many jobs that read them."""
    rows = features.join(splits.filter(F.col("fold").isin(list(folds))).select("index", "fold", "split"), "index")
    # adaptive execution sizes the files by their rows, so a small table costs each of the many jobs one task
    return session.cut_lineage(rows.repartition("fold", "index"), "fold-rows")


def fit_folds(rows: DataFrame, specs: Sequence[Spec], folds: Sequence[str], keep: Sequence[str] = ("index",)) -> list:
    """(fold, spec, predictions, model) of every fold and majority or logistic baseline.

    Fits are series of small jobs, so several run side by side.
    """
    def run(task):
        fold, spec = task
        own = rows.filter(F.col("fold") == fold)
        train, test = (own.filter(F.col("split") == side) for side in ("train", "test"))
        predictions, model = fit_predict(train, test, spec, keep)
        return fold, spec, predictions, model

    with ThreadPoolExecutor(_FITS) as pool:
        return list(pool.map(run, [(fold, spec) for fold in folds for spec in specs]))


def evaluate(features: DataFrame, splits: DataFrame, specs: Sequence[Spec], folds: Sequence[str], keep: Sequence[str] = ("index",), rounds: int = 200, n_classes: int = 4) -> DataFrame:
    """Out-of-fold predictions of every baseline in every fold; models are fitted while the query is built.

    The boosted trees of all folds are fitted together, the other baselines fold by fold.
    """
    rows, out = fold_rows(features, splits, folds), None
    parts = [p.select(F.lit(fold).alias("fold"), F.lit(spec.name).alias("model"), "*") for fold, spec, p, _ in fit_folds(rows, [s for s in specs if s.kind != "boosted"], folds, keep)]
    for spec in specs:
        if spec.kind == "boosted":
            model = boosting.fit(rows, spec.features, folds, n_classes, boosting.Settings(rounds=rounds))
            p = boosting.predict(rows.filter(F.col("split") == "test"), spec.features, model, keep, n_classes)
            parts.append(p.select("fold", F.lit(spec.name).alias("model"), *[c for c in p.columns if c != "fold"]))
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def fold_coefficients(features: DataFrame, splits: DataFrame, specs: Sequence[Spec], folds: Sequence[str]) -> DataFrame:
    """Coefficients of the logistic baselines per fold and model."""
    fits = fit_folds(fold_rows(features, splits, folds), [s for s in specs if s.kind == "logistic"], folds)
    out = None
    for fold, spec, _, model in fits:
        c = coefficients(model, spec, features.sparkSession).select(F.lit(fold).alias("fold"), F.lit(spec.name).alias("model"), "*")
        out = c if out is None else out.unionByName(c)
    return out


def project(df: DataFrame, vector: str, keep: Sequence[str], k: int = 2) -> DataFrame:
    """Principal components of centred vectors (axis signs are arbitrary)."""
    work = df.select(*keep, array_to_vector(F.col(vector).cast("array<double>")).alias("_v"))
    pipe = Pipeline(stages=[StandardScaler(withMean=True, withStd=False, inputCol="_v", outputCol="_c"), PCA(k=k, inputCol="_c", outputCol="_p")])
    out = pipe.fit(work).transform(work).withColumn("_a", vector_to_array("_p"))
    return out.select(*keep, *[F.get("_a", F.lit(i)).alias(n) for i, n in enumerate(["x", "y", "z"][:k])])
