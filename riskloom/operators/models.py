"""Default models on Spark ML (FE2 ML1-ML14).

Re-aimed from single-machine libraries to ``pyspark.ml``: the fits themselves
are distributed. Differences in kind are documented per function.
"""

from __future__ import annotations

import hashlib
import json
import math
import random
from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml.classification import (GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import sigmoid
from ..session import materialize
from .evaluate import BETA, fold_mean_metrics

MODEL_NAMES = ["lr", "lasso", "svm", "rf", "gb"]
# Iterations, trials and trees of the study; all are arguments below.
MAX_ITER = {"lr": 1000, "lasso": 3000, "svm": 3000, "logit": 1000}
TRIALS = 100
MAX_TREES = 2000
RANDOM_FEATURES = 256     # of the kernel maps
PARTITION_BYTES = 16 << 20
MIN_STEP = 1e-6           # of Newton steps that are halved
TOLERANCE = 1e-6          # at which solvers stop


def assemble(df: DataFrame, features: Sequence[str], out: str = "features") -> DataFrame:
    """Feature vector from named columns, keys kept on the row (FE2, JN9)."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def sized(df: DataFrame, n_features: int) -> DataFrame:
    """``df`` in as many partitions as its rows fill: every iteration of a solver is a job
    over all of them, and near-empty ones cost more than they hold."""
    cells = df.count() * (n_features + 4)
    return df.coalesce(max(1, math.ceil(8 * cells / PARTITION_BYTES)))


def fbeta_evaluator(beta: float = BETA) -> MulticlassClassificationEvaluator:
    """F-beta of the positive class as the selection metric (ML9)."""
    return MulticlassClassificationEvaluator(metricName="fMeasureByLabel", beta=beta, metricLabel=1.0,
                                             labelCol="label", predictionCol="prediction")


# --------------------------------------------------------------------------- kernel maps

def uniform_draw(seed: int | str, *place: int | str) -> float:
    """A number in (0, 1) from the first 52 bits of an md5 of the place, as SQL can draw it too."""
    h = hashlib.md5(":".join(map(str, (seed, *place))).encode()).hexdigest()
    return (int(h[:13], 16) + 0.5) / 2 ** 52


def _uniform(seed, tag: str, *shape: int) -> np.ndarray:
    return np.array([uniform_draw(seed, tag, *at) for at in np.ndindex(*shape)]).reshape(shape)


def _normal(seed, *shape: int) -> np.ndarray:
    """Box-Muller of two draws each."""
    return np.sqrt(-2 * np.log(_uniform(seed, "r", *shape))) * np.cos(2 * math.pi * _uniform(seed, "a", *shape))


def kernel_map(params: dict, train: DataFrame, seed: int = 0, col: str = "features") -> Callable[[DataFrame], DataFrame]:
    """Feature map that turns a linear SVM into the kernel's (ML4, re-aimed).

    ``linear`` leaves the vector. ``rbf`` takes random Fourier features
    (Rahimi and Recht, 2007) and ``poly`` random Maclaurin features (Kar and
    Karnick, 2012) of ``(gamma <x, y>) ^ degree``; both approach the kernel as
    their number grows. ``gamma`` is 1 / (features x variance), as in the study.
    The draws are md5 hashes of seed and place (:func:`uniform_draw`), so they depend
    on no library's generator.
    """
    kernel = params.get("kernel", "linear")
    if kernel == "linear":
        return lambda df: df
    n = train.select(F.size(vector_to_array(col))).first()[0]
    gamma = params.get("gamma")
    if gamma is None:
        value = F.explode(vector_to_array(col))
        var = train.select(value.alias("v")).agg(F.var_pop("v")).first()[0]
        gamma = 1.0 / (n * var) if var else 1.0 / n
    d = int(params.get("n_random", RANDOM_FEATURES))
    if kernel == "rbf":
        w, b = math.sqrt(2 * gamma) * _normal(seed, n, d), 2 * math.pi * _uniform(seed, "b", d)
        mapped = lambda x: math.sqrt(2 / d) * np.cos(x @ w + b)
    elif kernel == "poly":
        signs = np.where(_uniform(seed, "s", int(params.get("degree", 3)), n, d) < 0.5, -1.0, 1.0)
        mapped = lambda x: np.prod(math.sqrt(gamma) * (x @ signs), axis=0) / math.sqrt(d)
    else:
        raise ValueError(f"unknown kernel {kernel}")

    @F.pandas_udf("array<double>")
    def features(x: pd.Series) -> pd.Series:
        return pd.Series(list(mapped(np.stack(x.to_numpy())))) if len(x) else pd.Series([], dtype=object)

    return lambda df: df.withColumn(col, array_to_vector(features(vector_to_array(col))))


# --------------------------------------------------------------------------- estimators

def make_estimator(name: str, params: dict, n_train: int, seed: int = 0):
    """Estimator for a model family and its parameters.

    * ``lr``: unpenalised logistic regression (ML2).
    * ``lasso``: L1 logistic regression, ``regParam = 1 / (C n)`` on raw
      features, the same objective scaling as an inverse-strength ``C`` (ML3).
    * ``svm``: hinge loss with ``regParam = 1 / (C n)`` on raw features after
      :func:`kernel_map` (ML4); probabilities by Platt scaling (ML5).
    * ``rf``: random forest (ML6); leaf fraction -> ``minWeightFractionPerNode``.
    * ``gb``: gradient-boosted trees (ML7); learning rate clipped to (0, 1].

    ``params["max_iter"]`` overrides the study's iterations; solvers stop
    earlier when they have converged (``params["tol"]``). ``rf`` takes
    ``params["bootstrap"]`` and ``params["subset"]``, the features tried at a split.
    """
    tol = float(params.get("tol", TOLERANCE))
    if name == "lr":
        return LogisticRegression(regParam=0.0, maxIter=params.get("max_iter", MAX_ITER["lr"]), tol=tol)
    if name == "lasso":
        c = float(params.get("C", 1.0))
        return LogisticRegression(elasticNetParam=1.0, regParam=1.0 / (c * max(n_train, 1)),
                                  standardization=False, maxIter=params.get("max_iter", MAX_ITER["lasso"]), tol=tol)
    if name == "svm":
        c = float(params.get("C", 1.0))
        return LinearSVC(regParam=1.0 / (c * max(n_train, 1)), standardization=False,
                         maxIter=params.get("max_iter", MAX_ITER["svm"]), tol=tol)
    if name == "rf":
        return RandomForestClassifier(numTrees=int(params.get("n_estimators", 100)),
                                      maxDepth=int(params.get("max_depth", 5)),
                                      impurity=params.get("criterion", "gini"),
                                      minWeightFractionPerNode=float(params.get("min_samples_leaf", 0.0)),
                                      bootstrap=bool(params.get("bootstrap", True)),
                                      featureSubsetStrategy=params.get("subset", "auto"), seed=seed)
    if name == "gb":
        return GBTClassifier(maxIter=int(params.get("n_estimators", 100)),
                             maxDepth=int(params.get("max_depth", 3)),
                             stepSize=min(max(float(params.get("learning_rate", 0.1)), 1e-6), 1.0),
                             minWeightFractionPerNode=float(params.get("min_samples_leaf", 0.0)),
                             seed=seed)
    raise ValueError(f"unknown model {name}")


def sample_params(name: str, n: int = TRIALS, seed: int = 0, max_trees: int = MAX_TREES) -> list[dict]:
    """Seeded random draws from the study's search spaces (ML10, re-aimed from TPE).

    C and learning rate ~ lognormal(0, 1); kernel one of three, degree 2..8;
    trees ~ randint(max_trees) with a floor of 1; depth 1..10; criterion
    gini/entropy (log-loss is entropy); leaf fraction ~ U(0, 0.1). The solver
    and the split fraction have no Spark counterpart.
    """
    rng = random.Random(f"{name}:{seed}")
    out = []
    for _ in range(n):
        if name == "lasso":
            out.append({"C": math.exp(rng.gauss(0.0, 1.0))})
        elif name == "svm":
            draw = {"C": math.exp(rng.gauss(0.0, 1.0)), "kernel": rng.choice(["rbf", "linear", "poly"]),
                    "degree": rng.randint(2, 8)}
            if draw["kernel"] != "poly":
                del draw["degree"]
            out.append(draw)
        elif name == "rf":
            out.append({"n_estimators": max(1, rng.randrange(max_trees)), "max_depth": rng.randint(1, 10),
                        "criterion": rng.choice(["gini", "entropy", "entropy"]),
                        "min_samples_leaf": rng.uniform(0.0, 0.1)})
        elif name == "gb":
            out.append({"n_estimators": max(1, rng.randrange(max_trees)), "max_depth": rng.randint(1, 10),
                        "learning_rate": math.exp(rng.gauss(0.0, 1.0)),
                        "min_samples_leaf": rng.uniform(0.0, 0.1)})
        else:
            out.append({})
    return out


def fold_scores(train: DataFrame, name: str, draws: Sequence[dict], seed: int = 0, parallelism: int = 32,
                k: int = 5) -> list[list[float]]:
    """Validation F-beta of every draw on every fold (ML9 ML10).

    All folds and draws are fitted at the same time, ``parallelism`` of them as far as their
    copies of the rows fit into memory: a fit of few partitions is mostly waiting. They share ``train``, which is kept in memory, so it
    is read and assembled once however many draws there are.
    """
    if not draws:
        return []
    kept = None if train.is_cached else train.persist()

    def score(place: tuple[int, int]) -> float:
        f, i = place
        model = fit(train.where(F.col("fold") != f), name, draws[i], seed, probabilities=False)
        return evaluate_fbeta(model.predict(train.where(F.col("fold") == f)))

    places = [(f, i) for f in range(k) for i in range(len(draws))]
    try:
        width = RANDOM_FEATURES if name == "svm" else None
        most = fits_at_once(train, len(places), width) if "features" in train.columns else len(places)
        with ThreadPool(max(1, min(parallelism, most))) as pool:
            found = dict(zip(places, pool.map(score, places, chunksize=1)))
    finally:
        if kept is not None:
            kept.unpersist()
    return [[found[f, i] for f in range(k)] for i in range(len(draws))]


def best_draw(scores: Sequence[Sequence[float]]) -> int:
    """The draw with the highest mean over its folds, the first of equals."""
    mean = [sum(s) / len(s) for s in scores]
    return max(range(len(mean)), key=lambda i: (mean[i], -i))


def search(train: DataFrame, name: str, trials: int = TRIALS, seed: int = 0, parallelism: int = 32,
           max_trees: int = MAX_TREES, k: int = 5, draws: Sequence[dict] | None = None):
    """Search by mean fold F-beta on fixed folds, then the best draw fitted on all rows
    (ML9 ML10 ML11). Returns (fitted model, params, F-beta of every draw)."""
    draws = list(draws) if draws is not None else sample_params(name, trials, seed, max_trees)
    if name == "lr" or not draws:
        return fit(train, name, {}, seed), {}, []
    scores = fold_scores(train, name, draws, seed, parallelism, k)
    best = best_draw(scores)
    return fit(train, name, draws[best], seed), draws[best], [sum(s) / len(s) for s in scores]


def search_table(train: DataFrame, name: str, draws: Sequence[dict], seed: int = 0, parallelism: int = 32,
                 k: int = 5) -> DataFrame:
    """(draw, parameters, fold, f_beta, mean_f_beta, best) of a search over ``draws``."""
    scores = fold_scores(train, name, draws, seed, parallelism, k)
    best = best_draw(scores)
    rows = [(i, json.dumps(draws[i], sort_keys=True), f, float(x), sum(s) / len(s), i == best)
            for i, s in enumerate(scores) for f, x in enumerate(s)]
    return train.sparkSession.createDataFrame(
        rows, "draw int, parameters string, fold int, f_beta double, mean_f_beta double, best boolean")


def evaluate_fbeta(predictions: DataFrame) -> float:
    return float(fbeta_evaluator().evaluate(predictions))


# --------------------------------------------------------------------------- fit and score

class FittedModel:
    """A fitted model with its feature map and, for the SVM, its Platt scaling."""

    def __init__(self, name: str, model, mapped=None, platt=None):
        self.name, self.model, self.platt = name, model, platt
        self.mapped = mapped or (lambda df: df)

    def predict(self, df: DataFrame) -> DataFrame:
        return self.model.transform(self.mapped(df))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``pred`` (hard class) and ``pd`` (default probability) (ML12)."""
        out = self.predict(df)
        if self.name == "svm":
            margin = vector_to_array("rawPrediction")[1]
            a, b = self.platt
            out = out.withColumn("pd", sigmoid(F.lit(a) * margin + F.lit(b)))
        else:
            out = out.withColumn("pd", vector_to_array("probability")[1])
        out = out.withColumn("pred", F.col("prediction").cast("int"))
        return out.drop("rawPrediction", "probability", "prediction")


def _margins(model: FittedModel, df: DataFrame) -> DataFrame:
    return model.predict(df).select(vector_to_array("rawPrediction")[1].alias("m"), "label")


def platt_fit(margins: DataFrame, margin: str = "m", label: str = "label", max_iter: int = 100,
              tol: float = 1e-10) -> tuple[float, float]:
    """(slope, intercept) of Platt's sigmoid over margins (ML5): Newton steps with halving on
    the log-loss against his smoothed targets ``(n1 + 1) / (n1 + 2)`` and ``1 / (n0 + 2)``, so
    margins that part the classes entirely give finite numbers. Each step is one
    aggregate over the table. Rows without margin or label take no part."""
    rows = margins.where(F.col(margin).isNotNull() & F.col(label).isNotNull()).select(
        F.col(margin).cast("double").alias("m"), F.col(label).cast("double").alias("y"))
    n1, n0 = rows.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0.0))).first()
    target = F.when(F.col("y") > 0, (n1 + 1) / (n1 + 2)).otherwise(1 / (n0 + 2))

    def sums(a: float, b: float):
        z = F.lit(a) * F.col("m") + F.lit(b)
        p, m = sigmoid(z), F.col("m")
        loss = F.greatest(z, F.lit(0.0)) - target * z + F.log1p(F.exp(-F.abs(z)))
        r = rows.agg(F.sum(loss), F.sum((p - target) * m), F.sum(p - target), F.sum(p * (1 - p) * m * m),
                     F.sum(p * (1 - p) * m), F.sum(p * (1 - p))).first()
        return [float(x or 0.0) for x in r]

    a, b = 0.0, math.log((n1 + 1) / (n0 + 1))
    loss, ga, gb, haa, hab, hbb = sums(a, b)
    for _ in range(max_iter):
        haa, hbb = haa + 1e-12, hbb + 1e-12
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        if ga * da + gb * db <= tol:     # twice what a full step can still gain: this one is the last
            return a - da, b - db
        step = 1.0
        while (now := sums(a - step * da, b - step * db))[0] > loss and step > MIN_STEP:
            step /= 2
        a, b = a - step * da, b - step * db
        loss, ga, gb, haa, hab, hbb = now
    return a, b


OfFold = Callable[[int], FittedModel]


def fold_models(train: DataFrame, name: str, params: dict | None = None, seed: int = 0) -> OfFold:
    """The model without the rows of a fold, fitted when first asked for and kept."""
    kept: dict[int, FittedModel] = {}

    def of(f: int) -> FittedModel:
        if f not in kept:
            kept[f] = fit(train.where(F.col("fold") != f), name, params, seed, probabilities=False)
        return kept[f]
    return of


def fits_at_once(train: DataFrame, wanted: int, width: int | None = None) -> int:
    """How many of ``wanted`` fits to run at the same time. Each keeps its own copy of the rows,
    ``width`` numbers of each (default: the features); more copies than the memory for
    stored blocks holds would go to disk and be read from there in every iteration."""
    attrs = train.schema["features"].metadata.get("ml_attr", {})
    width = width or attrs.get("num_attrs") or len((train.select("features").first() or [()])[0])
    each = 8 * max(1, train.count()) * (width + 2)
    found, it = [], train.sparkSession.sparkContext._jsc.sc().getExecutorMemoryStatus().iterator()
    while it.hasNext():
        found.append(it.next()._2()._1())
    # the driver's own share, which is one of several on a cluster, holds no rows
    memory = sum(found) - (max(found) if len(found) > 1 else 0)
    return int(max(1, min(wanted, memory // (2 * each))))


def all_folds(of_fold: OfFold, k: int, at_once: int | None = None) -> list[FittedModel]:
    """The models without each of ``k`` folds, ``at_once`` of them (default: all) fitted at the
    same time: an iteration of a solver is a short job, and most of it is waiting."""
    with ThreadPool(max(1, min(k, at_once or k))) as pool:
        return pool.map(of_fold, range(k), chunksize=1)


def platt_scaling(train: DataFrame, of_fold: OfFold, k: int = 5) -> tuple[float, float]:
    """Slope and intercept of the probability over margins of rows that the SVM was not
    fitted on: one fit per fold, as margins of its own rows would be too extreme (ML5)."""
    margins = None
    for f, model in enumerate(all_folds(of_fold, k, fits_at_once(train, k))):
        m = _margins(model, train.where(F.col("fold") == f))
        margins = m if margins is None else margins.unionByName(m)
    return platt_fit(materialize(margins, "margins"))


def fit(train: DataFrame, name: str, params: dict | None = None, seed: int = 0,
        probabilities: bool = True, of_fold: OfFold | None = None) -> FittedModel:
    """Fit one family on ``train(features, label, fold)``. The SVM's probabilities cost
    a fit per fold (``of_fold``, if they are there already); without ``probabilities``
    it can only predict classes."""
    params = params or {}
    n = train.count() if name in ("lasso", "svm") else 0
    mapped = kernel_map(params, train, seed) if name == "svm" else None
    model = make_estimator(name, params, n, seed).fit(mapped(train) if mapped else train)
    out = FittedModel(name, model, mapped)
    if name == "svm" and probabilities:
        out.platt = platt_scaling(train, of_fold or fold_models(train, name, params, seed))
    return out


def cv_metrics(train: DataFrame, name: str, params: dict | None = None, k: int = 5,
               fold_col: str = "fold", seed: int = 0, of_fold: OfFold | None = None) -> DataFrame:
    """Mean over folds of accuracy, precision, recall and F-beta (ML8): one fit per
    fold, all four metrics from one long prediction table."""
    preds, of_fold = None, of_fold or fold_models(train, name, params, seed)
    for f, model in enumerate(all_folds(of_fold, k, fits_at_once(train, k))):
        p = model.predict(train.where(F.col(fold_col) == f)).select(
            F.lit(name).alias("model"), F.lit(f).alias("fold"), F.col("label").cast("int").alias("label"),
            F.col("prediction").cast("int").alias("pred"))
        preds = p if preds is None else preds.unionByName(p)
    return fold_mean_metrics(preds)


# --------------------------------------------------------------------------- logit

def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with ``df`` degrees of freedom > x), by its finite sums."""
    if x <= 0:
        return 1.0
    half = x / 2.0
    if df % 2 == 0:
        term = total = math.exp(-half)
        for i in range(1, df // 2):
            term *= half / i
            total += term
        return min(total, 1.0)
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(2 * x / math.pi) * math.exp(-half)
    for r in range(1, (df - 1) // 2 + 1):
        total += term
        term *= x / (2 * r + 1)
    return min(total, 1.0)


class Logit:
    """Logit without intercept: coefficients with inference, and the fit's summary (ML1)."""

    def __init__(self, train: DataFrame, feature_names: Sequence[str], max_iter: int = MAX_ITER["logit"]) -> None:
        self.spark, self.names = train.sparkSession, list(feature_names)
        glr = GeneralizedLinearRegression(family="binomial", link="logit", fitIntercept=False,
                                          maxIter=max_iter, labelCol="label")
        self.model = glr.fit(train)
        row = train.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k")).first()
        self.n, self.positives = int(row["n"]), float(row["k"] or 0.0)

    def table(self, z: float = 1.959963984540054) -> DataFrame:
        """feature, coef, std_err, z, p_value and 95% bounds."""
        s = self.model.summary
        rows = [(name, float(c), float(e), float(t), float(p), float(c) - z * float(e), float(c) + z * float(e))
                for name, c, e, t, p in zip(self.names, self.model.coefficients, s.coefficientStandardErrors,
                                            s.tValues, s.pValues)]
        return self.spark.createDataFrame(
            rows, "feature string, coef double, std_err double, z double, p_value double, ci_low double, ci_high double")

    def summary(self) -> DataFrame:
        """Log-likelihood, that of the constant model, McFadden's R2, the likelihood ratio
        and its p-value (degrees of freedom: coefficients less one)."""
        llf = -float(self.model.summary.deviance) / 2.0
        p = self.positives / self.n
        null = sum(c * math.log(q) for c, q in ((self.positives, p), (self.n - self.positives, 1 - p)) if c)
        df = len(self.names) - 1
        ratio = 2.0 * (llf - null)
        rows = [(self.n, df, llf, null, 1.0 - llf / null if null else None, ratio, chi2_tail(ratio, df) if df else None)]
        return self.spark.createDataFrame(
            rows, "n_obs long, df_model long, llf double, llnull double, pseudo_r2 double, llr double, llr_p double")


def importances(model: FittedModel, feature_names: Sequence[str], top: int | None = 10) -> DataFrame:
    """Gain-based importance of a tree model, ordered, top-k (ML14, ST5)."""
    imp = model.model.featureImportances.toArray()
    df = SparkSession.active().createDataFrame([(n, float(v)) for n, v in zip(feature_names, imp)],
                                               "feature string, importance double")
    df = df.orderBy(F.desc("importance"), "feature")
    return df.limit(top) if top else df


def optimality(model: FittedModel, train: DataFrame, params: dict | None = None) -> DataFrame:
    """(term, coef, gap) of a fitted ``lr`` or ``lasso`` (ML2 ML3): how far each term is from
    the optimality conditions of its objective, per standard deviation of the feature.

    With ``g`` the gradient of the mean log-loss and ``r = 1 / (C n)`` (lasso) or 0, the
    gap is ``|g + r sign(coef)|`` for a coefficient that is not zero, what ``|g|`` exceeds
    ``r`` by for one that is, and ``|g|`` for the intercept. At the optimum all are zero.
    One aggregate over the rows. A constant feature has no gap.
    """
    fitted = model.model
    coef, intercept = [float(c) for c in fitted.coefficients], float(fitted.intercept)
    x = train.select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
    z = F.aggregate(F.zip_with("x", F.lit(coef), lambda a, b: a * b), F.lit(intercept), lambda acc, v: acc + v)
    miss = x.withColumn("e", sigmoid(z) - F.col("y"))
    at = lambda j: F.get("x", F.lit(j))
    r = miss.agg(F.count(F.lit(1)).alias("n"), F.avg("e").alias("g"),
                 *[F.avg(F.col("e") * at(j)).alias(f"g{j}") for j in range(len(coef))],
                 *[F.stddev_pop(at(j)).alias(f"s{j}") for j in range(len(coef))]).first()
    reg = 1.0 / (float((params or {}).get("C", 1.0)) * max(r["n"], 1)) if model.name == "lasso" else 0.0
    rows = [("intercept", intercept, abs(r["g"]))]
    for j, c in enumerate(coef):
        g, sd = r[f"g{j}"], r[f"s{j}"]
        gap = abs(g + math.copysign(reg, c)) if c else max(0.0, abs(g) - reg)
        rows.append((f"x{j}", c, gap / sd if sd else 0.0))
    return train.sparkSession.createDataFrame(rows, "term string, coef double, gap double")
