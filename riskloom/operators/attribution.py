"""Per-row attribution of tree and linear models (ML15).

Path-dependent TreeSHAP (Lundberg, Erion and Lee, "Consistent individualized
feature attribution for tree ensembles", 2018) in log-odds, computed leaf by
leaf for all rows of a batch at once. On the path to a leaf a feature either
lets a row through or not (0 or 1), and lets through a share of the training
rows (its cover). A feature's Shapley value for the leaf is a sum over subsets
of the other features of the path, which the coefficients of a product of
two-term polynomials add up. The fitted trees (a few kB) are broadcast; rows
are scored where they lie. Output is long: one row per (row key, feature).

For Spark's GBT the probability is ``1 / (1 + exp(-2 F))`` with
``F = sum_t w_t tree_t(x)``, so the log-odds are ``2 F``. The attributions
plus the base value add up to exactly that.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import sigmoid


def _tree_arrays(tree) -> dict:
    """Flatten a Spark decision tree into arrays (children, split, value, cover)."""
    left, right, feat, thr, val, cover = [], [], [], [], [], []

    def add(node) -> int:
        i = len(left)
        left.append(-1), right.append(-1), feat.append(-1), thr.append(0.0)
        val.append(float(node.prediction())), cover.append(float(node.impurityStats().count()))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            feat[i] = int(split.featureIndex())
            thr[i] = float(split.threshold())
            left[i] = add(node.leftChild())
            right[i] = add(node.rightChild())
        return i

    add(tree._java_obj.rootNode())
    return {k: np.array(v) for k, v in
            dict(left=left, right=right, feat=feat, thr=thr, val=val, cover=cover).items()}


def _expected(t: dict, i: int = 0) -> float:
    if t["left"][i] < 0:
        return t["val"][i]
    l, r = t["left"][i], t["right"][i]
    return (t["cover"][l] * _expected(t, l) + t["cover"][r] * _expected(t, r)) / t["cover"][i]


def _leaves(t: dict) -> list[tuple[float, list[tuple[int, float, float, float]]]]:
    """(value, path) of every leaf; the path has one entry per feature: (feature,
    share of the training rows it lets through, lowest and highest value it lets through)."""
    out = []

    def walk(i: int, path: dict[int, tuple[float, float, float]]) -> None:
        if t["left"][i] < 0:
            out.append((float(t["val"][i]), [(f, *p) for f, p in path.items()]))
            return
        f, cut = int(t["feat"][i]), float(t["thr"][i])
        share, lo, hi = path.get(f, (1.0, -np.inf, np.inf))
        for child, bounds in ((t["left"][i], (lo, min(hi, cut))), (t["right"][i], (max(lo, cut), hi))):
            walk(child, {**path, f: (share * t["cover"][child] / t["cover"][i], *bounds)})

    walk(0, {})
    return out


def shapley(x: np.ndarray, leaves: list, scale: float, phi: np.ndarray) -> None:
    """Add the Shapley values of one tree to ``phi`` (rows x features)."""
    for value, path in leaves:
        d = len(path)
        if d == 0 or value == 0.0:
            continue
        # a row passes a feature's splits if lo < x <= hi
        one = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, _, lo, hi in path]
        for k, (f, zero, _, _) in enumerate(path):
            # coefficients by the number of features taken as known, the k-th left out
            poly = np.zeros((d, len(x)))
            poly[0] = 1.0
            for n, j in enumerate(j for j in range(d) if j != k):
                poly[1:n + 2] = poly[1:n + 2] * path[j][1] + poly[:n + 1] * one[j]
                poly[0] *= path[j][1]
            weight = np.array([math.factorial(s) * math.factorial(d - s - 1) / math.factorial(d) for s in range(d)])
            phi[:, f] += scale * value * (one[k] - zero) * (weight @ poly)


def gbt_attribution(model, df: DataFrame, key: str, features: Sequence[str],
                    features_col: str = "features") -> DataFrame:
    """Long table ``(key, feature, value, phi, base)`` of log-odds attributions.

    ``base`` is the model's expected log-odds; ``base + sum(phi)`` equals the
    row's log-odds.
    """
    trees = [_tree_arrays(tr) for tr in model.trees]
    weights = [float(w) for w in model.treeWeights]
    base = 2.0 * sum(w * _expected(t) for w, t in zip(weights, trees))
    sent = df.sparkSession.sparkContext.broadcast([(w, _leaves(t)) for w, t in zip(weights, trees)])
    feats = list(features)
    arr = df.select(F.col(key), vector_to_array(features_col).alias("_x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            x = np.stack(b["_x"].to_numpy()).astype(float)
            phi = np.zeros(x.shape)
            for w, leaves in sent.value:
                shapley(x, leaves, 2.0 * w, phi)
            yield pd.DataFrame({key: np.repeat(b[key].to_numpy(), len(feats)), "feature": feats * len(x),
                                "value": x.ravel(), "phi": phi.ravel()})

    schema = T.StructType([T.StructField(key, arr.schema[key].dataType), T.StructField("feature", T.StringType()),
                           T.StructField("value", T.DoubleType()), T.StructField("phi", T.DoubleType())])
    return arr.mapInPandas(run, schema).withColumn("base", F.lit(base))


def linear_attribution(model, df: DataFrame, key: str, features: Sequence[str], background: DataFrame | None = None,
                       features_col: str = "features") -> DataFrame:
    """The same long table for a linear model: ``phi = coef (x - mean)`` in log-odds, with the
    means of ``background`` (default: ``df``), and ``base`` the log-odds at the means, so
    ``base + sum(phi)`` equals the row's log-odds. Column expressions only.

    These are the Shapley values of a linear model whose features are taken as
    independent. ``model`` is a fitted Spark classifier with coefficients and intercept.
    """
    coef, feats = [float(c) for c in model.coefficients], list(features)
    given = (df if background is None else background).select(vector_to_array(features_col).alias("_x"))
    means = given.agg(*[F.avg(F.get("_x", F.lit(j))).alias(f"m{j}") for j in range(len(feats))]).first()
    mean = [float(means[j] if means[j] is not None else 0.0) for j in range(len(feats))]
    base = float(model.intercept) + sum(c * m for c, m in zip(coef, mean))
    terms = F.array(*[F.struct(F.lit(f).alias("feature"), F.get("_x", F.lit(j)).alias("value"),
                               (F.lit(coef[j]) * (F.get("_x", F.lit(j)) - F.lit(mean[j]))).alias("phi"))
                      for j, f in enumerate(feats)])
    rows = df.select(F.col(key), vector_to_array(features_col).alias("_x")).select(key, F.explode(terms).alias("_t"))
    return rows.select(key, "_t.feature", "_t.value", "_t.phi", F.lit(base).alias("base"))


def dependence(attr: DataFrame, features: Sequence[str]) -> DataFrame:
    """Value and attribution of chosen features over all rows."""
    return attr.where(F.col("feature").isin(*features)).drop("base")


def breakdown(attr: DataFrame, key: str, rows: DataFrame) -> DataFrame:
    """All attributions of the rows in ``rows(key)``, with each row's log-odds."""
    own = attr.join(rows.select(key).distinct(), key, "left_semi")
    total = own.groupBy(key).agg((F.first("base") + F.sum("phi")).alias("margin"))
    return own.join(total, key)


def probabilities(attr: DataFrame, key: str) -> DataFrame:
    """Expected and estimated probability of every row, through the logistic function."""
    per_row = attr.groupBy(key).agg(F.first("base").alias("base"), (F.first("base") + F.sum("phi")).alias("margin"))
    return per_row.select(key, "base", "margin", sigmoid("base").alias("expected_pd"), sigmoid("margin").alias("pd"))


def mean_abs_ranking(attr: DataFrame, top: int | None = 10) -> DataFrame:
    """Global ranking by mean |phi| (the summary of per-row attributions), top-k (ST5)."""
    r = attr.groupBy("feature").agg(F.avg(F.abs("phi")).alias("mean_abs_phi")).orderBy(
        F.desc("mean_abs_phi"), "feature")
    return r.limit(top) if top else r
