"""Confusion matrix and classification metrics over a long prediction table (AG11 AG12 ML13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BETA = 2.0


def confusion(preds: DataFrame, by: Sequence[str] = ("model",), label: str = "label",
              pred: str = "pred") -> DataFrame:
    """tn, fp, fn, tp per group in one aggregation (AG11)."""
    y, p = F.col(label), F.col(pred)

    def cnt(cond: Column) -> Column:
        return F.sum(F.when(cond, 1).otherwise(0)).cast("long")

    return preds.groupBy(*by).agg(
        cnt((y == 0) & (p == 0)).alias("tn"), cnt((y == 0) & (p == 1)).alias("fp"),
        cnt((y == 1) & (p == 0)).alias("fn"), cnt((y == 1) & (p == 1)).alias("tp"))


def _safe_ratio(num: Column, den: Column) -> Column:
    """0 when the denominator is 0 (the usual zero-division convention)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def metrics_from_confusion(cm: DataFrame, beta: float = BETA) -> DataFrame:
    """accuracy, precision, recall and F-beta from tn/fp/fn/tp (AG12)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    b2 = beta * beta
    return cm.select(
        "*",
        _safe_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _safe_ratio(tp, tp + fp).alias("precision"),
        _safe_ratio(tp, tp + fn).alias("recall"),
        _safe_ratio(F.lit(1.0 + b2) * tp, F.lit(1.0 + b2) * tp + F.lit(b2) * fn + fp).alias("f_beta"))


def classification_metrics(preds: DataFrame, by: Sequence[str] = ("model",),
                           label: str = "label", pred: str = "pred", beta: float = BETA) -> DataFrame:
    return metrics_from_confusion(confusion(preds, by, label, pred), beta)


def fold_mean_metrics(preds: DataFrame, by: Sequence[str] = ("model",), fold: str = "fold",
                      label: str = "label", pred: str = "pred", beta: float = BETA) -> DataFrame:
    """Metrics per fold, then their mean (the cross-validated score, ML8)."""
    m = classification_metrics(preds, [*by, fold], label, pred, beta)
    return m.groupBy(*by).agg(*[F.avg(c).alias(c) for c in ("accuracy", "precision", "recall", "f_beta")])
