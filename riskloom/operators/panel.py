"""Firm-year panel: cleaning, lags with a gap guard, ratios, macro join, missing rules.

Operators: PR1 PR4 PR5 PR10 PR14 PR15 WN1 WN2 SC11 JN1.
All functions are lazy ``DataFrame -> DataFrame``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import ieee_div, ln_ieee, sub
from ..sources.schemas import FIN_DROPPED, RATIOS

LAGGED = ["rect", "at", "sale", "emp", "roe"]


def parse_date(c: Column | str, fmt: str, strict: bool = True) -> Column:
    """Text or number -> DATE. A malformed value raises, or is NULL if not ``strict``."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    date = F.try_to_date(text, fmt)
    if not strict:
        return date
    bad = F.raise_error(F.concat(F.lit(f"not a date of the form {fmt}: "), text)).cast("date")
    return F.when(text.isNotNull() & date.isNull(), bad).otherwise(date)


def yyyymmdd_to_date(c: Column | str, strict: bool = True) -> Column:
    """``20220316`` (int or string) -> DATE (PR4)."""
    return parse_date(c, "yyyyMMdd", strict)


def yyyymmdd_number_to_date(c: Column | str, strict: bool = True) -> Column:
    """:func:`yyyymmdd_to_date` of an integer column. Days up to the 28th of any month are
    taken apart as a number; all others, malformed ones too, go through text."""
    n = F.col(c) if isinstance(c, str) else c
    month, day = F.floor(n / 100) % 100, n % 100
    plain = n.between(10000101, 99991231) & month.between(1, 12) & day.between(1, 28)
    date = F.make_date(F.floor(n / 10000).cast("int"), month.cast("int"), day.cast("int"))
    return F.when(plain, date).otherwise(yyyymmdd_to_date(n, strict))


def clean_financials(fin: DataFrame, drop_cols: Sequence[str] = tuple(FIN_DROPPED),
                     min_emp: float = 0.0) -> DataFrame:
    """Drop bookkeeping columns, keep ``emp > min_emp``, replace ``dltt`` 0 by 1.

    The ``emp`` filter runs before the lag, as in the study, so a year removed
    here opens a gap for the next year (PR1 PR5 PR10).
    """
    present = [c for c in drop_cols if c in fin.columns]
    out = fin.drop(*present).where(F.col("emp") > min_emp)
    if dict(out.dtypes).get("datadate") in ("int", "bigint", "string"):
        out = out.withColumn("datadate", yyyymmdd_to_date("datadate"))
    return out.withColumn("dltt", F.when(F.col("dltt") == 0, F.lit(1.0)).otherwise(F.col("dltt")))


def add_lags(fin: DataFrame, cols: Sequence[str] = tuple(LAGGED), key: str = "gvkey",
             order: Sequence[str] = ("datadate", "fyear"), year: str = "fyear",
             prefix: str = "lag_") -> DataFrame:
    """Per-firm lag-1 of ``cols``, kept only when the fiscal years are consecutive.

    One window (one shuffle on ``key``) serves all lags and the gap guard
    (WN1 WN2). ``roe = ni / ceq`` is derived first when requested.
    """
    out = fin
    if "roe" in cols and "roe" not in fin.columns:
        out = out.withColumn("roe", ieee_div("ni", "ceq"))
    w = Window.partitionBy(key).orderBy(*order)
    consecutive = (F.col(year) - F.lag(year, 1).over(w)) == 1
    return out.select("*", *[
        F.when(consecutive, F.lag(c, 1).over(w)).alias(prefix + c) for c in cols
    ])


def ratio_exprs() -> dict[str, Column]:
    """The 19 named ratios (SC11), each one IEEE-style division or log."""
    c = F.col
    return {
        "L1": ieee_div("wcap", "at"),
        "L2": ieee_div("act", sub("at", "act")),
        "L3": ieee_div(ieee_div(c("ibc") + c("dp"), "at"), "dltt"),
        "L4": ieee_div(c("oancf") + c("ivncf") + c("fincf"), "sale"),
        "L5": ieee_div("dlc", "act"),
        "L6": ieee_div("ch", "at"),
        "P1": ieee_div("re", "at"),
        "P2": ieee_div("ni", "at"),
        "P3": ieee_div("ebitda", "sale"),
        "E1": ieee_div("ebitda", "at"),
        "E2": ieee_div("sale", "at"),
        "E3": ieee_div((c("rect") + c("lag_rect")) / 2.0, "sale"),
        "R1": ieee_div(c("pstkc") + c("csho"), "at"),
        "R2": ieee_div(sub("lt", "che"), "ebitda"),
        "G1": ieee_div(sub("at", "lag_at"), "lag_at"),
        "G2": ieee_div(sub("sale", "lag_sale"), "lag_sale"),
        "G3": sub("roe", "lag_roe"),
        "G4": ieee_div(sub("emp", "lag_emp"), "lag_emp"),
        "S": ln_ieee("at"),
    }


def add_ratios(fin: DataFrame, keep: Sequence[str] = ("gvkey", "datadate", "fyear"),
               tail: Sequence[str] = ("gsector",)) -> DataFrame:
    """Select keys, the 19 ratios and trailing columns in the study's order."""
    ex = ratio_exprs()
    return fin.select(*keep, *[ex[r].alias(r) for r in RATIOS], *tail)


def join_macro(pred: DataFrame, macro: DataFrame, year_col: str = "year",
               on: str = "fyear") -> DataFrame:
    """Inner join of a yearly macro series (PR3 rename + JN1).

    The macro table is a few rows, one per year; the planner sees its size and
    decides whether to broadcast it.
    """
    m = macro.withColumnRenamed(year_col, on) if year_col != on else macro
    return pred.join(m, on=on, how="inner").select(*pred.columns, *[
        x for x in m.columns if x != on])


def present_count(df: DataFrame, cols: Sequence[str]) -> Column:
    """Number of non-missing cells among ``cols``; NaN is missing, +-inf is present."""
    types = dict(df.dtypes)
    acc = F.lit(0)
    for c in cols:
        ok = F.col(c).isNotNull()
        if types[c] in ("double", "float"):
            ok = ok & ~F.isnan(F.col(c))
        acc = acc + F.when(ok, 1).otherwise(0)
    return acc


def drop_missing(df: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Drop rows with a missing value in ``subset`` (PR14)."""
    return df.na.drop(how="any", subset=list(subset))


def keep_thresh(df: DataFrame, thresh: int, subset: Sequence[str] | None = None) -> DataFrame:
    """Keep rows with at least ``thresh`` present cells (PR15)."""
    return df.na.drop(thresh=thresh, subset=list(subset) if subset else None)


def thresh_sweep(df: DataFrame, thresholds: Sequence[int],
                 subset: Sequence[str] | None = None) -> DataFrame:
    """Rows kept at each threshold, plus complete rows, in one aggregation pass."""
    cols = list(subset) if subset else df.columns
    npres = present_count(df, cols)
    aggs = [F.sum(F.when(npres >= t, 1).otherwise(0)).cast("long").alias(f"thresh_{t}")
            for t in thresholds]
    aggs.append(F.sum(F.when(npres == len(cols), 1).otherwise(0)).cast("long").alias("complete"))
    return df.agg(*aggs)
