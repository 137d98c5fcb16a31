"""Aggregations and statistics (AG1-AG10).

Exact order statistics (quartiles, winsorizing bounds) never put a whole column
into one task or the driver:

1. a quantile sketch (``percentile_approx``), one for all ranks of a column, gives
   for each of them a value bracket that should hold it; a column of at most
   ``BRACKET_ROWS`` values is one bracket as it is;
2. one pass counts the values below and inside every bracket; a
   bracket that misses its rank is moved, one with over ``BRACKET_ROWS`` rows is
   narrowed by a sketch of its inside, until every bracket is small;
3. the rows inside the brackets are counted by distinct value, and a running
   count over them picks the exact one.

Only per-(column, rank) scalars reach the driver, and no group is larger than
``BRACKET_ROWS`` whatever the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import fround, nan_to_null, percent_text

SKETCH_ACCURACY = 10000
BRACKET_ROWS = 100_000


def unpivot(df: DataFrame, cols: Sequence[str], name: str = "column", value: str = "value",
            keep: Sequence[str] = ()) -> DataFrame:
    """Wide -> long ``(keep..., name, value)`` with one ``stack`` (no shuffle)."""
    args = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.select(*keep, F.expr(f"stack({len(cols)}, {args}) AS (`{name}`, `{value}`)"))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    num = ("double", "float", "int", "bigint", "smallint", "tinyint")
    return [c for c, t in df.dtypes if c not in ex and (t in num or t.startswith("decimal"))]


def year_means(df: DataFrame, by: str = "fyear", cols: Sequence[str] | None = None) -> DataFrame:
    """Mean of every numeric column per year (AG1); NULLs skipped."""
    cols = list(cols) if cols else [c for c in numeric_columns(df) if c != by]
    return df.groupBy(by).agg(*[nan_to_null(F.avg(c)).alias(c) for c in cols])


def null_census(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing count per column, long form ``(column, n_missing)`` (AG2), one pass."""
    cols = list(cols) if cols else df.columns
    types = dict(df.dtypes)

    def miss(c: str) -> Column:
        m = F.col(c).isNull()
        if types[c] in ("double", "float"):
            m = m | F.isnan(F.col(c))
        return F.sum(F.when(m, 1).otherwise(0)).cast("long")

    wide = df.agg(*[miss(c).alias(c) for c in cols])
    args = ", ".join(f"'{c}', `{c}`" for c in cols)
    return wide.select(F.expr(f"stack({len(cols)}, {args}) AS (`column`, n_missing)"))


# ---------------------------------------------------------------------------
# exact order statistics
# ---------------------------------------------------------------------------

def column_counts(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


class _Bracket:
    """Values that may hold one rank of one column: ``lo <= value <= hi``."""

    def __init__(self, column: str, rank: int) -> None:
        self.column, self.rank = column, rank
        self.lo, self.hi = float("-inf"), float("inf")
        self.below = self.inside = 0

    def holds(self) -> Column:
        v = F.col(self.column).cast("double")
        return (v >= F.lit(self.lo)) & (v <= F.lit(self.hi))

    def small(self) -> bool:
        return self.lo == self.hi or (self.below <= self.rank < self.below + self.inside
                                      and self.inside <= BRACKET_ROWS)


def _shared(brackets: list[_Bracket]) -> list[list[_Bracket]]:
    """Brackets of the same column and values together."""
    groups: dict[tuple, list[_Bracket]] = {}
    for b in brackets:
        groups.setdefault((b.column, b.lo, b.hi), []).append(b)
    return list(groups.values())


def _narrow(df: DataFrame, brackets: list[_Bracket], accuracy: int) -> None:
    """Set every bracket to sketch values around its rank among the values it holds,
    one sketch for all brackets that hold the same values."""
    groups = _shared(brackets)
    aggs = []
    for i, group in enumerate(groups):
        probes = []
        for b in group:
            n = b.inside
            slack = 2 * math.ceil(n / accuracy) + 2
            at = b.rank - b.below
            probes += [max(at - slack, 0) / max(n - 1, 1), min(at + slack, n - 1) / max(n - 1, 1)]
        aggs.append(F.percentile_approx(F.when(group[0].holds(), F.col(group[0].column).cast("double")),
                                        F.array(*[F.lit(p) for p in probes]), accuracy).alias(f"b{i}"))
    row = df.agg(*aggs).first()
    for i, group in enumerate(groups):
        for j, b in enumerate(group):
            b.lo, b.hi = float(row[f"b{i}"][2 * j]), float(row[f"b{i}"][2 * j + 1])


def _masked(df: DataFrame, groups: list[list[_Bracket]], per_batch, schema: str) -> DataFrame:
    """``per_batch(i, x, lo, hi)`` for the i-th group's column of every Arrow batch."""
    cols = sorted({g[0].column for g in groups})
    bounds = [(cols.index(g[0].column), g[0].lo, g[0].hi) for g in groups]

    def run(batches):
        for batch in batches:
            x = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(cols))]
            for i, (k, lo, hi) in enumerate(bounds):
                out = per_batch(i, x[k], lo, hi)
                if out is not None:
                    yield out

    return df.select(*[F.col(c).cast("double").alias(c) for c in cols]).mapInArrow(run, schema)


def _count(df: DataFrame, brackets: list[_Bracket]) -> None:
    """Count the values below and inside every bracket, one pass with sums per batch."""
    groups = _shared(brackets)

    def sums(i, x, lo, hi):
        return pa.RecordBatch.from_pydict({
            "i": np.full(1, i, np.int32), "below": np.array([np.count_nonzero(x < lo)], np.int64),
            "inside": np.array([np.count_nonzero((x >= lo) & (x <= hi))], np.int64)})

    found = {r["i"]: r for r in _masked(df, groups, sums, "i int, below long, inside long")
             .groupBy("i").agg(F.sum("below").alias("below"), F.sum("inside").alias("inside")).collect()}
    for i, group in enumerate(groups):
        for b in group:
            b.below, b.inside = (int(found[i]["below"]), int(found[i]["inside"])) if i in found else (0, 0)


def order_statistics(df: DataFrame, wanted: dict[str, Sequence[int]],
                     accuracy: int = SKETCH_ACCURACY,
                     counts: dict[str, int] | None = None) -> dict[tuple[str, int], float]:
    """Exact 0-based order statistics ``{(column, rank): value}`` over non-missing values."""
    wanted = {c: sorted(set(int(r) for r in rs)) for c, rs in wanted.items() if rs}
    if not wanted:
        return {}
    counts = counts if counts is not None else column_counts(df, list(wanted))
    brackets = [_Bracket(c, r) for c, rs in wanted.items() for r in rs if 0 <= r < counts[c]]
    for b in brackets:
        b.inside = counts[b.column]
    todo = [b for b in brackets if not b.small()]
    while todo:
        before = {id(b): (b.lo, b.hi, b.below) for b in todo}
        _narrow(df, todo, accuracy)
        _count(df, todo)
        for b in todo:
            lo, hi, below = before[id(b)]
            if b.rank < b.below:            # the sketch was off: the rank is below the bracket
                b.lo, b.hi, b.inside, b.below = lo, math.nextafter(b.lo, -math.inf), b.below - below, below
            elif b.rank >= b.below + b.inside:  # or above it
                b.lo, b.hi = math.nextafter(b.hi, math.inf), hi
                b.below += b.inside
                b.inside = max(1, counts[b.column] - b.below)
        # a bracket that the sketch cannot narrow holds few distinct values: a hot one and its neighbours
        todo = [b for b in todo if not b.small() and (b.lo, b.hi) != before[id(b)][:2]]
    return _pick(df, brackets)


def _pick(df: DataFrame, brackets: list[_Bracket]) -> dict[tuple[str, int], float]:
    """The exact values: those inside a bracket only, counted by distinct value."""
    if not brackets:
        return {}
    result = {(b.column, b.rank): b.lo for b in brackets if b.lo == b.hi}
    open_ = [b for b in brackets if b.lo != b.hi]
    if not open_:
        return result
    groups = _shared(open_)

    def distinct(i, x, lo, hi):
        v, c = np.unique(x[(x >= lo) & (x <= hi)], return_counts=True)
        return pa.RecordBatch.from_pydict({"i": np.full(len(v), i, np.int32), "v": v, "c": c}) if len(v) else None

    counted = (_masked(df, groups, distinct, "i int, v double, c long")
               .groupBy("i", "v").agg(F.sum("c").alias("c")))
    w = Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    wants = F.element_at(F.array(*[F.array(*[F.lit(b.rank - b.below) for b in g]) for g in groups]), F.col("i") + 1)
    picked = (counted.withColumn("cum", F.sum("c").over(w)).withColumn("wants", wants)
              .groupBy("i").agg(*[F.min(F.when(F.col("cum") > F.get("wants", F.lit(j)), F.col("v"))).alias(f"v{j}")
                                  for j in range(max(map(len, groups)))]).collect())
    for r in picked:
        for j, b in enumerate(groups[r["i"]]):
            result[b.column, b.rank] = float(r[f"v{j}"])
    return result


def interpolated_quantiles(df: DataFrame, cols: Sequence[str], qs: Sequence[float],
                           counts: dict[str, int] | None = None) -> dict[tuple[str, float], float | None]:
    """Linear-interpolation quantiles (position ``q * (n - 1)``), exact."""
    counts = counts or column_counts(df, cols)
    wanted: dict[str, set[int]] = {}
    for c in cols:
        n = counts[c]
        if n == 0:
            continue
        for q in qs:
            pos = q * (n - 1)
            wanted.setdefault(c, set()).update({math.floor(pos), math.ceil(pos)})
    stats = order_statistics(df, {c: sorted(r) for c, r in wanted.items()}, counts=counts)
    out: dict[tuple[str, float], float | None] = {}
    for c in cols:
        n = counts[c]
        for q in qs:
            if n == 0:
                out[(c, q)] = None
                continue
            pos = q * (n - 1)
            i, j = math.floor(pos), math.ceil(pos)
            a, b = stats[(c, i)], stats[(c, j)]
            t = pos - i
            if i == j or a == b:
                out[(c, q)] = a
            else:
                val = a + (b - a) * t
                out[(c, q)] = None if val != val else val
    return out


def describe(df: DataFrame, cols: Sequence[str], qs: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, std (sample), min, quartiles, max per column, long form (AG4)."""
    spark = df.sparkSession
    base = df.agg(*[F.struct(
        F.count(F.col(c)).alias("count"),
        nan_to_null(F.avg(c)).alias("mean"),
        nan_to_null(F.stddev_samp(c)).alias("std"),
        F.min(F.col(c).cast("double")).alias("min"),
        F.max(F.col(c).cast("double")).alias("max")).alias(c) for c in cols])
    args = ", ".join(f"'{c}', `{c}`" for c in cols)
    long = base.select(F.expr(f"stack({len(cols)}, {args}) AS (`column`, s)")).select("column", "s.*")
    found = long.collect()  # one row per column
    long = spark.createDataFrame(found, long.schema)
    quant = interpolated_quantiles(df, cols, qs, {r["column"]: r["count"] for r in found})
    qnames = [f"q{int(round(q * 100))}" for q in qs]
    schema = T.StructType([T.StructField("column", T.StringType())] +
                          [T.StructField(n, T.DoubleType()) for n in qnames])
    qdf = spark.createDataFrame([(c, *[quant[(c, q)] for q in qs]) for c in cols], schema)
    return long.join(F.broadcast(qdf), "column").select(
        "column", "count", "mean", "std", "min", *qnames, "max")


def summary_na(df: DataFrame, cols: Sequence[str], digits: int = 3) -> DataFrame:
    """Transposed describe rounded to ``digits`` with the missing share as ``'x%'`` (AG5, SC9, SC10)."""
    total = df.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    d = describe(df, cols)
    num = [c for c in d.columns if c not in ("column", "count")]
    na_pct = fround((F.lit(total) - F.col("count")) / F.lit(total) * 100.0, 2)
    return d.select("column",
                    na_pct.alias("na_pct"),
                    percent_text((F.lit(total) - F.col("count")) / F.lit(total) * 100.0).alias("na"),
                    *[fround(F.col(c), digits).alias(c) for c in num])


def winsor_bounds(df: DataFrame, cols: Sequence[str], lower: float = 0.05,
                  upper: float = 0.05) -> dict[str, tuple[float, float] | None]:
    """Rank-based winsorizing bounds per column over its non-missing values.

    With ``n`` present values, ``k_lo = int(lower * n)`` and
    ``k_hi = int(upper * n)``: the ``k_lo`` smallest values become the value
    at rank ``k_lo`` and the ``k_hi`` largest the value at rank ``n - 1 - k_hi``.
    """
    counts = column_counts(df, cols)
    wanted = {}
    for c in cols:
        n = counts[c]
        if n:
            wanted[c] = [int(lower * n), n - 1 - int(upper * n)]
    stats = order_statistics(df, wanted, counts=counts)
    return {c: ((stats[(c, wanted[c][0])], stats[(c, wanted[c][1])]) if c in wanted else None)
            for c in cols}


def winsorize(df: DataFrame, cols: Sequence[str], lower: float = 0.05, upper: float = 0.05,
              bounds: dict | None = None) -> DataFrame:
    """Clip every column to its rank bounds; missing stays missing (AG10).

    Bounds are two scalars per column, inlined as literals: the clip itself is
    a narrow projection in whole-stage codegen.
    """
    bounds = bounds or winsor_bounds(df, cols, lower, upper)
    exprs = []
    for c in df.columns:
        b = bounds.get(c) if c in cols else None
        if b is None:
            exprs.append(F.col(c))
            continue
        lo, hi = b
        x = F.col(c)
        exprs.append(F.when(x < F.lit(lo), F.lit(lo)).when(x > F.lit(hi), F.lit(hi))
                     .otherwise(x).alias(c))
    return df.select(*exprs)


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson correlation, upper triangle, long form (AG6).

    Undefined correlations (constant column, infinite values) are NULL. Each task
    turns its Arrow batches into masked matrix products and emits one row of
    sums per pair; Spark adds them up. Values are shifted by the column mean
    first, so nothing cancels.
    """
    cols = list(cols)
    k = len(cols)
    first = df.agg(*[F.avg(F.when(F.abs(F.col(c).cast("double")) < float("inf"), F.col(c).cast("double"))).alias(c)
                     for c in cols]).first()
    shift = np.array([first[c] if first[c] is not None else 0.0 for c in cols])
    left, right = np.triu_indices(k, 1)

    def sums(batches):
        n, sx, sxx, sxy = (np.zeros((k, k)) for _ in range(4))
        infinite = np.zeros((k, k))
        for batch in batches:
            x = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]).astype(float)
            there = ~np.isnan(x)
            endless = np.isinf(x)
            x = np.where(there & ~endless, x - shift, 0.0)
            m = there.astype(float)
            n += m.T @ m
            sx += x.T @ m             # sum of column i over rows where j is present
            sxx += (x * x).T @ m
            sxy += x.T @ x
            infinite += endless.astype(float).T @ m
        yield pa.RecordBatch.from_pydict({
            "i": left, "j": right, "n": n[left, right], "sx": sx[left, right], "sy": sx[right, left],
            "sxx": sxx[left, right], "syy": sxx[right, left], "sxy": sxy[left, right],
            "endless": infinite[left, right] + infinite[right, left]})

    parts = ("n", "sx", "sy", "sxx", "syy", "sxy", "endless")
    total = (df.select(*[F.col(c).cast("double").alias(c) for c in cols])
             .mapInArrow(sums, "i long, j long, " + ", ".join(f"{p} double" for p in parts))
             .groupBy("i", "j").agg(*[F.sum(p).alias(p) for p in parts]))
    c = F.col
    var_x, var_y = c("sxx") - c("sx") * c("sx") / c("n"), c("syy") - c("sy") * c("sy") / c("n")
    # a constant side leaves only rounding errors of the shifted sums
    eps = 1e-13
    defined = ((c("n") > 1) & (c("endless") == 0) & (var_x > eps * c("sxx")) & (var_y > eps * c("syy")))
    r = F.when(defined, F.try_divide(c("sxy") - c("sx") * c("sy") / c("n"), F.sqrt(var_x * var_y)))
    name = F.array(*[F.lit(x) for x in cols])
    return total.select(F.element_at(name, (c("i") + 1).cast("int")).alias("col_a"),
                        F.element_at(name, (c("j") + 1).cast("int")).alias("col_b"), nan_to_null(r).alias("r"))


def collinear(corr_long: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with ``|r| >= threshold`` (AG7)."""
    return corr_long.where(F.abs(F.col("r")) >= threshold)


def distinct_count(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> Column:
    """Distinct keys (AG8); ``approx`` uses HyperLogLog++."""
    return F.approx_count_distinct(col, rsd) if approx else F.countDistinct(col)


def class_balance(df: DataFrame, label: str = "default") -> DataFrame:
    """Positives, negatives, ratio positives/negatives and positive share (AG9)."""
    pos = F.sum(F.when(F.col(label) == 1, 1).otherwise(0))
    neg = F.sum(F.when(F.col(label) == 0, 1).otherwise(0))
    return df.agg(pos.cast("long").alias("n_pos"), neg.cast("long").alias("n_neg"),
                  (pos / F.nullif(neg, F.lit(0))).alias("ratio"),
                  (pos / F.count(F.lit(1))).alias("share"))
