"""Feature preparation: ranks within strata, split, folds, one-hot, KNN imputation.

Operators: ST4 SP1 SP2 FE1 FE2 IM1.

``ranks_within`` gives every row its exact 0-based rank inside its stratum
without a window over the whole stratum (see its docstring).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(cols: Sequence[str], seed: int | str = 42) -> Column:
    """Seeded pseudo-random order key: first 52 bits of ``md5(seed:key...)`` (ST4).

    The same md5 prefix is available in SQL engines, so orders can be checked.
    """
    parts = [F.lit(str(seed))] + [F.col(c).cast("string") for c in cols]
    h = F.md5(F.concat_ws(":", *parts))
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("long")


HASH_BITS = 52


def ranks_within(df: DataFrame, strata: Sequence[str], order: Sequence[str],
                 out: str = "rank", buckets: int | None = None) -> DataFrame:
    """Exact 0-based rank of each row inside its stratum by ``order`` (tie-free).

    ``order[0]`` must be a :func:`hash_order` value, uniform on [0, 2^52). Its
    top bits give a bucket that is monotone in the order, so a row's rank is
    the number of rows of its stratum in earlier buckets (a table with one row
    per stratum and bucket) plus its row number inside its bucket. Buckets hold
    about ``n / buckets`` rows each whatever the class balance, so no stratum
    is ranked by a single task, and every step is deterministic.
    """
    spark = df.sparkSession
    nb = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.withColumn("_b", F.floor(F.col(order[0]).cast("double") * (nb / float(2 ** HASH_BITS)))
                      .cast("int"))
    w = Window.partitionBy(*strata, "_b").orderBy(*order)
    local = d.withColumn("_local", F.row_number().over(w) - 1)
    counts = d.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    wc = (Window.partitionBy(*strata) if strata else Window).orderBy("_b").rowsBetween(
        Window.unboundedPreceding, -1)
    # bounded: one row per (stratum, bucket)
    offsets = counts.select(*[F.col(s).alias(f"_o_{s}") for s in strata], F.col("_b").alias("_ob"),
                            F.coalesce(F.sum("_n").over(wc), F.lit(0)).alias("_off"))
    cond = [F.col("_b") == F.col("_ob")] + [F.col(s).eqNullSafe(F.col(f"_o_{s}")) for s in strata]
    joined = local.join(offsets, cond, "inner")
    return joined.select(*df.columns, (F.col("_local") + F.col("_off")).alias(out))


MAX_LEVELS = 10_000


def _bounded(df: DataFrame, what: str) -> list:
    """Rows of a table that must be small; raises instead of filling the driver."""
    rows = df.limit(MAX_LEVELS + 1).collect()
    if len(rows) > MAX_LEVELS:
        raise ValueError(f"{what} has more than {MAX_LEVELS} values")
    return rows


def class_counts(df: DataFrame, label: str) -> dict:
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return {r[label]: int(r["n"]) for r in _bounded(counts, label)}


def stratified_split(df: DataFrame, key: Sequence[str], label: str, test_size: float = 0.2,
                     seed: int = 0, out: str = "split") -> DataFrame:
    """Per class, the first ``round(test_size * n_c)`` rows in seeded hash order are
    ``'test'``, the rest ``'train'`` (SP1). Exact per class, disjoint, exhaustive."""
    counts = class_counts(df, label)
    cut = F.lit(None).cast("long")
    for c, n in counts.items():
        cut = F.when(F.col(label) == F.lit(c), F.lit(int(_round_half_up(test_size * n)))).otherwise(cut)
    r = ranks_within(df.withColumn("_h", hash_order(key, seed)), [label], ["_h", *key], "_r")
    return r.withColumn(out, F.when(F.col("_r") < cut, "test").otherwise("train")).drop("_h", "_r")


def _round_half_up(x: float) -> int:
    return int(math.floor(x + 0.5))


def threshold_split(df: DataFrame, key: Sequence[str], test_size: float = 0.2, seed: int = 0,
                    out: str = "split") -> DataFrame:
    """``'test'`` where the seeded hash of the key lies below ``test_size`` of its range (SP1).

    A row decides for itself: no rank, no window, no count, no shuffle, and a row
    keeps its side when others come or go. Shares hold on average, not exactly, in
    every class alike. A null key part counts as absent.
    """
    cut = int(test_size * 2 ** HASH_BITS)
    return df.withColumn(out, F.when(hash_order(key, seed) < F.lit(cut), "test").otherwise("train"))


def stratified_folds(df: DataFrame, key: Sequence[str], label: str, k: int = 5,
                     seed: int = 0, out: str = "fold") -> DataFrame:
    """Fold id = rank within class (seeded hash order) mod k (SP2): class counts per
    fold differ by at most one."""
    r = ranks_within(df.withColumn("_h", hash_order(key, seed)), [label], ["_h", *key], "_r")
    return r.withColumn(out, (F.col("_r") % k).cast("int")).drop("_h", "_r")


def one_hot(df: DataFrame, col: str, levels: Sequence, drop_first: bool = True,
            prefix: str | None = None) -> DataFrame:
    """0/1 indicator per level (sorted), first level dropped; a missing value is all zeros (FE1)."""
    lv = sorted(levels)
    if drop_first:
        lv = lv[1:]
    p = prefix if prefix is not None else col
    return df.select(*[c for c in df.columns if c != col],
                     *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).alias(f"{p}_{v}") for v in lv])


def observed_levels(df: DataFrame, col: str) -> list:
    """Distinct non-missing levels of a categorical column (at most ``MAX_LEVELS``)."""
    return sorted(r[0] for r in _bounded(df.select(col).where(F.col(col).isNotNull()).distinct(), col))


def knn_impute(df: DataFrame, key: str, features: Sequence[str], k: int = 5,
               donors: DataFrame | None = None) -> DataFrame:
    """Fill each missing feature with the mean of that feature over the ``k`` nearest
    rows that have it, by NaN-aware Euclidean distance over all ``features`` (IM1).

    Ties are broken by ``key``. A row with no donor at a finite distance gets the
    column mean. Every missing cell is one query, all features are searched in
    one job, and the result is joined back once. ``donors`` (default: ``df``)
    restricts the rows that neighbours and means are taken from.
    """
    from .neighbors import PivotTree

    feats = list(features)
    base = df.select(F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in feats])
    given = base if donors is None else donors.select(
        F.col(key).cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in feats])
    means = given.agg(*[F.avg(c).alias(c) for c in feats]).first()
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(feats)]))
    cells = base.withColumn("need", F.explode(gaps))
    nn = PivotTree(given, feats, "id").found(cells, k, "id", "need")
    mean = F.avg("value")
    repeated = given.groupBy("id").agg(F.count(F.lit(1)).alias("times")).where(F.col("times") > 1)
    if not repeated.isEmpty():
        # all rows of a key that comes several times count wherever it is found
        totals = given.join(repeated, "id").groupBy(F.col("id").alias("pid"), "times").agg(
            F.array(*[F.sum(F.coalesce(F.col(c), F.lit(float("nan")))) for c in feats]).alias("totals"))
        nn = nn.join(totals, "pid", "left")
        total = F.coalesce(F.element_at("totals", (F.col("need") + 1).cast("int")), F.col("value"))
        mean = F.sum(total) / F.sum(F.coalesce("times", F.lit(1)))
    found = (nn.groupBy("qid", "need").agg(mean.alias("value"))
             .groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("need", "value"))).alias("filled")))
    joined = df.join(found, F.col(key).cast("long") == F.col("qid"), "left")
    return joined.select(*[
        F.coalesce(F.col(c).cast("double"), F.try_element_at("filled", F.lit(feats.index(c)).cast("long")),
                   F.lit(means[c]).cast("double")).alias(c) if c in feats else F.col(c) for c in df.columns])
