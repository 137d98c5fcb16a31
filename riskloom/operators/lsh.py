"""Approximate k-nearest neighbours by locality-sensitive hash tables (RS1 for a large minority).

Each table cuts space by ``m`` random projections, shifted and rounded to a width
(Datar et al., 2004): points that share all ``m`` numbers share a bucket, and a
query is compared with the points of its buckets. How many tables and
projections there are, and how wide they are, follows from the data: a bounded
sample of points is compared with all points, which gives the distances at which
neighbours lie, and with itself, which gives those of any two points. Of the
settings that should find ``recall`` of the sample's neighbours the one with the
fewest comparisons is taken. All points are indexed.

A bucket is never cut short: large ones are compared block by block, small
ones many to a group. Queries that meet fewer than ``k`` points are answered by
the exact search.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .neighbors import PivotTree, _search, _top, nearest, vector

SAMPLE = 256              # points that are compared with all others to choose the tables
MAX_TABLES = 48
MAX_PROJECTIONS = 24
POINT_BLOCK = 20_000      # of a bucket that is searched by blocks
GROUP = 20_000            # rows of small buckets that one group takes together


def collision(distance: np.ndarray, width: float) -> np.ndarray:
    """Probability that one projection rounds two points at a distance alike."""
    t = width / np.maximum(distance, 1e-300)
    tail = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in np.ravel(np.minimum(t, 1e6))]).reshape(np.shape(t))
    return np.clip(1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * t) * (1 - np.exp(-t * t / 2)), 0.0, 1.0)


@dataclass
class Tables:
    """Settings of the hash tables and what they should find and cost."""

    width: float
    projections: int
    tables: int
    expected_recall: float
    expected_share: float     # of all points, compared per query, counting repeats


def choose(near: np.ndarray, any_two: np.ndarray, recall: float) -> Tables:
    """The cheapest settings that find ``recall`` of neighbours at the distances ``near``
    where any two points lie at the distances ``any_two``."""
    scale = float(np.median(near[near > 0])) if (near > 0).any() else 1.0
    best = None
    for width in scale * 2.0 ** np.arange(-1, 7.5, 0.5):
        p, q = collision(near, width), collision(any_two, width)
        for m in range(1, MAX_PROJECTIONS + 1):
            miss = 1 - p ** m
            for tables in (1, 2, 3, 4, 6, 8, 12, 16, 24, 32, MAX_TABLES):
                found = float(np.mean(1 - miss ** tables))
                if found >= recall:
                    share = tables * float(np.mean(q ** m))
                    if best is None or share < best.expected_share:
                        best = Tables(float(width), m, tables, found, share)
                    break
    return best or Tables(scale * 1e6, 1, 1, 1.0, 1.0)


def _sampled(points: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distances from a bounded sample of points to their k nearest others, and among the sample."""
    rows = points.orderBy(F.xxhash64("pid"), "pid").limit(SAMPLE).collect()
    some = pd.DataFrame({"qid": [r["pid"] for r in rows], "need": -1, "v": [np.array(r["v"], float) for r in rows]})
    sent = points.sparkSession.sparkContext.broadcast(some)

    def run(batches):
        for b in batches:
            if len(b):
                yield _top(sent.value, b, k, True)

    near = nearest(points.mapInPandas(run, "qid long, need long, pid long, dist double"), k)
    found = np.array([r["dist"] for r in near.select("dist").collect()], float)  # at most SAMPLE * k
    x = np.stack(some["v"].to_numpy()) if len(some) else np.zeros((0, 1))
    i, j = np.triu_indices(len(x), 1)
    return found, np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1))


class HashIndex:
    """All of ``points(id_col, features...)`` in hash tables. Coordinates must be present
    (a missing one raises): distances that leave some out have no buckets."""

    def __init__(self, points: DataFrame, features: Sequence[str], k: int, id_col: str = "id", recall: float = 0.95,
                 seed: int = 0) -> None:
        self.source, self.features, self.id_col, self.k = points, list(features), id_col, k
        missing = F.exists(vector(self.features), lambda x: F.isnan(x))
        v = F.when(missing, F.raise_error(F.lit("a coordinate is missing")).cast("array<double>")).otherwise(
            vector(self.features))
        self._vector = v
        self.points = points.select(F.col(id_col).cast("long").alias("pid"), v.alias("v"))
        near, any_two = _sampled(self.points, k)
        self.tables = choose(near, any_two, recall) if len(near) and len(any_two) else Tables(1.0, 1, 1, 1.0, 1.0)
        rng = np.random.default_rng(seed)
        t, m = self.tables.tables, self.tables.projections
        self._lines = rng.normal(size=(len(self.features), t * m)) / self.tables.width
        self._shift = rng.uniform(size=t * m)
        self._mix = rng.integers(1, 1 << 62, t * m) | 1

    def _hashed(self, rows: DataFrame, id_name: str) -> DataFrame:
        """(id, v, cell): each row once per table."""
        lines, shift, mix, t = self._lines, self._shift, self._mix, self.tables.tables

        def run(batches):
            for b in batches:
                if not len(b):
                    continue
                at = np.floor(np.stack(b["v"].to_numpy()) @ lines + shift).astype(np.int64)
                cell = (at * mix).reshape(len(b), t, -1).sum(axis=2)        # wraps around
                table = np.broadcast_to(np.arange(t), cell.shape).ravel()
                yield pd.DataFrame({id_name: np.repeat(b[id_name].to_numpy(), t), "v": np.repeat(b["v"].to_numpy(), t),
                                    "cell": [f"{a}:{c}" for a, c in zip(table, cell.ravel())]})

        return rows.select(id_name, "v").mapInPandas(run, f"{id_name} long, v array<double>, cell string")

    def search(self, rows: DataFrame, exclude_self: bool = False) -> DataFrame:
        """``(qid, need, pid, dist, nn)`` for the k nearest of the points that share a bucket."""
        k = self.k
        qs = rows.select(F.col(self.id_col).cast("long").alias("qid"), self._vector.alias("v"))
        visits = materialize(self._hashed(qs, "qid").withColumn("need", F.lit(-1).cast("long")), "lsh-queries")
        points = self._hashed(self.points, "pid")
        points = materialize(points.join(visits.select("cell").distinct(), "cell", "left_semi"), "lsh-points")
        sizes = materialize(points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "lsh-sizes")
        large = sizes.where(F.col("n") > POINT_BLOCK)
        found = self._small(visits, points, large, exclude_self)
        if not large.isEmpty():
            found = found.unionByName(_search(visits.join(large.select("cell"), "cell", "left_semi"), points, large, k,
                                              exclude_self, False))
        # one pair may meet in several tables
        found = materialize(nearest(found.groupBy("qid", "need", "pid").agg(F.min("dist").alias("dist")), k), "lsh-found")
        full = found.groupBy("qid").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
        short = rows.join(full.select("qid"), F.col(self.id_col).cast("long") == F.col("qid"), "left_anti")
        if short.isEmpty():
            return found
        rest = PivotTree(self.source, self.features, self.id_col).search(short, k, self.id_col, None, exclude_self)
        return found.join(full.select("qid"), "qid", "left_semi").select(*rest.columns).unionByName(rest)

    def _small(self, visits: DataFrame, points: DataFrame, large: DataFrame, exclude_self: bool) -> DataFrame:
        """Buckets of at most one block, many to a group."""
        k = self.k
        groups = max(1, -(-(visits.count() + points.count()) // GROUP))

        def dealt(df: DataFrame) -> DataFrame:
            return df.join(large.select("cell"), "cell", "left_anti").withColumn(
                "g", F.pmod(F.xxhash64("cell"), F.lit(groups)))

        def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            of = right.groupby("cell").indices
            out = [_top(left.iloc[at], right.iloc[of[cell]], k, exclude_self)
                   for cell, at in left.groupby("cell").indices.items() if cell in of]
            return pd.concat(out) if out else _top(left.iloc[:0], right.iloc[:0], k, exclude_self)

        return dealt(visits).groupBy("g").cogroup(dealt(points).groupBy("g")).applyInPandas(
            meet, "qid long, need long, pid long, dist double")


def lsh_knn(queries: DataFrame, points: DataFrame, features: Sequence[str], k: int, id_col: str = "id",
            exclude_self: bool = False, recall: float = 0.95, seed: int = 0) -> DataFrame:
    """Like :func:`neighbors.knn`, approximately: about ``recall`` of the neighbours are found,
    distances are exact, every query has ``k`` of them as long as there are ``k`` points."""
    return HashIndex(points, features, k, id_col, recall, seed).search(queries, exclude_self)


def recall_of(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: neighbours of ``exact(qid, pid)``, how many of them ``found`` has, and the share."""
    hits = exact.select("qid", "pid").join(found.select("qid", "pid", F.lit(1).alias("hit")), ["qid", "pid"], "left")
    return hits.agg(F.count(F.lit(1)).alias("neighbours"), F.count("hit").alias("hits")).withColumn(
        "recall", F.col("hits") / F.col("neighbours"))
