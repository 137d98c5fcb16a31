"""Connected components of an edge table, with partial aggregates and joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges(a, b)``; the label is the least node
    of its component.

    Alternates two star steps until the edges stop changing. Each node hands its
    neighbours to its least neighbour, first those above it, then those below,
    so paths halve in every round. Minima are partial aggregates; a hub with very
    many neighbours only meets a join, which adaptive execution can split.
    """
    now = materialize(_clean(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))),
                      "edges")
    seen = _mark(now)
    while seen[0]:
        now = materialize(_small_star(_large_star(now)), "edges")
        mark = _mark(now)
        if mark == seen:
            break
        seen = mark
    pairs = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return (pairs.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")))
            .groupBy("node").agg(F.min("label").alias("label")))


def _clean(edges: DataFrame) -> DataFrame:
    """Distinct edges, the larger node first."""
    return (edges.filter(F.col("a") != F.col("b"))
            .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                           F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return _clean(both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _clean(moved.unionByName(least.select("a", F.col("m").alias("b"))))
