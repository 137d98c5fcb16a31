"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by (source, exact length in words). A source's target is
met by taking every document the whole number of times that fits, and then a
subset for the rest of the budget: lengths in proportion first, so the subset
looks like its source, and what is left by a bounded-knapsack dynamic program that
comes as near to it as the lengths allow. At least ``COVER - 1`` times the longest
length is left to the program, so texts of any length take part in it, and a
budget below ``COVER`` times the longest length is its own alone. Which documents of
a length are taken is decided by a seeded hash.

Only counts by length meet in one place, one source at a time. Documents are
ranked inside hash buckets of their (source, length), so a length that a third
of all rows share is ranked by many tasks.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import body, materialize, word_count

WEIGHTS = (5, 2, 1)
REPEATS = 3
DP_WORDS = 20_000        # the dynamic program has at least so many words to fit
COVER = 4                # and so many times the longest length
BUCKET_BITS = 12
SEED = 7


def knapsack(sizes: list[int], counts: list[int], budget: int) -> dict[int, int]:
    """Counts per size with the greatest sum that does not exceed ``budget``.

    Bounded subset-sum: a count is split into powers of two, each a step that adds
    sums to those reached so far. The step that first reached a sum is kept, and
    the choices are traced back from the greatest; the steps on the way back only
    get earlier, so none is used twice. Memory is a few bytes a unit of the budget.
    """
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    first = np.zeros(budget + 1, np.int32)
    steps: list[tuple[int, int]] = []
    for size, count in zip(sizes, counts):
        if size <= 0 or size > budget:
            continue
        count, chunk = min(count, budget // size), 1
        while count > 0 and not reached[budget]:
            take = min(chunk, count)
            jump = size * take
            new = reached[:-jump] & ~reached[jump:]
            first[jump:][new] = len(steps)
            reached[jump:] |= new
            steps.append((size, take))
            count -= take
            chunk *= 2
        if reached[budget]:
            break
    at, chosen = int(np.flatnonzero(reached)[-1]), {}
    while at:
        size, take = steps[first[at]]
        chosen[size] = chosen.get(size, 0) + take
        at -= size * take
    return chosen


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, dp_words: int = DP_WORDS,
               copies: int = 1) -> np.ndarray:
    """How many documents of each size to take so that their words come near ``budget``.

    Every document is offered once; the dynamic program turns to further copies,
    up to ``copies`` of each, only if single ones cannot reach the budget. Its part
    of the budget grows with the longest length on offer.
    """
    total = int((sizes * counts).sum())
    if budget <= 0 or total == 0:
        return np.zeros(len(sizes), np.int64)
    if budget >= total:
        return counts.astype(np.int64)
    dp_words = max(dp_words, COVER * int(sizes.max()))
    share = counts * (max(0, budget - dp_words) / total)
    taken = np.minimum(np.floor(share).astype(np.int64), counts)
    rest = budget - int((sizes * taken).sum())
    for i in np.lexsort((sizes, -(share - taken))):  # largest remainders first
        if rest <= dp_words:
            break
        if 0 < sizes[i] <= rest and taken[i] < counts[i]:
            taken[i] += 1
            rest -= int(sizes[i])
    for i in np.argsort(-sizes, kind="stable"):
        if rest <= dp_words:
            break
        if sizes[i] > 0:
            more = min(int(counts[i] - taken[i]), max(0, rest - dp_words) // int(sizes[i]))
            taken[i] += more
            rest -= more * int(sizes[i])
    if rest > 0:
        order = np.argsort(-sizes, kind="stable")
        offer = [(int(sizes[i]), int(counts[i] - taken[i])) for i in order]
        offer += [(int(sizes[i]), int(counts[i]) * (copies - 1)) for i in order]
        chosen = knapsack([o[0] for o in offer], [o[1] for o in offer], rest)
        at = {int(s): i for i, s in enumerate(sizes)}
        for size, n in chosen.items():
            taken[at[size]] += n
    return taken


def targets(sources: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """Adds ``target`` to ``sources(src, source, source_size)``, one row per source.

    The weights repeat over the sources by code point, null last. What a source
    cannot take beyond ``repeats`` times its size is shared among the others by
    weight; that ends at one level: every target is the weight times the level,
    or the cap. Sources are met in the order in which they reach their caps.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumn("w", weight).withColumn("cap", F.col("source_size").cast("double") * repeats)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), "src")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (rows.withColumn("place", F.row_number().over(by_cap))
            .withColumn("level", (F.sum(F.col("source_size").cast("double")).over(everything)
                                  - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                        / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))))
    level = F.min(F.when(F.col("cap") > F.col("w") * F.col("level"), F.struct("place", "level"))).over(everything)
    rows = rows.withColumn("final", level["level"])
    return rows.select("src", "source", "source_size",
                       F.when(F.col("final").isNull(), F.col("cap"))
                       .otherwise(F.least("cap", F.col("w") * F.col("final"))).alias("target"))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, repeats: int = REPEATS, seed: int = SEED,
        size: Column | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for every row of ``docs(doc_id, text, source)``.

    ``taken`` is the number of words the mix takes of the row, a whole multiple
    of its size, at most ``repeats`` times. A null or empty text has size 0 and
    nothing taken. A null source is a source of its own, the last. Repeated rows
    are documents of their own; equal rows may differ in ``taken``. An empty
    table gives no rows. Reruns give the same table.
    """
    size = word_count(body()) if size is None else size
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       size.cast("long").alias("size"))
    h = F.xxhash64("doc_id", F.lit(seed))
    slim = slim.withColumn("src", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    slim = materialize(slim.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS)), "sizes")

    per_bucket = materialize(slim.groupBy("src", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("n")),
                             "buckets")
    strata = per_bucket.groupBy("src", "source", "size").agg(F.sum("n").alias("n"))
    per_source = strata.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    goal = materialize(targets(per_source, weights, repeats), "targets")

    def choose(rows):
        budget = float(rows["target"].iloc[0])
        total = int(rows["source_size"].iloc[0])
        whole = min(int(budget // total), repeats) if total else 0
        rest = round(budget - whole * total) if whole < repeats else 0
        n = rows["n"].to_numpy(np.int64)
        taken = fit_budget(rows["size"].to_numpy(np.int64), n, rest, copies=repeats - whole)
        rows["whole"], rows["extra"] = whole + taken // n, taken % n
        return rows[["src", "size", "whole", "extra"]]

    plan = (strata.join(goal.select("src", "source_size", "target"), "src")
            .groupBy("src").applyInPandas(choose, "src string, size long, whole long, extra long"))
    before = Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = (per_bucket.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
              .join(plan, ["src", "size"]).join(goal.drop("source"), "src")
              .drop("source", "n"))
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h", "doc_id")) + F.col("before")
    picked = F.when(rank <= F.col("extra"), F.lit(1)).otherwise(F.lit(0))
    return (slim.join(placed, ["src", "size", "bucket"])
            .withColumn("taken", (F.col("whole") + picked) * F.col("size"))
            .select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                    F.col("taken").cast("long").alias("taken")))
