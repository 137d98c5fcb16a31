"""Resampling of the training set: random under-sampling (RS2) and SMOTE (RS1).

Both are exact in their counts and deterministic for a seed: choices come from
seeded hashes of row keys, never from driver-side random draws over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lsh import lsh_knn
from .neighbors import knn
from .prep import class_counts, hash_order, ranks_within


def undersample(df: DataFrame, key: Sequence[str], label: str, ratio: float = 0.5,
                minority=1, seed: int = 42) -> DataFrame:
    """Keep every minority row and the first ``int(n_min / ratio)`` majority rows in
    seeded hash order (RS2), so minority:majority = ``ratio`` (no replacement)."""
    counts = class_counts(df, label)
    n_min = counts.get(minority, 0)
    keep = int(n_min / ratio)
    maj = df.where(F.col(label) != F.lit(minority))
    ranked = ranks_within(maj.withColumn("_h", hash_order(key, seed)), [label], ["_h", *key], "_r")
    kept = ranked.where(F.col("_r") < keep).drop("_h", "_r")
    return df.where(F.col(label) == F.lit(minority)).unionByName(kept)


def smote_count(n_min: int, n_maj: int, ratio: float) -> int:
    """Synthetic rows needed to reach minority = ratio x majority; error if already above."""
    target = int(ratio * n_maj)
    if target < n_min:
        raise ValueError(f"minority already above the target ratio ({n_min} > {target})")
    return target - n_min


def smote(df: DataFrame, key: str, features: Sequence[str], label: str, ratio: float = 0.1,
          k: int = 5, minority=1, seed: int = 0, neighbours: str = "exact") -> DataFrame:
    """Synthetic minority rows ``x + u (nb - x)`` between a minority row and one of
    its ``k`` nearest minority neighbours (RS1).

    The number of new rows is exact; the j-th new row takes seed row
    ``h1(j) mod n_min`` (by minority rank), neighbour ``h2(j) mod k`` and
    ``u = h3(j)`` in [0, 1), all seeded md5 hashes, as SQL engines have them too. Returns the new rows only, with
    ``key`` = -(j + 1) and ``synthetic = true``; union them with the input to train.

    ``neighbours="lsh"`` looks for neighbours in hash tables (:mod:`lsh`): in many
    dimensions, where no cell can be ruled out, a large minority cannot afford to be
    compared with all of itself.
    """
    if neighbours not in ("exact", "lsh"):
        raise ValueError(f"neighbours is 'exact' or 'lsh', not {neighbours!r}")
    feats = list(features)
    spark = df.sparkSession
    counts = class_counts(df, label)
    n_min = counts.get(minority, 0)
    n_maj = sum(v for c, v in counts.items() if c != minority)
    n_new = smote_count(n_min, n_maj, ratio)
    mino = df.where(F.col(label) == F.lit(minority)).select(F.col(key).cast("long").alias("id"), *feats)
    k_eff = min(k, max(n_min - 1, 0))
    if n_new == 0 or k_eff == 0:
        return (mino.limit(0).withColumnRenamed("id", key)
                .withColumns({label: F.lit(minority), "synthetic": F.lit(True)}))
    find = knn if neighbours == "exact" else lsh_knn
    nn = find(mino, mino, feats, k_eff, id_col="id", exclude_self=True)
    ranked = ranks_within(mino.withColumn("_h", hash_order(["id"], seed)), [], ["_h", "id"], "_r")
    j = spark.range(n_new).withColumnRenamed("id", "j")

    def draw(tag: str):
        return hash_order(["j"], f"{seed}:{tag}")  # 52 bits

    draws = j.select("j", (draw("row") % n_min).alias("_r"), ((draw("nb") % k_eff) + 1).cast("int").alias("nn"),
                     (draw("u").cast("double") / float(1 << 52)).alias("u"))
    seeds = ranked.select("_r", F.col("id").alias("qid"), *[F.col(c).alias(f"_x_{c}") for c in feats])
    nbv = mino.select(F.col("id").alias("pid"), *[F.col(c).alias(f"_n_{c}") for c in feats])
    out = (draws.join(seeds, "_r").join(nn.select("qid", "pid", "nn"), ["qid", "nn"])
           .join(nbv, "pid"))
    return out.select((-(F.col("j") + 1)).alias(key),
                      *[(F.col(f"_x_{c}") + F.col("u") * (F.col(f"_n_{c}") - F.col(f"_x_{c}"))).alias(c)
                        for c in feats],
                      F.lit(minority).alias(label), F.lit(True).alias("synthetic"))
