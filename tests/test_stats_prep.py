import math
import random

import numpy as np
from pyspark.sql import functions as F

from riskloom.operators import neighbors, prep, resample, stats
from riskloom.operators.neighbors import knn

INF = float("inf")


def _rank_winsor(vals, lim=0.05):
    present = sorted(v for v in vals if v is not None)
    n = len(present)
    k = int(lim * n)
    lo, hi = present[k], present[n - 1 - k]
    return [None if v is None else min(max(v, lo), hi) for v in vals]


def test_winsorize_matches_rank_rule(spark):
    rng = random.Random(7)
    for n in (19, 20, 100, 101):
        vals = [float(rng.randint(0, 15)) for _ in range(n)] + [None, INF, -INF]
        df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, x double")
        got = [r.x for r in stats.winsorize(df, ["x"]).orderBy("i").collect()]
        assert got == _rank_winsor(vals)
        again = stats.winsorize(stats.winsorize(df, ["x"]), ["x"]).count()
        assert again == len(vals)


def test_order_statistics_exact_with_small_sketch(spark):
    rng = random.Random(3)
    vals = [rng.gauss(0, 1) for _ in range(3000)] + [0.5] * 1000   # a hot value
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    ranks = [0, 17, 999, 1500, 2500, 3999]
    got = stats.order_statistics(df, {"x": ranks}, accuracy=50)
    assert [got[("x", r)] for r in ranks] == [s[r] for r in ranks]


def test_order_statistics_narrow_their_brackets(spark, monkeypatch):
    monkeypatch.setattr(stats, "BRACKET_ROWS", 5)
    rng = random.Random(4)
    vals = [rng.choice([-INF, 0.0, 1.0, INF]) if rng.random() < 0.3 else rng.gauss(0, 1) for _ in range(4000)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    s = sorted(vals)
    ranks = [0, 1, 40, 1999, 2000, 3700, 3999]
    got = stats.order_statistics(df, {"x": ranks}, accuracy=20)
    assert [got[("x", r)] for r in ranks] == [s[r] for r in ranks]


def test_describe_quartiles_linear(spark):
    vals = [1.0, 2.0, 4.0, 8.0, None]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    r = stats.describe(df, ["x"]).first()
    assert (r["count"], r.min, r.q25, r.q50, r.q75, r.max) == (4, 1.0, 1.75, 3.0, 5.0, 8.0)


def test_corr_pairwise_and_constant(spark):
    df = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.0, 5.0), (3.0, None, 5.0), (4.0, 8.0, 5.0)],
                               "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.r for r in stats.corr_pairs(df, ["a", "b", "c"]).collect()}
    assert abs(got[("a", "b")] - 1.0) < 1e-12 and got[("a", "c")] is None


def test_ranks_split_folds_exact(spark):
    df = spark.createDataFrame([(i, 1 if i % 7 == 0 else 0) for i in range(1, 702)], "k long, y int")
    r = prep.ranks_within(df.withColumn("h", prep.hash_order(["k"], 5)), ["y"], ["h", "k"], "r", buckets=16)
    for y, rs in r.groupBy("y").agg(F.collect_list("r").alias("rs")).collect():
        assert sorted(rs) == list(range(len(rs)))
    s = prep.stratified_split(df, ["k"], "y", 0.2, seed=1)
    counts = {(row.y, row.split): row["count"] for row in s.groupBy("y", "split").count().collect()}
    assert counts[(1, "test")] == math.floor(0.2 * 101 + 0.5) and counts[(0, "test")] == 120
    f = prep.stratified_folds(df, ["k"], "y", 5, seed=1).groupBy("y", "fold").count().collect()
    by_class = {}
    for row in f:
        by_class.setdefault(row.y, []).append(row["count"])
    assert all(max(v) - min(v) <= 1 for v in by_class.values())


def test_undersample_exact(spark):
    df = spark.createDataFrame([(i, 1 if i % 10 == 0 else 0) for i in range(1000)], "k long, y int")
    u = resample.undersample(df, ["k"], "y", 0.5, minority=1, seed=3)
    c = {r.y: r["count"] for r in u.groupBy("y").count().collect()}
    assert c == {1: 100, 0: 200}


def test_knn_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    pts = rng.normal(size=(300, 3))
    pts[rng.random(pts.shape) < 0.1] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    q = df.where("id < 20")
    got = {(r.qid, r.nn): r.pid for r in knn(q, df, ["a", "b", "c"], 4, exclude_self=True).collect()}
    for i in range(20):
        d = []
        for j in range(300):
            if j == i:
                continue
            m = ~np.isnan(pts[i]) & ~np.isnan(pts[j])
            if m.sum() == 0:
                continue
            d.append((math.sqrt(((pts[i][m] - pts[j][m]) ** 2).sum() * 3 / m.sum()), j))
        expect = [j for _, j in sorted(d)[:4]]
        assert [got[(i, k)] for k in range(1, 5)] == expect


def test_knn_blocks_and_cells_find_the_same(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "POINTS_PER_PIVOT", 20)
    monkeypatch.setattr(neighbors, "POINT_BLOCK", 7)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 5)
    rng = np.random.default_rng(1)
    pts = rng.normal(size=(200, 3)).round(1)  # many ties
    pts[rng.random(pts.shape) < 0.2] = np.nan
    rows = [(i, *[None if np.isnan(v) else float(v) for v in p]) for i, p in enumerate(pts)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    got = {}
    for r in knn(df, df, ["a", "b", "c"], 3, exclude_self=True).collect():
        got.setdefault(r.qid, []).append((r.nn, r.pid))
    for i in range(200):
        d = []
        for j in range(200):
            m = ~np.isnan(pts[i]) & ~np.isnan(pts[j])
            if j != i and m.any():
                d.append((math.sqrt(((pts[i][m] - pts[j][m]) ** 2).sum() * 3 / m.sum()), j))
        want = [j for _, j in sorted(d, key=lambda x: (round(x[0], 12), x[1]))[:3]]
        dist = dict((j, x) for x, j in d)
        have = [p for _, p in sorted(got.get(i, []))]
        assert [round(dist[p], 9) for p in have] == [round(dist[p], 9) for p in want]


def test_imputation_on_several_missing_patterns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 4))
    x[rng.random(x.shape) < 0.25] = np.nan
    x[0] = np.nan  # no common coordinate with anyone: column means
    rows = [(i, *[None if np.isnan(v) else float(v) for v in p]) for i, p in enumerate(x)]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double")
    got = {r.id: [r.a, r.b, r.c, r.d] for r in prep.knn_impute(df, "id", names, k=5).collect()}
    mean = np.nanmean(x, axis=0)
    for i in range(150):
        for c in range(4):
            if not np.isnan(x[i, c]):
                assert got[i][c] == x[i, c]
                continue
            d = []
            for j in range(150):
                m = ~np.isnan(x[i]) & ~np.isnan(x[j])
                if not np.isnan(x[j, c]) and m.any():
                    d.append((math.sqrt(((x[i][m] - x[j][m]) ** 2).sum() * 4 / m.sum()), j))
            want = np.mean([x[j, c] for _, j in sorted(d)[:5]]) if d else mean[c]
            assert abs(got[i][c] - want) < 1e-9


def test_smote_points_on_segments(spark):
    rng = random.Random(1)
    rows = [(i, rng.random(), rng.random(), 1 if i < 12 else 0) for i in range(400)]
    df = spark.createDataFrame(rows, "k long, a double, b double, y int")
    syn = resample.smote(df, "k", ["a", "b"], "y", ratio=0.1, k=5, minority=1, seed=0)
    new = syn.collect()
    assert len(new) == int(0.1 * 388) - 12
    mino = [(r[1], r[2]) for r in rows if r[3] == 1]
    for r in new:
        # a synthetic point lies on a segment between two minority points
        ok = False
        for x in mino:
            for y in mino:
                if x == y:
                    continue
                ux, uy = y[0] - x[0], y[1] - x[1]
                t = ((r.a - x[0]) * ux + (r.b - x[1]) * uy) / (ux * ux + uy * uy)
                if -1e-9 <= t <= 1 + 1e-9 and abs(x[0] + t * ux - r.a) < 1e-9 and abs(x[1] + t * uy - r.b) < 1e-9:
                    ok = True
        assert ok


def test_threshold_split_needs_no_shuffle(spark):
    df = spark.range(20_000).withColumn("part", F.col("id") % 4)
    out = prep.threshold_split(df, ["id", "part"], 0.2, seed=5)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    shares = {r.part: r.s for r in out.groupBy("part").agg(F.avg((F.col("split") == "test").cast("double")).alias("s")).collect()}
    assert len(shares) == 4 and all(abs(s - 0.2) < 0.03 for s in shares.values())
    less = prep.threshold_split(df.where("id % 3 = 0"), ["id", "part"], 0.2, seed=5)
    assert less.join(out, ["id", "part", "split"], "left_anti").count() == 0     # a row keeps its side
    assert prep.threshold_split(df, ["id"], 0.0).where("split = 'test'").count() == 0


def test_rows_of_a_repeated_key_all_count(spark):
    rows = [(1, 0.0, None), (2, 1.0, 10.0), (2, 1.0, 10.0), (3, 2.0, 20.0), (4, 3.0, 30.0)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    # the nearest three are 2, 2 and 3; both rows of 2 count each time
    assert prep.knn_impute(df, "k", ["a", "b"], k=3).where("k = 1").first().b == (4 * 10 + 20) / 5
