"""Pivot tree and hash tables for neighbours, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import lsh, neighbors, resample


def _frame(spark, x, ids=None):
    names = [f"x{i}" for i in range(x.shape[1])]
    rows = [(int(i), *[None if np.isnan(v) else float(v) for v in p]) for i, p in zip(ids if ids is not None else range(len(x)), x)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} double" for n in names)).coalesce(2), names


def _brute(x, k):
    d = neighbors.distances(x, x)
    np.fill_diagonal(d, np.inf)
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :k]
    return order, np.take_along_axis(d, order, axis=1)


def _clusters(rng, n, dims, centres=12):
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] * 4 + rng.normal(size=(n, dims))


@pytest.fixture
def small_cells(monkeypatch):
    monkeypatch.setattr(neighbors, "POINTS_PER_PIVOT", 12)
    monkeypatch.setattr(neighbors, "MAX_PIVOTS", 4)
    monkeypatch.setattr(neighbors, "SPLIT", 2)
    monkeypatch.setattr(neighbors, "POINT_BLOCK", 40)
    monkeypatch.setattr(neighbors, "QUERY_BLOCK", 30)


def test_deep_trees_find_the_same(spark, small_cells):
    rng = np.random.default_rng(4)
    x = _clusters(rng, 220, 3)
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:30] = x[30]                       # copies that no pivots tell apart
    x[np.isnan(x).all(axis=1)] = 0.0
    df, names = _frame(spark, x)
    tree = neighbors.PivotTree(df, names)
    assert len(tree.levels) >= 2
    assert tree.leaves.agg(F.sum("n")).first()[0] == 220 == tree.points.count()
    order, dist = _brute(x, 4)
    got = {}
    for r in tree.search(df, 4, exclude_self=True).collect():
        got.setdefault(r.qid, {})[r.nn] = (r.pid, r.dist)
    for i in range(220):
        want = [(int(j), d) for j, d in zip(order[i], dist[i]) if np.isfinite(d)]
        have = [got[i][n] for n in sorted(got.get(i, {}))]
        assert np.allclose([d for _, d in have], [d for _, d in want], rtol=1e-12)
        assert all(abs(neighbors.distances(x[i:i + 1], x[j:j + 1])[0, 0] - d) < 1e-9 for j, d in have)


def test_pairs_grow_less_than_quadratically(spark, small_cells):
    rng = np.random.default_rng(5)
    pairs = []
    for n in (120, 480):
        df, names = _frame(spark, rng.uniform(size=(n, 2)))
        w = neighbors.PivotTree(df, names).work(df, 3, exclude_self=True).first()
        assert w.n_queries == w.n_points == n and w.n_leaves > n / 48
        pairs.append(w.pairs)
    assert pairs[1] < 8 * pairs[0]       # 16 times if all were compared


def test_collision_probability():
    rng = np.random.default_rng(6)
    for width, distance in ((1.0, 0.5), (2.0, 2.0), (1.0, 4.0)):
        shift = rng.uniform(size=200_000)
        moved = shift + rng.normal(size=200_000) * distance / width
        assert abs((np.floor(shift) == np.floor(moved)).mean() - lsh.collision(np.array([distance]), width)[0]) < 0.01


def test_hash_tables_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(lsh, "GROUP", 500)
    rng = np.random.default_rng(7)
    x = _clusters(rng, 900, 16, centres=30)
    df, names = _frame(spark, x, ids=range(5, 905))
    index = lsh.HashIndex(df, names, 5, recall=0.95)
    assert index.tables.expected_recall >= 0.95 and index.tables.expected_share < 1.0
    found = index.search(df, exclude_self=True).collect()
    order, dist = _brute(x, 5)
    have = {}
    for r in found:
        have.setdefault(r.qid - 5, []).append((r.nn, r.pid - 5, r.dist))
    hits = sum(len({p for _, p, _ in have[i]} & set(order[i].tolist())) for i in range(900))
    assert hits / 4500 >= 0.9
    for i in range(900):
        rows = sorted(have[i])
        assert [n for n, _, _ in rows] == [1, 2, 3, 4, 5] and len({p for _, p, _ in rows}) == 5
        assert all(abs(np.linalg.norm(x[i] - x[p]) - d) < 1e-9 and p != i for _, p, d in rows)
        assert all(d >= e - 1e-9 for (_, _, d), e in zip(rows, dist[i]))


def test_large_buckets_and_lonely_queries(spark, monkeypatch):
    monkeypatch.setattr(lsh, "POINT_BLOCK", 20)
    monkeypatch.setattr(neighbors, "POINT_BLOCK", 20)
    x = np.concatenate([np.zeros((90, 3)), np.array([[1e3, 0, 0], [0, -1e4, 0]])])  # a group of copies, two far away
    df, names = _frame(spark, x)
    found = lsh.lsh_knn(df, df, names, 3, exclude_self=True).collect()
    assert len(found) == 92 * 3
    far = {(r.qid, r.nn): (r.pid, r.dist) for r in found if r.qid >= 90}
    assert far[90, 1][1] == 1000.0 and far[91, 1][1] == 10000.0
    assert all(r.dist == 0 for r in found if r.qid < 90)


def test_few_points_and_missing_coordinates(spark):
    df, names = _frame(spark, np.array([[0.0, 1.0], [2.0, 1.0]]))
    assert [(r.qid, r.pid) for r in lsh.lsh_knn(df, df, names, 5, exclude_self=True).orderBy("qid").collect()] == [(0, 1), (1, 0)]
    empty = df.where("id < 0")
    assert lsh.lsh_knn(empty, empty, names, 5).count() == 0
    assert neighbors.knn(empty, empty, names, 5).count() == 0
    gap, names = _frame(spark, np.array([[0.0, np.nan], [2.0, 1.0]]))
    with pytest.raises(Exception, match="coordinate is missing"):
        lsh.lsh_knn(gap, gap, names, 1).collect()


def test_smote_with_hash_tables(spark):
    rng = np.random.default_rng(8)
    x = _clusters(rng, 260, 6)
    df, names = _frame(spark, x)
    df = df.withColumn("y", (F.col("id") < 60).cast("int"))
    made = resample.smote(df, "id", names, "y", ratio=0.5, k=5, neighbours="lsh").collect()
    assert len(made) == 40 and all(r.synthetic and r.id < 0 for r in made)
    exact, _ = _brute(x[:60], 5)
    on = 0
    for r in made:
        p = np.array([r[n] for n in names])
        ok = [any(abs(np.linalg.norm(x[i] - p) + np.linalg.norm(p - x[j]) - np.linalg.norm(x[i] - x[j])) < 1e-9
                  for j in js) for i, js in enumerate(exact)]
        on += any(ok)
    assert on >= 36                      # between a row and one of its true neighbours
    with pytest.raises(ValueError):
        resample.smote(df, "id", names, "y", neighbours="other")


def test_a_block_is_not_compared_with_all_of_another(monkeypatch):
    rng = np.random.default_rng(9)
    x = np.round(_clusters(rng, 6_000, 20), 2)
    x[:, 5:] *= 0.05
    x[40:60] = x[40]                     # copies: ties go to the smaller id
    q = x[:300].copy()
    q[::3, 2] = np.nan
    need = np.where(np.isnan(q[:, 2]), 2, -1)
    seen = []
    add = neighbors._Best.add
    monkeypatch.setattr(neighbors._Best, "add", lambda self, rows, d, ids: seen.append(d.size) or add(self, rows, d, ids))
    points = neighbors.pd.DataFrame({"pid": range(len(x)), "v": list(x)})
    queries = neighbors.pd.DataFrame({"qid": range(300), "need": need, "v": list(q)})
    got = neighbors._top(queries, points, 4, True)
    assert sum(seen) < 0.25 * len(q) * len(x)
    d = neighbors.distances(q, x)
    d[np.arange(300), np.arange(300)] = np.inf
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), d.shape), d), axis=1)[:, :4]
    assert (got["pid"].to_numpy().reshape(300, 4) == order).all()
    assert (got["dist"].to_numpy().reshape(300, 4) == np.take_along_axis(d, order, axis=1)).all()


def test_visits_leave_a_task_in_pieces(monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_CELLS", 600)
    rng = np.random.default_rng(10)
    low = rng.normal(size=(50, 4))
    part = neighbors.pd.DataFrame({"qid": range(40), "need": -1, "v": list(rng.normal(size=(40, 4))), "radius": np.inf})
    pieces = list(neighbors._picked(part, np.arange(50).astype(str).astype(object), low, low + 1, np.full(50, 9), 3, False))
    assert all(len(p) <= 150 for p in pieces) and sum(map(len, pieces)) == 40 * 50


def test_patterns_of_many_columns():
    there = np.random.default_rng(3).random((400, 130)) < 0.98
    there[200:] = there[:200]
    found = neighbors._patterns(there)
    assert sorted(r for _, rows in found for r in rows) == list(range(400))
    assert len(found) == len({r.tobytes() for r in there})
    assert all((there[rows] == p).all() for p, rows in found)
    assert neighbors._patterns(np.zeros((0, 3), bool)) == []
    (none, rows), = neighbors._patterns(np.zeros((4, 0), bool))
    assert len(none) == 0 and list(rows) == [0, 1, 2, 3]


def test_few_queries_of_one_cell_are_spread(spark, monkeypatch):
    """A class that fits one cell was searched by a task or two, however many cores there are."""
    monkeypatch.setattr(neighbors, "MIN_QUERY_BLOCK", 50)
    rows = spark.range(1200).select("id", *[F.rand(i).alias(f"x{i}") for i in range(3)]).collect()
    df = spark.createDataFrame(rows)
    tree = neighbors.PivotTree(df, ["x0", "x1", "x2"])
    block = tree._query_block(tree.queries(df, "id", None))
    assert 50 <= block <= 1200 // spark.sparkContext.defaultParallelism
    x = np.array([r[1:] for r in rows])
    ids = np.array([r[0] for r in rows])
    d = neighbors.distances(x, x)
    np.fill_diagonal(d, np.inf)
    want = {(int(i), int(ids[j])) for i, near in zip(ids, np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :3]) for j in near}
    assert {(r["qid"], r["pid"]) for r in tree.search(df, 3, exclude_self=True).collect()} == want


def test_few_pairs_are_compared_exactly(monkeypatch):
    """A matrix product rules the others out, also among far offsets, copies and several needs of a row."""
    rng = np.random.default_rng(11)
    x = _clusters(rng, 3_000, 20) + 1e6
    x[::7, 3] = np.nan
    x[100:140] = x[100]
    q = x[:400].copy()
    q[::2, 5] = np.nan
    q[::2, 6] = np.nan
    rows = [(i, n) for i in range(400) for n in ((5, 6) if i % 2 == 0 else (-1,))]
    seen = []
    add = neighbors._Best.add_pairs
    monkeypatch.setattr(neighbors._Best, "add_pairs", lambda self, r, d, *more: seen.append(len(d)) or add(self, r, d, *more))
    points = neighbors.pd.DataFrame({"pid": np.arange(3_000) * 3, "v": list(x)})
    queries = neighbors.pd.DataFrame({"qid": [3 * i for i, _ in rows], "need": [n for _, n in rows],
                                      "v": neighbors._bytes(q[[i for i, _ in rows]])})
    got = neighbors._top(queries, points, 4, True, values=True)
    assert sum(seen) < 0.05 * len(rows) * len(x)
    d = neighbors.distances(q, x)
    d[np.arange(400), np.arange(400)] = np.inf
    for (i, n), (_, of) in zip(rows, got.groupby(np.arange(len(got)) // 4)):
        order = np.lexsort((np.arange(3_000), d[i]))[:4]
        assert (of["pid"].to_numpy() == 3 * order).all() and (of["dist"].to_numpy() == d[i][order]).all()
        assert np.array_equal(of["value"].to_numpy(), x[order, n] if n >= 0 else np.full(4, np.nan), equal_nan=True)


def test_a_query_goes_to_its_first_leaf_once(spark, small_cells, monkeypatch):
    monkeypatch.setattr(neighbors, "POINT_BLOCK", 400)      # a leaf is one block
    monkeypatch.setattr(neighbors, "COUNTED_FROM", 1)
    rng = np.random.default_rng(12)
    x = _clusters(rng, 200, 3)
    df, names = _frame(spark, x)
    asking = df.withColumn("need", F.lit(1)).withColumn("x1", F.when(F.col("id") % 2 == 0, F.col("x1")))
    tree = neighbors.PivotTree(df, names)
    near = tree._bounded(tree.queries(asking, "id", "need"), 3, True, 30, 200).cache()
    assert near.count() == 200 and near.where("home = ''").count() == 0
    visits = tree.visits(near.select("qid", "need", "v", "radius", "home"), 3, False)
    assert visits.count() > 0 and visits.where("cell = home").count() == 0
    q = x.copy()
    q[1::2, 1] = np.nan
    d = neighbors.distances(q, x)
    np.fill_diagonal(d, np.inf)
    rows = tree.found(asking, 3, "id", "need", True).collect()
    assert len(rows) == 600
    for r in rows:
        assert r.pid == np.lexsort((np.arange(200), d[r.qid]))[r.nn - 1] and r.value == x[r.pid, 1]
