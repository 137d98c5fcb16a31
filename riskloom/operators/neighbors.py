"""Exact k-nearest-neighbour search for KNN imputation (IM1) and SMOTE (RS1).

Points are dealt to a tree of cells. A cell of the first level is a part of those
points that have the same coordinates, cut at medians of a bounded sample of them; a
cell that holds too many points is dealt to pivots of its own, and so on, so cells stay
near ``POINTS_PER_PIVOT`` points however many there are. Each cell has a bounding box,
from which a lower bound of the distance of any query to the cell follows, in
whatever coordinates the two have in common. A query first goes down to the leaf
that looks nearest, which gives an upper bound of its k-th distance; it then goes
only to the cells whose lower bound does not exceed that, and the best of all
leaves are merged.

Queries and points meet by cell in Spark, neither side passes through the
driver. Large leaves are cut into blocks of points and of queries, so a task
never holds more than one block of each. Inside a task the points of a block are cut
at medians again, down to ``LEAF`` points, and a query is compared only with the boxes
within its radius: by a matrix product first, whose rounding is allowed for, and
exactly with the points that it cannot rule out. What a query finds in its first leaf
is kept, so it does not go there again. The cuts of the first level and its boxes (at most ``MAX_PIVOTS``
and as many again for rare patterns of missing coordinates) go to every task; the
pivots and boxes of deeper levels are tables that points and queries meet by their cell.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize, release_shuffles

MAX_PIVOTS = 512          # of one cell
POINTS_PER_PIVOT = 40_000
SPLIT = 2                 # a cell of more than so many times POINTS_PER_PIVOT is dealt again
MAX_LEVELS = 8            # points that no pivots tell apart stay in one leaf, which is cut into blocks
POINT_BLOCK = 80_000
QUERY_BLOCK = 200_000
COUNTED = 16              # one query of so many tells how many blocks the visits of a cell fill,
COUNTED_FROM = 500_000    # of so many queries
MIN_QUERY_BLOCK = 4_000   # of few queries, so that all cores take part
SAMPLED = 64              # points of the sample per cell of the first level
LEAF = 128                # points compared at once inside a task
HOME = 512                # points near a query that bound its k-th distance before others are compared
DOWN_BLOCK = 2_000        # queries that meet up to MAX_PIVOTS children
MAX_BOXES = 100_000
# query x point x coordinate cells held at once inside a task
BLOCK_CELLS = 4_000_000
SLACK = 1 + 1e-9          # rounding never excludes a cell that holds an equal distance


def vector(features: Sequence[str]) -> Column:
    """The coordinates as one array, missing as NaN."""
    return F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in features])


def _stacked(v: pd.Series) -> np.ndarray:
    """Vectors of a column, as arrays or as the bytes of their doubles, in one matrix."""
    if len(v) and isinstance(v.iloc[0], (bytes, bytearray)):
        return np.frombuffer(b"".join(v), float).reshape(len(v), -1)
    return np.stack(v.to_numpy())


def _bytes(x: np.ndarray) -> list[bytes]:
    """The doubles of each row as bytes: they pass between tables far cheaper than arrays."""
    flat, width = np.ascontiguousarray(x, float).tobytes(), 8 * x.shape[1]
    return [flat[at:at + width] for at in range(0, width * len(x), width)] if width else [b""] * len(x)


def distances(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Euclidean distance over the common coordinates, scaled to all of them:
    ``sqrt(n / n_common * sum)``; no common coordinate -> inf (never chosen)."""
    diff = q[:, None, :] - p[None, :, :]
    present = ~np.isnan(diff)
    n_common = present.sum(axis=2)
    total = (np.where(present, diff, 0.0) ** 2).sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.sqrt(total * q.shape[1] / n_common)
    d[n_common == 0] = np.inf
    return d


class _Cuts:
    """Points ``x`` without missing coordinates, cut at medians down to ``leaf`` of them.

    ``axis`` is -1 in a leaf; ``first`` to ``last`` are a node's points in ``order``."""

    def __init__(self, x: np.ndarray, leaf: float) -> None:
        self.order = np.arange(len(x))
        self.axis, self.cut, self.left, self.right, self.first, self.last = [], [], [], [], [], []
        todo = [(0, len(x), -1, 0)]
        while todo:
            lo, hi, parent, side = todo.pop()
            node = len(self.axis)
            if parent >= 0:
                (self.right if side else self.left)[parent] = node
            for field, value in zip((self.axis, self.cut, self.left, self.right, self.first, self.last),
                                    (-1, 0.0, -1, -1, lo, hi)):
                field.append(value)
            inside = self.order[lo:hi]
            if hi - lo <= leaf:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                spread = x[inside].var(axis=0)
            axis = int(spread.argmax()) if len(spread) else -1
            if axis < 0 or not spread[axis] > 0:
                continue
            v = x[inside, axis]
            cut = np.sort(v)[(len(v) - 1) // 2]
            if (v <= cut).all():
                cut = np.nextafter(cut, -np.inf)
            near = v <= cut
            n = int(near.sum())
            if n in (0, len(v)):
                continue
            self.order[lo:hi] = np.concatenate([inside[near], inside[~near]])
            self.axis[node], self.cut[node] = axis, cut
            todo += [(lo, lo + n, node, 0), (lo + n, hi, node, 1)]

    def leaf_of(self, x: np.ndarray, most: int = 0) -> np.ndarray:
        """The leaf on whose side of all cuts each row lies, or the first node of at most ``most`` points."""
        axis, cut = np.array(self.axis), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        ends = (axis < 0) | (np.array(self.last) - np.array(self.first) <= most)
        at = np.zeros(len(x), np.int64)
        while (going := np.flatnonzero(~ends[at])).size:
            n = at[going]
            at[going] = np.where(x[going, axis[n]] <= cut[n], left[n], right[n])
        return at


class _Best:
    """The k nearest points so far of each query, ties by point id, and how far others may lie."""

    def __init__(self, ids: np.ndarray, k: int, limit: np.ndarray, exclude_self: bool) -> None:
        self.ids, self.k, self.limit, self.exclude_self = ids, k, limit.copy(), exclude_self
        self.d = np.full((len(ids), k), np.inf)
        self.i = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.at = np.full((len(ids), k), -1)        # the place of the point in its block

    def add(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        r, c = np.nonzero(np.isfinite(d) & (d <= self.limit[rows][:, None]))
        self.add_pairs(rows[r], d[r, c], ids[c], at[c])

    def add_pairs(self, rows: np.ndarray, d: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        """Pairs of a query and a point, all of one query in a row."""
        keep = d <= self.limit[rows]
        if self.exclude_self:
            keep &= self.ids[rows] != ids
        rows, d, ids, at = rows[keep], d[keep], ids[keep], at[keep]
        if not len(rows):
            return
        new = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        of = rows[new]
        sizes = np.diff(np.r_[new, len(rows)]) + self.k
        group = np.arange(len(of))
        every = np.concatenate([np.repeat(group, self.k), np.repeat(group, sizes - self.k)])
        d = np.concatenate([self.d[of].ravel(), d])
        ids = np.concatenate([self.i[of].ravel(), ids])
        at = np.concatenate([self.at[of].ravel(), at])
        order = np.lexsort((ids, d, every))
        first = order[(np.cumsum(sizes) - sizes)[:, None] + np.arange(self.k)]
        self.d[of], self.i[of], self.at[of] = d[first], ids[first], at[first]
        self.limit[of] = np.minimum(self.limit[of], self.d[of, -1])


def _walk(tree: _Cuts, x: np.ndarray, px: np.ndarray, ids: np.ndarray, at: np.ndarray, rows: np.ndarray, common: int,
          best: _Best) -> None:
    """Compare queries ``x[rows]`` with the points within their limits. All coordinates count;
    those that the two sides do not share are 0 on both, ``common`` are shared.

    Squared distances from a matrix product, off by no more than ``err`` times the squares
    of both sides, rule out most points; the others are compared coordinate by coordinate.
    Queries of one row, for each coordinate it needs, are compared once, as one ``place``."""
    dims = x.shape[1]
    rows = rows[np.argsort(best.ids[rows], kind="stable")]
    x, px, ids, at = x[rows], px[tree.order], ids[tree.order], at[tree.order]
    new = np.flatnonzero(np.r_[True, (np.diff(best.ids[rows]) != 0) | (x[1:] != x[:-1]).any(axis=1)])
    many = np.diff(np.r_[new, len(rows)])
    # the queries of each place, the first again where there are fewer than the most
    own = rows[new[:, None] + np.where(np.arange(many.max()) < many[:, None], np.arange(many.max()), 0)]
    x = x[new]
    step = max(1, BLOCK_CELLS // max(1, LEAF * dims))
    with np.errstate(over="ignore", invalid="ignore"):
        centre = px.mean(axis=0)
        qc, pc = x - centre, px - centre
        q2, p2 = np.einsum("ij,ij->i", qc, qc), np.einsum("ij,ij->i", pc, pc)
        pc = np.ascontiguousarray(-2.0 * pc.T)
    err = 16 * (dims + 8) * np.finfo(float).eps

    def limit(some: np.ndarray) -> np.ndarray:
        return best.limit[own[some]].max(axis=1)

    def squares(some: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """About the squared distances less the squares of the queries."""
        out = qc[some] @ pc[:, lo:hi]
        out += p2[lo:hi]
        return out

    with np.errstate(over="ignore", invalid="ignore"):
        # a query's own side of all cuts bounds its k-th distance before any box is left out
        home, need = tree.leaf_of(x, HOME), best.k + best.exclude_self
        by = np.argsort(home, kind="stable")
        for some in np.split(by, np.flatnonzero(np.diff(home[by])) + 1):
            leaf = home[some[0]]
            lo, hi = tree.first[leaf], min(tree.last[leaf], tree.first[leaf] + HOME)
            if hi - lo < need:
                continue
            for a in range(0, len(some), step):
                q = some[a:a + step]
                far = np.partition(squares(q, lo, hi), need - 1, axis=1)[:, need - 1]
                far = np.maximum(far + q2[q], 0.0) + err * (q2[q] + p2[lo:hi].max())
                far = np.sqrt(far * dims / common) * SLACK
                best.limit[own[q]] = np.fmin(best.limit[own[q]], far[:, None])
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, some = todo.pop()
            lo, hi = tree.first[node], tree.last[node]
            here = x[some]
            gap = np.clip(here, tree.low[node], tree.high[node])
            gap -= here
            some = some[np.sqrt(np.einsum("ij,ij->i", gap, gap) * dims / common) <= limit(some) * SLACK]
            if not len(some):
                continue
            if tree.axis[node] >= 0:
                todo += [(tree.right[node], some), (tree.left[node], some)]
                continue
            for p in range(lo, hi, LEAF):
                end = min(hi, p + LEAF)
                for a in range(0, len(some), step):
                    q = some[a:a + step]
                    reach = np.square(limit(q)) * (common / dims * SLACK) + err * (q2[q] + p2[p:end].max()) - q2[q]
                    r, c = np.nonzero(~(squares(q, p, end) > reach[:, None]))    # what is no number is compared
                    if not len(r):
                        continue
                    q, c = q[r], p + c
                    diff = x[q] - px[c]
                    d = np.sqrt(np.square(diff, out=diff).sum(axis=1) * dims / common)
                    best.add_pairs(own[q, 0], d, ids[c], at[c])
                    for n in range(1, own.shape[1]):
                        more = many[q] > n
                        best.add_pairs(own[q[more], n], d[more], ids[c[more]], at[c[more]])


def _patterns(there: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(present coordinates, rows) of each pattern of them."""
    of = np.zeros(len(there), np.int64)
    for column in there.T:      # sorting numbers is far cheaper than sorting rows
        of = 2 * of + column
        if len(of) and of.max() > 1 << 40:
            of = np.unique(of, return_inverse=True)[1]
    _, first, of = np.unique(of, return_index=True, return_inverse=True)
    by = np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of, minlength=len(first)))[:-1])
    return [(there[at], rows) for at, rows in zip(first, by)]


def _found(q: pd.DataFrame, p: pd.DataFrame, k: int, exclude_self: bool) -> _Best:
    """The k nearest points of each query among ``p``, ties by point id, as far as they lie
    within the query's ``radius`` if it has one."""
    limit = q["radius"].to_numpy(float) if "radius" in q else np.full(len(q), np.inf)
    best = _Best(q["qid"].to_numpy(np.int64), k, limit, exclude_self)
    if len(q) and len(p):
        qx, px = _stacked(q["v"]), _stacked(p["v"])
        need, ids, dims = q["need"].to_numpy(np.int64), p["pid"].to_numpy(np.int64), qx.shape[1]
        endless = np.isinf(qx).any() or np.isinf(px).any()
        asking = _patterns(~np.isnan(qx))
        for has, points in _patterns(~np.isnan(px)):
            x = np.where(has, px[points], 0.0)
            tree = _Cuts(x, len(x) if endless else LEAF)
            if not endless:
                order = x[tree.order]
                low = np.array([order[a:b].min(axis=0) for a, b in zip(tree.first, tree.last)])
                high = np.array([order[a:b].max(axis=0) for a, b in zip(tree.first, tree.last)])
            for knows, rows in asking:
                both = has & knows
                rows = rows[(need[rows] < 0) | has[np.maximum(need[rows], 0)]]
                if not both.any() or not len(rows):
                    continue
                if endless:
                    step = max(1, BLOCK_CELLS // max(1, LEAF * dims))
                    for at in range(0, len(points), LEAF):
                        some = points[at:at + LEAF]
                        for a in range(0, len(rows), step):
                            best.add(rows[a:a + step], distances(qx[rows[a:a + step]], px[some]), ids[some], some)
                    continue
                tree.low, tree.high = np.where(both, low, 0.0), np.where(both, high, 0.0)
                _walk(tree, np.where(both, qx, 0.0), np.where(both, x, 0.0), ids[points], points, rows, int(both.sum()), best)
    return best


_PAIRS = "qid long, need long, pid long, dist double"


def _top(q: pd.DataFrame, p: pd.DataFrame, k: int, exclude_self: bool, values: bool = False) -> pd.DataFrame:
    """(qid, need, pid, dist) of :func:`_found`, with ``values`` also what the point has at ``need``."""
    best = _found(q, p, k, exclude_self)
    limit = q["radius"].to_numpy(float) if "radius" in q else np.full(len(q), np.inf)
    row, col = np.nonzero(np.isfinite(best.d) & (best.d <= limit[:, None]))
    need = q["need"].to_numpy()[row]
    out = {"qid": q["qid"].to_numpy()[row], "need": need, "pid": best.i[row, col], "dist": best.d[row, col]}
    if values:
        out["value"] = _needed(p, best.at[row, col], need)
    return pd.DataFrame(out)


def _needed(p: pd.DataFrame, at: np.ndarray, need: np.ndarray) -> np.ndarray:
    """What the points at ``at`` have at the coordinates ``need``, if one is needed."""
    if not len(at):
        return np.zeros(0)
    return np.where(need < 0, np.nan, _stacked(p["v"].iloc[at])[np.arange(len(at)), np.maximum(need, 0).astype(np.int64)])


def _box_bounds(x: np.ndarray, need: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Lower bound of the distance of each query to the points of each box."""
    gap = np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0.0)
    present = ~np.isnan(gap)
    n_common = present.sum(axis=2)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = np.sqrt((np.where(present, gap, 0.0) ** 2).sum(axis=2) * x.shape[1] / n_common)
    out[n_common == 0] = np.inf
    lacks = np.isnan(low[:, np.maximum(need, 0)]).T & (need >= 0)[:, None]
    return np.where(lacks, np.inf, out)


def _chosen(bound: np.ndarray, size: np.ndarray, radius: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, box) to go on with: all boxes within the radius; without one, the
    nearest box that holds enough points, if any does."""
    if radius is not None:
        return np.nonzero(np.isfinite(bound) & (bound <= radius[:, None] * SLACK))
    shown = np.where(size[None] > k, bound, np.where(np.isfinite(bound), 1e300, np.inf))
    best = shown.argmin(axis=1)
    row = np.flatnonzero(np.isfinite(shown[np.arange(len(best)), best]))
    return row, best[row]


def _nearest_pivot(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None]
    return d.argmin(axis=1)


class _Top:
    """Cuts and boxes of the first level, small enough to go with every task."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.dims = sample.shape[1]
        leaf = max(1.0, len(sample) / cells)
        self.cuts = {self._name(has): _Cuts(np.where(has, sample[rows], 0.0), leaf)
                     for has, rows in _patterns(~np.isnan(sample))}
        self.names: list[str] = []

    @staticmethod
    def _name(has: np.ndarray) -> str:
        return f"{int(np.packbits(has).tobytes().hex() or '0', 16):x}"

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Cell of each point: the pattern of its present coordinates and its side of their cuts."""
        out = np.empty(len(x), object)
        for has, rows in _patterns(~np.isnan(x)):
            name = self._name(has)
            at = self.cuts[name].leaf_of(np.where(has, x[rows], 0.0)) if name in self.cuts else np.zeros(len(rows), np.int64)
            out[rows] = [f"{name}:{n}" for n in at]
        return out

    def set_boxes(self, rows) -> None:
        self.names = [r["cell"] for r in rows]
        shape = (len(rows), self.dims)
        self.low = np.array([r["low"] for r in rows], float).reshape(shape)
        self.high = np.array([r["high"] for r in rows], float).reshape(shape)
        self.size = np.array([r["n"] for r in rows], np.int64)


_VISIT = "qid long, need long, v binary, radius double, home string, cell string"


def _picked(part: pd.DataFrame, names: np.ndarray, low, high, size, k: int, nearest: bool) -> Iterator[pd.DataFrame]:
    """The boxes each query goes to, in pieces of few queries."""
    step = max(1, BLOCK_CELLS // max(1, low.size))
    for at in range(0, len(part), step):
        q = part.iloc[at:at + step]
        bound = _box_bounds(_stacked(q["v"]), q["need"].to_numpy(np.int64), low, high)
        row, col = _chosen(bound, size, None if nearest else q["radius"].to_numpy(), k)
        yield pd.DataFrame({"qid": q["qid"].to_numpy()[row], "need": q["need"].to_numpy()[row],
                            "v": q["v"].to_numpy()[row], "radius": q["radius"].to_numpy()[row],
                            "home": q["home"].to_numpy()[row] if "home" in q else "", "cell": names[col]})


def _sequence(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _boxes(dealt: DataFrame, dims: int, *more: str) -> DataFrame:
    """(cell, n, low, high) of every cell."""
    return dealt.groupBy("cell", *more).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.min(F.col("v")[i]) for i in range(dims)]).alias("low"),
        F.array(*[F.max(F.col("v")[i]) for i in range(dims)]).alias("high"))


def _dealt_again(inside: DataFrame) -> DataFrame:
    """(pid, v, cell, parent): points of large cells ``inside(pid, v, cell, n)`` at the
    nearest of some pivots of their own cell. A cell meets its pivots block by block."""
    fan = F.least(F.lit(MAX_PIVOTS), F.ceil(F.col("n") / F.lit(POINTS_PER_PIVOT)))
    blocks = F.ceil(F.col("n") / F.lit(POINT_BLOCK)).cast("int")
    h = F.xxhash64("pid")
    pivots = (inside.groupBy("cell", "n", F.pmod(F.xxhash64("pid", F.lit(1)), fan).alias("slot"))
              .agg(F.min(F.struct(h.alias("h"), F.col("pid"), F.col("v"))).alias("p"))
              .select(F.col("cell").alias("cell"), "slot", F.col("p.v").alias("v"), blocks.alias("blocks"))
              .withColumn("block", _sequence("blocks")).drop("blocks"))
    points = inside.select("cell", "pid", "v", F.pmod(F.xxhash64("pid", F.lit(2)), blocks).cast("int").alias("block"))

    def deal(p: pd.DataFrame, near: pd.DataFrame) -> pd.DataFrame:
        if p.empty:
            return pd.DataFrame({"pid": [], "v": [], "cell": [], "parent": []})
        near = near.sort_values("slot")
        at = _nearest_pivot(np.nan_to_num(np.stack(p["v"].to_numpy())), np.nan_to_num(np.stack(near["v"].to_numpy())))
        return pd.DataFrame({"pid": p["pid"], "v": p["v"], "cell": p["cell"] + "." + near["slot"].to_numpy()[at].astype(str),
                             "parent": p["cell"]})

    key = ["cell", "block"]
    return points.groupBy(*key).cogroup(pivots.groupBy(*key)).applyInPandas(
        deal, "pid long, v array<double>, cell string, parent string")


def _block_counts(rows: DataFrame, per_block: int, out: str, of_each: int = 1) -> DataFrame:
    """(cell, blocks) of about ``per_block`` rows each, if ``rows`` are one of ``of_each``."""
    return rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) * of_each / F.lit(per_block)).cast("int").alias(out))


def _down(visits: DataFrame, children: DataFrame, k: int, nearest: bool) -> DataFrame:
    """Visits of cells that were dealt again, passed on to their children; the others as they are."""
    parents = children.select(F.col("parent").alias("cell")).distinct()
    going = visits.join(parents, "cell", "left_semi")
    asked = _block_counts(going, min(QUERY_BLOCK, DOWN_BLOCK), "blocks")
    q = going.join(asked, "cell").withColumn("block", F.pmod(F.xxhash64("qid", "need"), F.col("blocks")).cast("int")).drop("blocks")
    c = (children.withColumnRenamed("cell", "child").withColumnRenamed("parent", "cell").join(asked, "cell")
         .withColumn("block", _sequence("blocks")).drop("blocks"))

    def pick(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("child")
        none = pd.DataFrame({c.split()[0]: [] for c in _VISIT.split(", ")})
        if left.empty or right.empty:
            return none
        return pd.concat([none, *_picked(left, right["child"].to_numpy(object), np.stack(right["low"].to_numpy()),
                                         np.stack(right["high"].to_numpy()), right["n"].to_numpy(np.int64), k, nearest)])

    key = ["cell", "block"]
    passed = q.groupBy(*key).cogroup(c.groupBy(*key)).applyInPandas(pick, _VISIT)
    return visits.join(parents, "cell", "left_anti").select(passed.columns).unionByName(passed)


def _parts(spark) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def _met(visits: DataFrame, points: DataFrame, sizes: DataFrame, first_block: bool, query_block: int,
         some: DataFrame | None = None):
    """Visits and points grouped by cell and block. ``first_block`` takes one block per cell.
    ``some``: the visits of one in ``COUNTED`` queries, from which the blocks are told; a cell
    that none of them visits has one block."""
    told = _block_counts(visits, query_block, "q_blocks") if some is None else _block_counts(
        some, query_block, "q_blocks", COUNTED)
    cut = sizes.select("cell", F.ceil(F.col("n") / F.lit(POINT_BLOCK)).cast("int").alias("p_blocks")).join(
        told, "cell", "inner" if some is None else "left").withColumn("q_blocks", F.coalesce("q_blocks", F.lit(1)))
    p = (points.join(cut, "cell").withColumn("p_block", F.pmod(F.xxhash64("pid"), F.col("p_blocks")).cast("int")))
    q = (visits.join(cut, "cell").withColumn("q_block", F.pmod(F.xxhash64("qid", "need"), F.col("q_blocks")).cast("int")))
    if first_block:
        p, q = p.where(F.col("p_block") == 0), q.withColumn("p_block", F.lit(0))
    else:
        q = q.withColumn("p_block", _sequence("p_blocks"))
    p = p.withColumn("q_block", _sequence("q_blocks")).select("cell", "p_block", "q_block", "pid", "v")
    q = q.select("cell", "p_block", "q_block", "qid", "need", "v", *(["p_blocks"] if first_block else []),
                 *[c for c in ("radius",) if c in visits.columns])
    key = ["cell", "p_block", "q_block"]
    # a block is much work for its size: AQE would put too many of them into one task
    parts = _parts(visits.sparkSession)
    return q.repartition(parts, *key).groupBy(*key).cogroup(p.repartition(parts, *key).groupBy(*key))


def _search(visits: DataFrame, points: DataFrame, sizes: DataFrame, k: int, exclude_self: bool,
            first_block: bool, query_block: int = QUERY_BLOCK, values: bool = False,
            some: DataFrame | None = None) -> DataFrame:
    """Top k of each visit, block by block. ``first_block`` searches one block per cell."""
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _top(left, right, k, exclude_self, values)

    return _met(visits, points, sizes, first_block, query_block, some).applyInPandas(
        meet, _PAIRS + ", value double" * values)


_NEAR = "qid long, need long, v binary, radius double, home string, pids array<long>, dists array<double>, vals array<double>"


def _nearby(visits: DataFrame, points: DataFrame, sizes: DataFrame, k: int, exclude_self: bool, query_block: int,
            some: DataFrame | None = None) -> DataFrame:
    """Each query with what it finds in the first block of its cell: the distance of the k-th as
    its ``radius`` (endless if there are fewer), and ``home``, the cell, if that was all of it."""
    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({c.split()[0]: pd.Series([], dtype=object) for c in _NEAR.split(", ")})
        best = _found(left, right, k, exclude_self)
        need, found = left["need"].to_numpy(np.int64), np.isfinite(best.d)
        vals = np.full(best.d.shape, np.nan)
        row, col = np.nonzero(found)
        vals[row, col] = _needed(right, best.at[row, col], need[row])
        ends = found.sum(axis=1)
        cut = lambda x: [some[:n] for some, n in zip(x, ends)]
        return pd.DataFrame({
            "qid": left["qid"], "need": need, "v": left["v"], "radius": best.d[:, -1],
            "home": np.where(left["p_blocks"].to_numpy() == 1, left["cell"].to_numpy(object), ""),
            "pids": cut(best.i), "dists": cut(best.d), "vals": cut(vals)})

    return _met(visits, points, sizes, True, query_block, some).applyInPandas(meet, _NEAR)


def nearest(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` of ``found(qid, need, pid, dist)`` per query, numbered in ``nn``."""
    w = Window.partitionBy("qid", "need").orderBy("dist", "pid")
    return found.withColumn("nn", F.row_number().over(w)).where(F.col("nn") <= k)


def _counted(queries: DataFrame, many: int) -> DataFrame | None:
    """One in ``COUNTED`` queries, by their hash, if there are ``many``."""
    return None if many < COUNTED_FROM else queries.where(F.pmod(F.xxhash64("qid", F.lit(3)), F.lit(COUNTED)) == 0)


class PivotTree:
    """Points of ``points(id_col, features...)`` in cells, for exact searches.

    ``leaves`` is the table (cell, n) of the cells that are searched, ``levels`` the
    tables of boxes below the first level.
    """

    def __init__(self, points: DataFrame, features: Sequence[str], id_col: str = "id") -> None:
        self.features, self.spark = list(features), points.sparkSession
        dims = len(self.features)
        pts = points.select(F.col(id_col).cast("long").alias("pid"), vector(self.features).alias("v"))
        n_pivots = min(MAX_PIVOTS, max(1, pts.count() // POINTS_PER_PIVOT))
        chosen = pts.orderBy(F.xxhash64("pid"), "pid").limit(SAMPLED * n_pivots).collect()  # at most SAMPLED * MAX_PIVOTS
        top = _Top(np.array([r["v"] for r in chosen], float).reshape(len(chosen), dims), n_pivots)
        drawn = self.spark.sparkContext.broadcast(top)

        def assign(batches):
            for b in batches:
                if len(b):
                    yield b.assign(cell=drawn.value.assign(np.stack(b["v"].to_numpy())))

        def partial(batches):
            for b in batches:
                if len(b):
                    x = np.stack(b["v"].to_numpy())
                    for cell, at in pd.Series(np.arange(len(b))).groupby(drawn.value.assign(x)).indices.items():
                        some = x[at]
                        yield pd.DataFrame({"cell": [cell], "n": [len(at)], "low": [some.min(axis=0)], "high": [some.max(axis=0)]})

        self.points = pts.mapInPandas(assign, "pid long, v array<double>, cell string")
        rows = (pts.mapInPandas(partial, "cell string, n long, low array<double>, high array<double>").groupBy("cell").agg(
            F.sum("n").alias("n"), F.array(*[F.min(F.col("low")[i]) for i in range(dims)]).alias("low"),
            F.array(*[F.max(F.col("high")[i]) for i in range(dims)]).alias("high")).limit(MAX_BOXES + 1).collect())
        if len(rows) > MAX_BOXES:
            raise ValueError(f"more than {MAX_BOXES} cells: too many patterns of missing coordinates")
        top.set_boxes(sorted(rows, key=lambda r: r["cell"]))
        self._top = self.spark.sparkContext.broadcast(top)
        self.leaves = self.spark.createDataFrame([(r["cell"], r["n"]) for r in rows], "cell string, n long")
        self.levels: list[DataFrame] = []
        most = SPLIT * POINTS_PER_PIVOT
        large = self.leaves.where(F.col("n") > most)
        while len(self.levels) < MAX_LEVELS and (self.levels or any(r["n"] > most for r in rows)) and not large.isEmpty():
            again = materialize(_dealt_again(self.points.join(large, "cell")), "dealt")
            children = materialize(_boxes(again, dims, "parent"), "boxes")
            rest = self.points.join(large, "cell", "left_anti")
            self.points = materialize(rest.unionByName(again.drop("parent")), "points")
            self.levels.append(children)
            self.leaves = materialize(self.leaves.join(large, "cell", "left_anti").unionByName(children.select("cell", "n")),
                                      "leaves")
            # a child that holds nearly all of its parent would only be dealt in vain
            whole = large.select(F.col("cell").alias("parent"), F.col("n").alias("of"))
            large = (children.join(whole, "parent").where((F.col("n") > most) & (F.col("n") < 0.95 * F.col("of")))
                     .select("cell", "n"))

    def visits(self, queries: DataFrame, k: int, nearest: bool) -> DataFrame:
        """(qid, need, v, radius, home, cell): the leaves each of ``queries(qid, need, v, radius)``
        goes to, other than its ``home`` if it has one."""
        top = self._top

        def run(batches):
            t = top.value
            for b in batches:
                if len(b) and t.names:
                    if not isinstance(b["v"].iloc[0], bytes):
                        b = b.assign(v=_bytes(np.stack(b["v"].to_numpy())))
                    yield from _picked(b, np.array(t.names, object), t.low, t.high, t.size, k, nearest)

        given = [c for c in ("qid", "need", "v", "radius", "home") if c in queries.columns]
        out = queries.select(*given).mapInPandas(run, _VISIT)
        for children in self.levels:
            out = _down(materialize(out, "visits"), children, k, nearest)
        return out.where(F.col("cell") != F.col("home"))

    def queries(self, rows: DataFrame, id_col: str, need_col: str | None) -> DataFrame:
        need = F.col(need_col).cast("long") if need_col else F.lit(-1).cast("long")
        return rows.select(F.col(id_col).cast("long").alias("qid"), need.alias("need"), vector(self.features).alias("v"))

    def _query_block(self, qs: DataFrame, many: int | None = None) -> int:
        """Queries of a cell that one task takes: fewer if there are few, for every core to have some."""
        cores = self.spark.sparkContext.defaultParallelism
        return min(QUERY_BLOCK, max(MIN_QUERY_BLOCK, (qs.count() if many is None else many) // (2 * cores)))

    def _bounded(self, qs: DataFrame, k: int, exclude_self: bool, query_block: int = QUERY_BLOCK, many: int = 0) -> DataFrame:
        """Queries with what they find in the leaf that looks nearest, which bounds their k-th distance."""
        qs = qs.withColumn("radius", F.lit(float("inf")))
        first, some = (None if q is None else self.visits(q, k, True).drop("radius") for q in (qs, _counted(qs, many)))
        return _nearby(first, self.points, self.leaves, k, exclude_self, query_block, some)

    def found(self, rows: DataFrame, k: int, id_col: str = "id", need_col: str | None = None,
              exclude_self: bool = False) -> DataFrame:
        """``(qid, need, pid, dist, value, nn)`` as :func:`knn` gives them, with what the point has at ``need``."""
        # read again to count the visits of a cell and to make them
        qs = self.queries(rows, id_col, need_col)
        many = qs.count()
        block = self._query_block(qs, many)
        bounded = materialize(self._bounded(qs, k, exclude_self, block, many), "bounded")
        if many >= COUNTED_FROM:
            release_shuffles(self.spark)
        here = bounded.where(F.col("home") != "").select(
            "qid", "need", F.explode(F.arrays_zip("pids", "dists", "vals")).alias("p")).select(
            "qid", "need", F.col("p.pids").alias("pid"), F.col("p.dists").alias("dist"), F.col("p.vals").alias("value"))
        going = bounded.select("qid", "need", "v", "radius", "home")
        visits, some = (None if q is None else self.visits(q, k, False) for q in (going, _counted(going, many)))
        there = _search(visits, self.points, self.leaves, k, exclude_self, False, block, values=True, some=some)
        return nearest(here.unionByName(there), k)

    def search(self, rows: DataFrame, k: int, id_col: str = "id", need_col: str | None = None,
               exclude_self: bool = False) -> DataFrame:
        """``(qid, need, pid, dist, nn)`` as :func:`knn` gives them."""
        return self.found(rows, k, id_col, need_col, exclude_self).drop("value")

    def work(self, rows: DataFrame, k: int, id_col: str = "id", need_col: str | None = None,
             exclude_self: bool = False) -> DataFrame:
        """One row: queries, points, leaves, levels, visits of leaves, and pairs that a search compares."""
        qs = self.queries(rows, id_col, need_col)
        visits = self.visits(self._bounded(qs, k, exclude_self).drop("home"), k, False)
        done = visits.groupBy("cell").agg(F.count(F.lit(1)).alias("q")).join(self.leaves, "cell").agg(
            F.coalesce(F.sum("q"), F.lit(0)).alias("visits"), F.coalesce(F.sum(F.col("q") * F.col("n")), F.lit(0)).alias("pairs"))
        sizes = self.leaves.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_points"), F.count(F.lit(1)).alias("n_leaves"))
        return (qs.agg(F.count(F.lit(1)).alias("n_queries")).crossJoin(sizes).crossJoin(done)  # one row each
                .withColumn("n_levels", F.lit(1 + len(self.levels))))


def knn(queries: DataFrame, points: DataFrame, features: Sequence[str], k: int, id_col: str = "id",
        need_col: str | None = None, exclude_self: bool = False) -> DataFrame:
    """``(qid, need, pid, dist, nn)`` for the k nearest points of every query, ``nn`` = 1..k,
    ties broken by point id. Missing coordinates are left out of a distance, which is
    scaled for it. ``need_col`` of a query is the index of a coordinate that its
    neighbours must have (-1 or no column: none)."""
    return PivotTree(points, features, id_col).search(queries, k, id_col, need_col, exclude_self)
