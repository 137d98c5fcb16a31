"""Hard-negative mining with Four-Russians scoring.

Components are integers, so a score is an exact integer inner product. The
components of a candidate are written in two's complement and cut into bit planes;
eight components of one plane are one byte. For an anchor, the sums of all 256
subsets of eight components are a table. A score is then a walk down the planes:
double what there is, and add for every eight components the table's entry at the
byte; the sign plane counts negative.

Anchors go out in blocks of bounded size and meet all rows, twice: first the
rows of their own label, which gives their positives, then those of other labels,
whose scores must lie below a positive's. A task keeps the best few of each
anchor; what tasks keep is merged by Spark.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.shared import materialize

SCALE = 256.0
EVERY = 100              # anchors: ids divisible by this
SHIFTED = 7              # ids whose label moves on by one
LABELS = 10
POSITIVES = 5
NEGATIVES = 5
FLOOR = 80               # per cent of the positive's score
ANCHOR_BYTES = 4 << 20   # vectors of one broadcast block of anchors
TILE = 128               # anchors whose tables are held at once
ROWS = 2048              # candidates that are scored at once
NO_ID = (1 << 63) - 1    # stands for a null vec_id, after all others
_LEAST = np.iinfo(np.int64).min


# ------------------------------------------------------------------- scoring

def bit_planes(x: np.ndarray) -> np.ndarray:
    """Two's complement bit planes of the rows of ``x`` (n, dims), the sign first:
    bytes (n, planes, groups of eight dims), as few planes as the rows need."""
    groups = -(-x.shape[1] // 8)
    full = np.zeros((len(x), groups * 8), np.int64)
    full[:, :x.shape[1]] = x
    most = int(np.maximum(full, ~full).max(initial=0))
    n_planes = most.bit_length() + 1
    bits = (full[:, None, :] >> np.arange(n_planes - 1, -1, -1)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2)


def subset_sums(a: np.ndarray, dtype) -> np.ndarray:
    """(groups, 256, anchors): sums of the subsets of eight components that a byte
    names, its highest bit the first component. Each entry adds one component to
    one that is there already."""
    groups = -(-a.shape[1] // 8)
    full = np.zeros((len(a), groups * 8), dtype)
    full[:, :a.shape[1]] = a
    parts = full.T.reshape(groups, 8, len(a))
    out = np.zeros((groups, 256, len(a)), dtype)
    for bit in range(8):
        size = 1 << bit
        out[:, size:2 * size] = out[:, :size] + parts[:, 7 - bit][:, None]
    return out


def scores(planes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(candidates, anchors): full exact inner products by shift and add."""
    at = planes.astype(np.intp)
    out = np.zeros((len(planes), tables.shape[2]), tables.dtype)
    line = np.empty_like(out)
    for plane in range(planes.shape[1]):
        if plane:
            out += out
        for group in range(min(planes.shape[2], len(tables))):
            np.take(tables[group], at[:, plane, group], axis=0, out=line, mode="clip")
            if plane:
                out += line
            else:
                out -= line
    return out


def _sum_type(a: np.ndarray, planes: int):
    """int32 where every step of a score is known to fit, else int64."""
    most = int(np.abs(a).sum(axis=1, dtype=np.float64).max(initial=0)) << planes
    if most >= 1 << 56:
        raise ValueError("inner products of these vectors do not fit in a long")
    return np.int32 if most < 1 << 30 else np.int64


# ---------------------------------------------------------------- preparation

def prepare(rows: DataFrame) -> DataFrame:
    """(rid, vec_id, label, dims, n_planes, x, planes) of the rows that take part, written
    out: labels moved on, components as integers and as packed bit planes."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("v").combine_chunks() if isinstance(batch.column("v"), pa.ChunkedArray) else batch.column("v")
            dims = np.diff(lists.offsets.to_numpy())
            flat = np.floor(np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64) * SCALE)
            if len(flat) and np.abs(flat).max() >= 2.0 ** 53:
                raise ValueError("components from 2 ** 45 on have no exact product here")
            flat, end = flat.astype(np.int64), np.cumsum(dims)
            out: dict[str, list] = {"at": [], "n_planes": [], "x": [], "planes": []}
            most = np.zeros(len(dims), np.int64)
            full = np.flatnonzero(dims)
            if len(full):
                most[full] = np.maximum.reduceat(np.maximum(flat, ~flat), (end - dims)[full])
            width = np.array([int(m).bit_length() + 1 for m in most], np.int64)
            for d, w in set(zip(dims.tolist(), width.tolist())):
                rows_ = np.flatnonzero((dims == d) & (width == w))
                x = flat[(end - dims)[rows_][:, None] + np.arange(d)[None]]
                planes = bit_planes(x)
                out["at"] += rows_.tolist()
                out["n_planes"] += [planes.shape[1]] * len(rows_)
                out["x"] += [r.tobytes() for r in x]
                out["planes"] += [r.tobytes() for r in planes]
            part = batch.take(pa.array(out["at"], pa.int64()))
            yield pa.RecordBatch.from_pydict({
                "rid": part.column("rid"), "vec_id": part.column("vec_id"), "label": part.column("label"),
                "dims": pa.array(dims[out["at"]].astype(np.int32)), "n_planes": pa.array(out["n_planes"], pa.int32()),
                "x": pa.array(out["x"], pa.binary()), "planes": pa.array(out["planes"], pa.binary())})

    value = F.col("embedding").cast("array<double>")
    good = (F.col("label").isNotNull() & F.col("embedding").isNotNull()
            & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    label = F.when(F.coalesce(F.col("vec_id") % SHIFTED == 0, F.lit(False)), (F.col("label") + 1) % LABELS).otherwise(
        F.col("label"))
    kept = rows.filter(good).select(
        F.monotonically_increasing_id().alias("rid"),
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.cast("long").alias("label"),
        value.alias("v"))
    return materialize(kept.mapInArrow(
        run, "rid long, vec_id long, label long, dims int, n_planes int, x binary, planes binary"), "vectors")


class _Block:
    """A block of anchors: vectors, labels and, for the second pass, the scores of their positives."""

    def __init__(self, table: pa.Table, positives: pa.Table | None = None) -> None:
        self.rid, self.label = table["rid"].to_numpy(), table["label"].to_numpy()
        order = np.argsort(self.rid, kind="stable")
        self.rid, self.label = self.rid[order], self.label[order]
        vectors = table["x"].to_pylist()
        dims = max((len(v) // 8 for v in vectors), default=0)
        self.x = np.zeros((len(order), dims), np.int64)
        for i, at in enumerate(order):
            v = np.frombuffer(vectors[at], np.int64)
            self.x[i, :len(v)] = v
        self.caps = None
        if positives is not None:  # the distinct scores of its positives, highest first, then nothing
            self.caps = np.full((len(order), POSITIVES), _LEAST)
            at = np.searchsorted(self.rid, positives["rid"].to_numpy())
            self.caps[at, positives["slot"].to_numpy()] = positives["score"].to_numpy()


class _Best:
    """The best few (score, id) of each of ``n`` keys, fed with candidates."""

    def __init__(self, n: int, keep: int) -> None:
        self.keep = keep
        self.key = self.score = self.id = np.empty(0, np.int64)
        self.row = np.empty(0, np.int64)
        self.least = np.full(n, _LEAST)    # what a candidate must reach

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        key, score = np.concatenate([self.key, key]), np.concatenate([self.score, score])
        ids, row = np.concatenate([self.id, ids]), np.concatenate([self.row, row])
        order = np.lexsort((row, ids, -score, key))
        key = key[order]
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        rank = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
        order, last = order[rank < self.keep], order[rank == self.keep - 1]
        self.least[key[rank == self.keep - 1]] = score[last]
        self.key, self.score, self.id, self.row = key[rank < self.keep], score[order], ids[order], row[order]


def _pass(rows: DataFrame, block, first: bool) -> DataFrame:
    """(rid, slot, score, vec_id, row): the best of every task for each anchor. In the first
    pass rows of the anchor's label; in the second those of other labels whose score
    lies below a positive's, once for each distinct score (``slot``) of a positive."""
    def run(batches):
        b = block.value
        slots = 1 if first else POSITIVES
        best = [_Best(min(TILE, len(b.rid) - at) * slots, POSITIVES if first else NEGATIVES)
                for at in range(0, len(b.rid), TILE)]
        tables: dict = {}

        def feed(part: pa.RecordBatch, dims: int, n_planes: int) -> None:
            groups = -(-dims // 8)
            planes = np.frombuffer(b"".join(part["planes"].to_pylist()), np.uint8).reshape(part.num_rows, n_planes, groups)
            rid, ids, label = (part[c].to_numpy() for c in ("rid", "vec_id", "label"))
            for tile, kept in enumerate(best):
                mine = slice(tile * TILE, (tile + 1) * TILE)
                wanted = np.isin(label, b.label[mine]) if first else slice(None)
                got = planes[wanted]
                if not len(got):
                    continue
                s = scores(got, subset_sums(b.x[mine], _sum_type(b.x[mine], n_planes)))
                alike = label[wanted][:, None] == b.label[mine][None]
                if first:
                    i, j = np.nonzero(alike & (s >= kept.least[None]))
                    other = rid[wanted][i] != b.rid[mine][j]
                    i, j = i[other], j[other]
                    kept.add(j, s[i, j].astype(np.int64), ids[wanted][i], rid[wanted][i])
                    continue
                caps = b.caps[mine]
                some = caps != _LEAST
                # a score reaches FLOOR per cent of a positive's only if that is not negative
                low = np.where(some, -((-FLOOR * np.where(some, caps, 0)) // 100), 1 << 62).min(axis=1)
                i, j = np.nonzero(~alike & (s <= caps[:, 0][None]) & (s >= low[None]))
                score = s[i, j].astype(np.int64)
                for slot in range(POSITIVES):
                    cap = caps[j, slot]
                    key = j * POSITIVES + slot
                    ok = (cap != _LEAST) & (score <= cap) & (100 * score >= FLOOR * cap) & (score >= kept.least[key])
                    if ok.any():
                        kept.add(key[ok], score[ok], ids[i[ok]], rid[i[ok]])

        for batch in batches:
            shape = batch.column("dims").to_numpy().astype(np.int64) * 64 + batch.column("n_planes").to_numpy()
            for kind in np.unique(shape):
                same = batch.take(pa.array(np.flatnonzero(shape == kind)))
                for at in range(0, same.num_rows, ROWS):
                    feed(same.slice(at, ROWS), int(kind) // 64, int(kind) % 64)
        for tile, kept in enumerate(best):
            yield pa.RecordBatch.from_pydict({
                "rid": b.rid[tile * TILE + kept.key // slots], "slot": (kept.key % slots).astype(np.int32),
                "score": kept.score, "vec_id": kept.id, "row": kept.row})

    return rows.select("rid", "vec_id", "label", "dims", "n_planes", "planes").mapInArrow(
        run, "rid long, slot int, score long, vec_id long, row long")


def _first(found: DataFrame, keys: list[str], keep: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def mine(rows: DataFrame, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score from
    ``rows(vec_id, embedding, label)``: for every anchor and each of its positives the
    best rows of other labels that score between ``FLOOR`` per cent of the positive's
    score and that score.

    Rows with a null label, a null vector, or a null or non-finite component take no
    part. A null ``vec_id`` comes after all others in ties, is no anchor and is null
    in the result. Rows that share a ``vec_id`` are rows of their own; all of those are
    anchors and each may be a positive of the other. Equal scores go by the smaller
    ``vec_id``. Vectors of unlike length are multiplied as far as both reach; an empty
    vector scores zero. A negative positive score has no negatives. An anchor without
    positives or negatives has no rows, and an empty table gives none. Components whose
    products do not fit in a long raise an error. Other columns are not read.
    """
    spark = rows.sparkSession
    vectors = prepare(rows)
    anchors = vectors.filter((F.col("vec_id") % EVERY == 0) & (F.col("vec_id") != NO_ID))
    about = anchors.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("dims").cast("long") * 8 + 64), F.lit(0))).first()
    n_blocks = max(1, -(-2 * about[1] // anchor_bytes))  # dealt by hash, half full on average
    found = None
    for k in range(n_blocks if about[0] else 0):
        mine_ = anchors if n_blocks == 1 else anchors.filter(F.pmod(F.xxhash64("rid"), F.lit(n_blocks)) == k)
        table = mine_.select("rid", "label", "x").toArrow()  # one block
        block = spark.sparkContext.broadcast(_Block(table))
        positives = materialize(_first(_pass(vectors, block, True), ["rid"], POSITIVES), "positives")
        slot = F.dense_rank().over(Window.partitionBy("rid").orderBy(F.desc("score"))) - 1
        positives = positives.withColumn("slot", slot.cast("int"))
        caps = positives.select("rid", "slot", "score").distinct().toArrow()  # at most POSITIVES for each of the block
        block = spark.sparkContext.broadcast(_Block(table, caps))
        negatives = _first(_pass(vectors, block, False), ["rid", "slot"], NEGATIVES)
        part = positives.select("rid", "slot", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")).join(
            negatives.select("rid", "slot", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")),
            ["rid", "slot"])
        part = materialize(part, "negatives")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                         "positive_score long, negative_score long")
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return found.join(anchors.select("rid", F.col("vec_id").alias("anchor_id")), "rid").select(
        "anchor_id", named("positive_id"), F.col("rank").cast("int").alias("rank"), named("negative_id"),
        "positive_score", "negative_score")


SQL = f"""
WITH part AS (
  SELECT vec_id, CASE WHEN vec_id % {SHIFTED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE:.0f} * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike,
         list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM (SELECT * FROM part WHERE vec_id % {EVERY} = 0) a JOIN part c ON a.vec_id <> c.vec_id),
pos AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE alike
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES})
SELECT anchor_id, positive_id,
       (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM pos JOIN scored s USING (anchor_id)
WHERE NOT s.alike AND {FLOOR} * positive_score <= 100 * s.score AND s.score <= positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= {NEGATIVES}"""
