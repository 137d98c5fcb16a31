"""SimHash near-duplicates by a self-join of binary tries.

1. Every text becomes a 64-bit fingerprint; equal fingerprints are one from then on.
2. Two fingerprints that differ in at most ``budget`` bits agree in one of
   ``budget + 1`` blocks of bits. For each block there is one trie, of the
   fingerprints rotated so that the block comes first: its upper levels allow no
   difference, so every value of the block is the root of a trie of its own.
3. A trie is joined with itself by descending through pairs of nodes. A pair
   splits into the pairs of children, adds one for children of unlike bits, and is
   dropped once the budget is spent. Pairs of small nodes are compared directly.
4. Spark keeps the pairs of nodes that hold too many fingerprints for one task as
   a table and descends in it; the other pairs are descended inside tasks,
   where a node is a range of a sorted array and all pairs of a level move at once.
5. What is asked for is who is reachable from whom, so a pair of nodes that lie in
   one known component is dropped too, and a task returns one pair a member.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.shared import map_arrow, materialize

WORDS = 3
BUDGET = 3
SEED = 42
BITS = 64
CHUNK = 1 << 20          # bytes of text that are split into words at once
NODE_LIMIT = 1 << 17     # fingerprints of a pair of nodes that one task joins
STEP = 4                 # levels that a pair of nodes over the limit descends at once
PAIRS = 1 << 16          # pairs of nodes that a task moves at once
DIRECT = 16              # pairs of fingerprints below two nodes up to which they are compared
RUN = 1 << 17            # fingerprints that a task takes up together, whole tries
HOT_PARTS = 2000
NO_ID = (1 << 63) - 1    # stands for a null doc_id


# ---------------------------------------------------------------- fingerprints

def _words(data: bytes):
    """Words of a text in lists, A-Z lower-cased; long texts in chunks that end at white space."""
    at = 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and data[end] not in b"\x20\t\n\x0b\f\r":
            end += 1
        yield data[at:end].lower().split()
        at = end


def _counted(words: list[bytes], n: int, seed: int) -> tuple[np.ndarray, int]:
    """How many shingles set each bit (most significant first), and how many there are."""
    line = b" ".join(words)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 1
    end = np.cumsum(length)
    start = (end - length)[:len(words) - n + 1].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], seed) for a, b in zip(start, (end[n - 1:] - 1).tolist())),
                    ">u8", len(start))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64), len(start)


def fingerprint(text: str | None, n: int = WORDS, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash over the ``n``-word shingles of a whole text, repeats
    included: a bit is 1 if more than half of the shingle hashes have it."""
    total, count, tail = np.zeros(BITS, np.int64), 0, []
    for words in _words((text or "").encode()):
        tail += words
        if len(tail) >= n:
            bits, some = _counted(tail, n, seed)
            total, count, tail = total + bits, count + some, tail[len(tail) - n + 1:]
    if not count:
        if not tail:
            return 0
        total, count = _counted(tail, len(tail), seed)
    return int.from_bytes(np.packbits(2 * total > count).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = WORDS) -> DataFrame:
    """(doc_id, fp) for every row of ``docs(doc_id, text)``; fp as signed long."""
    def make():
        def step(cols):
            fp = np.array([fingerprint(t, n) for t in cols["text"]], np.uint64)
            return {"doc_id": cols["doc_id"], "fp": fp.view(np.int64)}
        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, fp long")


# ------------------------------------------------------- tries inside one task

def _merge(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining the components of ``i`` and ``j``; a label is its least member."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up


class _Tries:
    """Sorted fingerprints of one or more cells; a node is a range of them."""

    def __init__(self, cell: np.ndarray, v: np.ndarray, budget: int) -> None:
        order = np.lexsort((v, cell))
        self.order, self.cell, self.v, self.budget = order, cell[order], v[order], budget
        self.label = np.arange(len(v))
        self._ones: dict[int, np.ndarray] = {}
        near = self.cell[1:] == self.cell[:-1]
        near &= np.bitwise_count(self.v[1:] ^ self.v[:-1]) <= budget
        at = np.flatnonzero(near)
        self._link(at, at + 1)

    def _link(self, i: np.ndarray, j: np.ndarray) -> None:
        self.label = _merge(self.label, i, j)
        self.turns = np.concatenate([[0], np.cumsum(self.label[1:] != self.label[:-1])])

    def _middle(self, lo: np.ndarray, hi: np.ndarray, depth: int) -> np.ndarray:
        """Where the child of bit 1 of each node starts."""
        if depth not in self._ones:
            bit = (self.v >> np.uint64(BITS - 1 - depth)) & np.uint64(1)
            self._ones[depth] = np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])
        ones = self._ones[depth]
        return hi - (ones[hi] - ones[lo])

    def _settled(self, p: np.ndarray) -> np.ndarray:
        """Pairs of nodes that lie in one known component."""
        a0, a1, b0, b1 = p[:4]
        same = (self.turns[a1 - 1] == self.turns[a0]) & (self.turns[b1 - 1] == self.turns[b0])
        return same & (self.label[a0] == self.label[b0])

    def _compare(self, p: np.ndarray) -> None:
        """All fingerprints below one node with all below the other."""
        for at in range(0, p.shape[1], PAIRS):
            a0, a1, b0, b1 = p[:4, at:at + PAIRS]
            wide, n = b1 - b0, (a1 - a0) * (b1 - b0)
            of = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
            i, j = a0[of] + k // wide[of], b0[of] + k % wide[of]
            ok = (i != j) & (np.bitwise_count(self.v[i] ^ self.v[j]) <= self.budget)
            if ok.any():
                self._link(i[ok], j[ok])

    def _children(self, p: np.ndarray, depth: int) -> np.ndarray:
        a0, a1, b0, b1, differ = p
        am, bm = self._middle(a0, a1, depth), self._middle(b0, b1, depth)
        alike = a0 == b0
        out = np.concatenate([
            np.stack([a0, am, b0, bm, differ]), np.stack([am, a1, bm, b1, differ]),
            np.stack([a0, am, bm, b1, differ + 1]),
            np.stack([am, a1, b0, bm, differ + 1])[:, ~alike]], axis=1)  # a node with itself: once
        return out[:, (out[0] < out[1]) & (out[2] < out[3]) & (out[4] <= self.budget)]

    def join(self, pairs: np.ndarray, depth: int) -> None:
        """Descends from ``pairs`` of nodes (a0, a1, b0, b1, differing bits) at ``depth``,
        the deepest first, so that few levels wait at once."""
        stack = [(depth, pairs)]
        while stack:
            depth, p = stack.pop()
            if p.shape[1] > PAIRS:
                stack += [(depth, p[:, at:at + PAIRS]) for at in range(0, p.shape[1], PAIRS)]
                continue
            p = p[:, ~self._settled(p)]
            if not p.shape[1]:
                continue
            few = ((p[1] - p[0]) * (p[3] - p[2]) <= DIRECT) | (depth == BITS)
            self._compare(p[:, few])
            p = p[:, ~few]
            if p.shape[1]:
                stack.append((depth + 1, self._children(p, depth)))

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(self.label != np.arange(len(self.label)))
        return self.order[at], self.order[self.label[at]]


def _prefix(v: np.ndarray, depth: int) -> np.ndarray:
    return v >> np.uint64(BITS - depth) if depth else np.zeros_like(v)


def joined(cell: np.ndarray, v: np.ndarray, depth: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, the first of their component), positions, for the links inside each
    cell. A cell holds one node of ``depth`` bits, joined with itself, or two, joined
    with each other."""
    tries = _Tries(cell, v, budget)
    cell, v, depth = tries.cell, tries.v, depth[tries.order]
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    for d in np.unique(depth):
        lo, hi = edge[:-1][depth[edge[:-1]] == d], edge[1:][depth[edge[:-1]] == d]
        p = _prefix(v, int(d))
        cut = np.concatenate([[0], np.cumsum(p[1:] != p[:-1])])
        two = cut[lo] != cut[hi - 1]
        middle = np.searchsorted(cut, cut[lo], side="right")  # first position of the second node
        start = np.stack([lo, np.where(two, middle, hi), np.where(two, middle, lo), hi,
                          np.where(two, np.bitwise_count(p[lo] ^ p[hi - 1]), 0)])
        tries.join(start, int(d))
    return tries.forest()


# ------------------------------------------------------------- tries in Spark

def _rotated(fps: DataFrame, width: int, blocks: int) -> DataFrame:
    """(trie, v, node): each fingerprint once per block, with that block in front."""
    def turned(by: int) -> Column:
        if by == 0:
            return F.col("fp")
        return F.shiftleft("fp", by).bitwiseOR(F.shiftrightunsigned("fp", BITS - by))

    each = F.array(*[F.struct(F.lit(i).alias("trie"), turned(i * width).alias("v")) for i in range(blocks)])
    return fps.select("node", F.explode(each).alias("e")).select("e.trie", "e.v", "node")


def _top(depth: int) -> Column:
    """The node of ``depth`` bits that holds a fingerprint."""
    return F.shiftrightunsigned("v", BITS - depth) if depth < BITS else F.col("v")


def _cells(rotated: DataFrame, width: int, budget: int, limit: int) -> DataFrame:
    """(cell, v, node, depth): the pairs of nodes that tasks join, at most ``limit``
    fingerprints each. Pairs over the limit descend by ``STEP`` levels at a time."""
    depth = width
    count = rotated.groupBy("trie", _top(depth).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    large = materialize(count.filter(F.col("n") > limit).select("trie", "p"), "large-nodes")
    out = rotated.withColumn("p", _top(depth)).join(large, ["trie", "p"], "left_anti").select(
        F.xxhash64("trie", "p").alias("cell"), "v", "node", F.lit(depth).alias("depth"))
    pairs = large.select("trie", "p", F.col("p").alias("q"), F.lit(0).alias("differ"))
    inside = rotated
    while not pairs.isEmpty():
        ends = pairs.select("trie", "p").unionByName(pairs.select("trie", F.col("q").alias("p"))).distinct()
        inside = materialize(inside.withColumn("p", _top(depth)).join(ends, ["trie", "p"], "left_semi")
                             .select("trie", "v", "node"), "inside-large")
        deeper = min(depth + STEP, BITS)
        child = materialize(inside.groupBy("trie", _top(depth).alias("p"), _top(deeper).alias("c")).agg(
            F.count(F.lit(1)).alias("n")), "child-nodes")
        left = child.select("trie", "p", F.col("c").alias("cp"), F.col("n").alias("n_p"))
        right = child.select("trie", F.col("p").alias("q"), F.col("c").alias("cq"), F.col("n").alias("n_q"))
        unlike = F.bit_count(F.col("cp").bitwiseXOR(F.col("cq"))) - F.bit_count(F.col("p").bitwiseXOR(F.col("q")))
        held = F.when(F.col("cp") == F.col("cq"), F.col("n_p")).otherwise(F.col("n_p") + F.col("n_q"))
        met = (pairs.join(left, ["trie", "p"]).join(right, ["trie", "q"])
               .filter((F.col("p") != F.col("q")) | (F.col("cp") <= F.col("cq")))
               .withColumn("differ", (F.col("differ") + unlike).cast("int")).filter(F.col("differ") <= budget)
               .select("trie", F.col("cp").alias("p"), F.col("cq").alias("q"), "differ",
                       ((held > limit) & F.lit(deeper < BITS)).alias("large")))
        met, depth = materialize(met, "node-pairs"), deeper
        cell = F.xxhash64("trie", "p", "q", F.lit(depth)).alias("cell")
        side = met.filter(~F.col("large")).select("trie", cell, F.explode(F.array_distinct(F.array("p", "q"))).alias("p"))
        out = out.unionByName(inside.withColumn("p", _top(depth)).join(side, ["trie", "p"])
                              .select("cell", "v", "node", F.lit(depth).alias("depth")))
        pairs = met.filter("large").drop("large")
    return out


def links(fps: DataFrame, budget: int = BUDGET, limit: int = NODE_LIMIT, run_size: int = RUN) -> DataFrame:
    """(a, b): pairs of nodes whose fingerprints are reachable from each other over links
    of at most ``budget`` differing bits between the distinct fingerprints ``fps(fp, node)``;
    together they reach whatever all links reach."""
    blocks = budget + 1
    width = BITS // blocks
    rows = _cells(_rotated(fps, width, blocks), width, budget, limit).repartition("cell").sortWithinPartitions("cell")

    def settle(part: pa.Table) -> pa.RecordBatch:
        i, j = joined(part["cell"].to_numpy(), part["v"].to_numpy().view(np.uint64), part["depth"].to_numpy(), budget)
        node = part["node"].to_numpy()
        return pa.RecordBatch.from_pydict({"a": node[i], "b": node[j]})

    def run(batches):
        kept: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size < run_size:
                continue
            table = pa.Table.from_batches(kept)
            cell = table["cell"].to_numpy()
            whole = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if whole:
                yield settle(table.slice(0, whole))
            kept, size = table.slice(whole).to_batches(), table.num_rows - whole
        if size:
            yield settle(pa.Table.from_batches(kept))

    return rows.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = WORDS, budget: int = BUDGET, limit: int = NODE_LIMIT) -> DataFrame:
    """doc_id, fingerprint, component_id, copy_id for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable over fingerprints that differ
    in at most ``budget`` bits, ``copy_id`` the smallest with the same fingerprint. A
    text with fewer than ``n`` words is one shingle; a null, empty or wordless text
    has the fingerprint zero, which is linked like any other. Texts of any length are
    read whole, in chunks. Rows that share a ``doc_id`` are one document and tie their
    fingerprints together. Rows with a null ``doc_id`` count as one document after all
    others; its component is null if it reaches no other. An empty table gives no rows;
    other columns are not read.
    """
    rows = materialize(fingerprints(docs, n).withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("n")), "groups")
    near = links(groups.select("fp", "node"), budget, limit)
    several = rows.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("lo <> hi")
    ties = (rows.join(several.select("doc_id"), "doc_id", "left_semi").distinct()
            .join(groups.select("fp", "node"), "fp").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    labels = components(near.unionByName(ties))
    named = (groups.join(labels.select(F.col("node").alias("l_node"), "label"), F.col("node") == F.col("l_node"), "left")
             .select("fp", "n", F.col("node").alias("copy_id"), F.coalesce("label", "node").alias("component_id")))
    named = materialize(named, "named")
    # fingerprints that many rows share would send them to one task: at most HOT_PARTS of those
    total = rows.count()
    hot = F.broadcast(named.filter(F.col("n") * HOT_PARTS > total).drop("n"))
    calm = named.filter(F.col("n") * HOT_PARTS <= total).drop("n")
    calm_rows = rows.join(F.broadcast(hot.select("fp")), "fp", "left_anti")
    full = rows.join(hot, "fp").unionByName(calm_rows.join(calm, "fp"))
    named_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return full.select(named_id("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                       named_id("component_id"), named_id("copy_id"))
