"""Jaccard join of word n-gram sets: size-banded tiles with bitmap signatures.

1. Every text becomes its set of hashed n-word shingles. Equal sets are one
   class from here on; copies are attached again at the end.
2. Two sets with Jaccard similarity t share at least one of the first
   n - ceil(t * n) + 1 shingles under any common order. The order puts shingles
   that fall into thinly used slots of a corpus-wide counting sketch first, so
   passages that many documents share come last and hardly bring anyone together.
3. A tile holds the classes that share such a shingle and whose sizes fall in
   one band or the next (sizes of linked sets differ by at most a factor t).
   Tiles with the same members are one tile. Large tiles are cut into blocks.
4. Within a tile a parity bitmap bounds the overlap from above: the bits in which
   two bitmaps differ are at most the elements in which the sets do. A bitmap is
   as long as its set asks for; folding it gives the shorter one. Only pairs that
   the bound lets through are intersected, exactly.
5. What is asked for is who is reachable from whom, so pairs inside a component
   that is already known are not compared. First every class meets its nearest
   neighbour and the middle of its block, then components meet through one
   member each, and at last every remaining pair across components is settled.
   The first two rounds only save work; the last leaves no pair open.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.graph import components
from riskloom.llm.shared import map_arrow, materialize

WORDS = 4
PERCENT = 85
BLOCK = 1024
SLOT_BITS = 17           # slots of the counting sketch: fixed, 1 MB to broadcast
MIN_BITS, MAX_BITS = 512, 16384
FEW = 4                  # pairs per member up to which a cell is settled at once
FILTER_BITS = 26         # bits of the filter for texts that are asked for: 8 MB
CHUNK = 1 << 20
HOT_PARTS = 2000
NO_ID = (1 << 63) - 1    # stands for a null doc_id

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xD6E8FEB86659FD93)


# Words are hashed for a whole chunk of text at once: every byte has a random
# value, a word is the sum of its values times the powers of an odd base, taken
# as a difference of running sums and divided by the power of its start.
_BYTE = np.random.default_rng(20240).integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64, kept for the next text."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1024, 1 << (n - 1).bit_length())
        have = np.full(size, base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX2
    return h ^ (h >> np.uint64(29))


def _chunk_words(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[b], [True]]).astype(np.int8))
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    run = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power(_BASE, len(b)), out=run[1:])
    return _mixed((run[end] - run[start]) * _power(_INVERSE, len(b) + 1)[start] + (end - start).astype(np.uint64))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a whole text, A-Z lower-cased, in order. Long
    texts are hashed in chunks that end at white space."""
    data = (text or "").encode().translate(_LOWER)
    if len(data) <= CHUNK:
        return _chunk_words(data) if data else np.empty(0, np.uint64)
    parts, at = [], 0
    while at < len(data):
        end = at + CHUNK
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        parts.append(_chunk_words(data[at:end]))
        at = end
    return np.concatenate(parts)


def shingle_set(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of a whole text."""
    w = word_hashes(text)
    if not len(w):
        return w
    k = min(n, len(w))
    h = w[:len(w) - k + 1].copy()
    for i in range(1, k):
        h = h * _MIX + w[i:len(w) - k + 1 + i]
    h = _mixed(h + np.uint64(n - k))  # a short text is no shingle of a longer one
    h.sort()
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    """Parity of the number of shingles in each hash bucket. The buckets are a power
    of two, as many as the set has elements, within ``MIN_BITS`` and ``MAX_BITS``."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (len(shingles) - 1).bit_length()))
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """The bitmap over fewer buckets: buckets that fall together add up their parity."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) > size:
        x = x[:len(x) // 2] ^ x[len(x) // 2:]
    return x


def linked(common, size_a, size_b, percent: int = PERCENT):
    """100 * intersection >= percent * union."""
    return (100 + percent) * common >= percent * (size_a + size_b)


def _sketch(texts: DataFrame, n: int) -> np.ndarray:
    """Rank of each slot by how many (document, shingle) pairs of the whole table fall into it."""
    def run(batches):
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                found = [slots(shingle_set(t, n)) for t in batch.column("text").slice(at, 256).to_pylist()]
                total += np.bincount(np.concatenate(found), minlength=1 << SLOT_BITS)
        at = np.flatnonzero(total)
        for k in range(0, len(at), 1 << 15):
            yield pa.RecordBatch.from_pydict({"slot": at[k:k + (1 << 15)], "n": total[at[k:k + (1 << 15)]]})

    load = np.zeros(1 << SLOT_BITS, np.int64)
    rows = (texts.select("text").mapInArrow(run, schema="slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).toArrow())  # at most 2 ** SLOT_BITS rows
    load[rows["slot"].to_numpy()] = rows["n"].to_numpy()
    rank = np.empty(1 << SLOT_BITS, np.uint64)
    rank[np.lexsort((np.arange(1 << SLOT_BITS), load))] = np.arange(1 << SLOT_BITS, dtype=np.uint64)
    return rank


def _signatures(texts: DataFrame, rank, n: int, percent: int) -> DataFrame:
    """(node, size, digest, prefix, bitmap) of every row."""
    def make():
        order = rank.value

        def step(cols):
            out = {"node": cols["node"], "size": [], "digest": [], "prefix": [], "bitmap": []}
            for text in cols["text"]:
                s = shingle_set(text, n)
                out["size"].append(len(s))
                if not len(s):
                    for k in ("digest", "prefix", "bitmap"):
                        out[k].append(None)
                    continue
                take = len(s) + (-percent * len(s)) // 100 + 1   # size - ceil(t * size) + 1
                key = (order[slots(s)] << np.uint64(40)) | (s >> np.uint64(24))
                first = s[np.argsort(key, kind="stable")[:take]]
                out["digest"].append(xxhash.xxh3_128_digest(s.tobytes()))
                out["prefix"].append(first.view(np.int64))
                out["bitmap"].append(bitmap(s))
            return out
        return step

    return map_arrow(texts, make, "node long, size long, digest binary, prefix array<long>, bitmap binary")


def _tiles(tokens: DataFrame, sizes: DataFrame, percent: int, hot_parts: int = HOT_PARTS) -> DataFrame:
    """(tile, band, own, node, size): who meets whom. A class belongs to the band of
    its size and visits the next one, where sets up to 1/t larger are."""
    both = [F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1)))]
    # what over 1 / HOT_PARTS of the rows hold is summed by parts and sent to its rows: at most HOT_PARTS tokens
    total = tokens.count()
    held = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") * hot_parts > total)
    hot = materialize(held.filter(F.col("m") >= 2).select("token"), "hot-tokens")
    sums = tokens.join(F.broadcast(hot), "token", "left_semi").groupBy("token").agg(
        both[0].alias("x"), both[1].alias("y"), F.count(F.lit(1)).alias("m"))
    of_hot = tokens.join(F.broadcast(sums), "token").select("node", "x", "y", "m")
    same = Window.partitionBy("token")
    calm = (tokens.join(F.broadcast(hot), "token", "left_anti")
            .withColumn("m", F.count(F.lit(1)).over(same)).filter(F.col("m") >= 2)
            .select("node", both[0].over(same).alias("x"), both[1].over(same).alias("y"), "m"))
    met = calm.unionByName(of_hot)
    # tiles with the same members are one; should two others share a hash, they meet for nothing
    met = met.select(F.xxhash64("x", "y", "m").alias("tile"), "node").distinct()
    width = math.log(100 / percent) * (1 + 1e-9)  # a rounding error never parts linked sizes by two bands
    own_band = F.floor(F.log(F.col("size").cast("double")) / F.lit(width)).cast("int")
    met = (met.hint("merge").join(sizes, "node").withColumn("own_band", own_band)
           .withColumn("band", F.explode(F.array("own_band", F.col("own_band") + 1)))
           .select("tile", "band", (F.col("band") == F.col("own_band")).alias("own"), "node", "size"))
    met = materialize(met, "met")
    crowd = met.groupBy("tile", "band").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("any_own")).filter(
        (F.col("n") >= 2) & F.col("any_own")).select("tile", "band", "n")
    return materialize(met.join(crowd.hint("merge"), ["tile", "band"]), "tiles")


def _cell(members: list, left: int, right: int, near: bool, percent: int) -> tuple[set, bool]:
    """Candidate pairs of one cell, and whether some were left out. ``near``: if more
    pairs pass the bitmap bound than ``FEW`` per member, each member is paired only
    with its nearest and with the middle of the cell."""
    node = np.array([m["node"] for m in members], np.int64)
    size = np.array([m["size"] for m in members], np.int64)
    label = np.array([m["label"] for m in members], np.int64)
    own = np.array([m["own"] for m in members], bool)
    block = np.array([m["block"] for m in members], np.int64)
    shortest = min(len(m["bitmap"]) for m in members) // 8
    bits = np.stack([folded(m["bitmap"], shortest) for m in members])
    rows, cols = np.flatnonzero(block == left), np.flatnonzero(block == right)
    most_links = FEW * len(members)
    out: set[tuple[int, int]] = set()
    passed, count = [], 0
    spread = np.full(len(members), np.iinfo(np.int64).max)
    near_at = np.full(len(members), -1)
    for at in range(0, len(rows), 64):
        r = rows[at:at + 64]
        differ = np.bitwise_count(bits[r][:, None, :] ^ bits[cols][None]).sum(axis=2, dtype=np.int64)
        total = size[r][:, None] + size[cols][None]
        low, high = np.minimum(size[r][:, None], size[cols][None]), np.maximum(size[r][:, None], size[cols][None])
        ok = linked((total - differ) // 2, total, 0, percent) & (100 * low >= percent * high)
        ok &= (own[r][:, None] | own[cols][None]) & (label[r][:, None] != label[cols][None])
        ok &= node[r][:, None] != node[cols][None]
        if not ok.any():
            continue
        i, j = np.nonzero(ok)
        count += len(i)
        if not near or count <= 2 * most_links:
            a, b = node[r[i]], node[cols[j]]
            out.update(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
        if near:
            shown = np.where(ok, differ, np.iinfo(np.int64).max)
            near_at[r] = np.where(ok.any(axis=1), cols[shown.argmin(axis=1)], -1)
            spread[r] = np.where(ok.any(axis=1), np.where(ok, differ, 64 * shortest).sum(axis=1), spread[r])
            passed.append((r, ok))
    if not near or count <= 2 * most_links:  # each pair was seen from both sides
        return out, False
    having = np.flatnonzero(near_at >= 0)
    middle = int(np.argmin(spread))
    at = int(np.flatnonzero(cols == middle)[0])
    pairs = [(node[i], node[near_at[i]]) for i in having]
    pairs += [(node[i], node[middle]) for r, ok in passed for i in r[ok[:, at]]]
    return {(int(min(a, b)), int(max(a, b))) for a, b in pairs}, True


def _candidates(tiles: DataFrame, bitmaps: DataFrame, labels: DataFrame, percent: int, block: int,
                step: str) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) to intersect, and the (tile, band) that are not settled by them.

    ``near`` stays inside blocks of ``block`` members, ``heads`` lets one member of
    each component meet, ``rest`` lets all meet across components. Bitmaps join
    last, so all but the final grouping moves narrow rows.
    """
    known = labels.select(F.col("node").alias("l_node"), "label")
    rows = (tiles.hint("merge").join(known, F.col("node") == F.col("l_node"), "left").drop("l_node")
            .withColumn("label", F.coalesce("label", "node")))
    if step != "near":  # tiles of a single component are settled
        mixed = (rows.groupBy("tile", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
                 .filter(F.col("lo") != F.col("hi")).select("tile", "band"))
        rows = rows.join(mixed.hint("merge"), ["tile", "band"], "left_semi")
    if step == "heads":
        rows = rows.groupBy("tile", "band", "own", "label").agg(F.min(F.struct("node", "size")).alias("head")).select(
            "tile", "band", "own", "label", "head.*")
    if step == "near":
        # whole tiles mostly: one block, or as many as the size of the tile asks for
        cells = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(block)))).drop("n")
        cells = cells.withColumn("left", F.col("block")).withColumn("right", F.col("block"))
    else:
        # a component that fills blocks alone is kept apart from the others
        rows = materialize(rows.select("tile", "band", "own", "label", "node", "size"), "tile-rows")
        per = rows.groupBy("tile", "band", "label").agg(F.count(F.lit(1)).alias("n"))
        per = per.withColumn("big", F.when(F.col("n") >= block, F.col("label")))
        parts = (per.groupBy("tile", "band", "big")
                 .agg(F.ceil(F.sum("n") / F.lit(block)).cast("int").alias("parts")))
        rows = (rows.join(per.select("tile", "band", "label", "big"), ["tile", "band", "label"])
                .join(parts.select(F.col("tile").alias("p_tile"), F.col("band").alias("p_band"),
                                   F.col("big").alias("p_big"), "parts"),
                      (F.col("tile") == F.col("p_tile")) & (F.col("band") == F.col("p_band"))
                      & F.col("big").eqNullSafe(F.col("p_big"))).drop("p_tile", "p_band", "p_big"))
        rows = rows.withColumn("block", F.xxhash64("big", F.pmod(F.xxhash64("node"), F.col("parts")))).drop("parts")
        blocks = rows.select("tile", "band", "big", "block").distinct()
        other = blocks.select("tile", "band", F.col("big").alias("o_big"), F.col("block").alias("o_block"))
        pairs = (blocks.join(other, ["tile", "band"])
                 .filter((F.col("block") <= F.col("o_block"))
                         & (F.col("big").isNull() | F.col("o_big").isNull() | (F.col("big") != F.col("o_big"))))
                 .select("tile", "band", F.col("block").alias("left"), F.col("o_block").alias("right")))
        side = pairs.withColumn("block", F.explode(F.array_distinct(F.array("left", "right"))))
        cells = rows.join(side, ["tile", "band", "block"])
    member = F.struct("node", "size", "own", "label", "block", "bitmap")
    grouped = (cells.hint("merge").join(bitmaps, "node")
               .groupBy("tile", "band", "left", "right").agg(F.collect_list(member).alias("members"))
               .filter(F.size("members") >= 2).select("tile", "band", "members", "left", "right"))

    def make():
        def run(cols):
            out = {"a": [], "b": [], "band": []}
            found = set()
            for tile, band, members, left, right in zip(*(cols[c] for c in ("tile", "band", "members", "left", "right"))):
                pairs, some_left = _cell(members, left, right, step == "near", percent)
                found |= pairs
                if some_left:
                    out["a"].append(tile)
                    out["b"].append(None)
                    out["band"].append(band)
            for a, b in sorted(found):
                out["a"].append(a)
                out["b"].append(b)
                out["band"].append(None)
            return out
        return run

    made = materialize(map_arrow(grouped, make, "a long, b long, band int", rows_per_step=64).distinct(), "candidates")
    open_ = made.filter(F.col("b").isNull()).select(F.col("a").alias("tile"), "band")
    return made.filter(F.col("b").isNotNull()).select("a", "b"), open_


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets are linked, by intersecting the sorted arrays."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))

    def make():
        def step(cols):
            out_a, out_b = [], []
            for a, b, x, y in zip(cols["a"], cols["b"], cols["of_a"], cols["of_b"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                if linked(common, len(x), len(y), percent):
                    out_a.append(a)
                    out_b.append(b)
            return {"a": out_a, "b": out_b}
        return step

    both = pairs.hint("merge").join(right.hint("merge"), "b").hint("merge").join(left.hint("merge"), "a")
    return map_arrow(both, make, "a long, b long").distinct()


def jaccard_join(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id, set_id for every row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest ``doc_id`` reachable by links of at least
    ``percent`` per cent Jaccard similarity; ``set_id`` the smallest with the
    same set. A text with fewer than ``n`` words is one shingle; a null, empty or
    wordless text has none, is linked with nothing and is its own component.
    Rows that share a ``doc_id`` are one document and share its links. Rows with
    a null ``doc_id`` count as one document after all others; its component is
null if it reaches no other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("node"), "text")
    rank = spark.sparkContext.broadcast(_sketch(texts, n))
    rows = materialize(_signatures(texts, rank, n, percent).withColumn("rid", F.monotonically_increasing_id()),
                       "signatures")
    groups = materialize(rows.filter(F.col("digest").isNotNull()).groupBy("digest")
                         .agg(F.min("node").alias("set_id"), F.count(F.lit(1)).alias("n")), "sets")
    # of equal sets one document, and one row of it however often it is repeated
    heads = (rows.filter(F.col("digest").isNotNull()).groupBy("node", "digest").agg(F.min("rid").alias("rid"))
             .join(groups.select(F.col("set_id").alias("node")).distinct(), "node", "left_semi").select("rid"))
    heads = materialize(heads, "heads")
    tokens = materialize(rows.select("rid", "node", "prefix").hint("merge").join(heads, "rid", "left_semi")
                         .select("node", F.explode("prefix").alias("token")), "tokens")
    slim = materialize(rows.select("rid", "node", "size", "bitmap").hint("merge").join(heads, "rid", "left_semi")
                       .drop("rid"), "bitmaps")
    tiles = _tiles(tokens, slim.select("node", "size"), percent)
    bitmaps = slim.select("node", "bitmap")

    # a document of several texts ties their sets together
    several = materialize(
        rows.groupBy("node").agg(F.min(F.coalesce("digest", F.lit(b""))).alias("lo"),
                                 F.max(F.coalesce("digest", F.lit(b""))).alias("hi"))
        .filter(F.col("lo") != F.col("hi")).select("node"), "several")
    links = materialize(rows.join(several, "node", "left_semi").select("node", "digest").distinct()
                        .join(groups, "digest").select(F.col("node").alias("a"), F.col("set_id").alias("b")), "links")

    labels = materialize(components(links), "labels")
    sets, tested = None, None
    for step in ("near", "heads", "rest"):
        pairs, left_open = _candidates(tiles, bitmaps, labels, percent, block, step)
        if step == "near":  # what a block leaves out, and tiles of several blocks
            left_open = left_open.unionByName(
                tiles.filter(F.col("n") > block).select("tile", "band")).distinct()
            tiles = tiles.hint("merge").join(left_open, ["tile", "band"], "left_semi")
        if tested is not None:
            pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            wanted = pairs.select(F.col("a").alias("node")).unionByName(
                pairs.select(F.col("b").alias("node"))).distinct()
            if sets is not None:
                wanted = wanted.join(sets.select("node"), "node", "left_anti")
            wanted = materialize(wanted, "wanted")
            if not wanted.isEmpty():  # the shingle arrays of classes that have candidates
                more = materialize(_sets(texts, wanted, n), "shingles")
                sets = more if sets is None else sets.unionByName(more)
            found = materialize(_verified(pairs, sets, percent), "found")
            tested = pairs if tested is None else tested.unionByName(pairs)
            if not found.isEmpty():
                links = materialize(links.unionByName(found), "links")
                labels = materialize(components(links), "labels")
        if step == "near":
            tiles = materialize(tiles, "open-tiles")
        if tiles.isEmpty():
            break

    named = (groups.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
             .select("digest", "set_id", F.coalesce("label", "set_id").alias("component"), "n"))
    # sets that many rows share would send them to one task: at most HOT_PARTS of those
    total = rows.count()
    hot = F.broadcast(named.filter(F.col("n") * HOT_PARTS > total).drop("n"))
    calm = named.filter(F.col("n") * HOT_PARTS <= total).drop("n")
    slim = rows.select("node", "size", "digest")
    wordless = (slim.filter(F.col("digest").isNull()).join(labels, "node", "left")
                .select("node", "size", "digest", F.col("node").alias("set_id"),
                        F.coalesce("label", "node").alias("component")))
    full = (slim.join(calm.hint("merge"), "digest").unionByName(slim.join(hot, "digest")).unionByName(wordless))
    named_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return full.select(named_id("node").alias("doc_id"), F.col("size").alias("n_shingles"),
                       named_id("component").alias("component_id"), named_id("set_id").alias("set_id"))


def _sets(texts: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, shingles) of the texts in ``wanted`` and perhaps a few others.

    The wanted ids go out as a bit filter of fixed size, so texts are not moved to
    meet them. As ids outgrow the filter it lets more texts through, which costs
    work but changes nothing: the pairs pick what they need.
    """
    place = F.pmod(F.xxhash64("node"), F.lit(1 << FILTER_BITS))
    words = (wanted.select((place / 64).cast("long").alias("word"), F.pmod(place, F.lit(64)).cast("int").alias("bit"))
             .groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits")).toArrow())
    bits = np.zeros((1 << FILTER_BITS) // 64, np.int64)  # at most that many rows come back
    bits[words["word"].to_numpy()] = words["bits"].to_numpy()
    asked = texts.sparkSession.sparkContext.broadcast(bits)

    def make():
        def step(cols):
            at = np.array(cols["place"], np.int64)
            keep = np.flatnonzero((asked.value[at >> 6] >> (at & 63)) & 1)
            return {"node": [cols["node"][i] for i in keep],
                    "shingles": [shingle_set(cols["text"][i], n).tobytes() for i in keep]}
        return step

    return map_arrow(texts.withColumn("place", place), make, "node long, shingles binary")
