"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters may occur with up to k = m * ``ERROR_RATE`` edits. It is
cut into k + 1 pieces; k edits cannot touch all of them, so every occurrence
holds at least one piece unchanged. One Aho-Corasick pass over a text finds all
pieces of all items; around each hit, Myers' bit-parallel algorithm gives the
least edit distance between the item and a passage of the text. An item of fewer
than ``MIN_CHARS`` characters is one piece, which must stand in the text as it is and
between word boundaries: with edits or inside words it would be found by chance.

Items are the query set and texts the data: items go out in blocks of bounded
size, each block is one pass over the texts, and no text is ever moved.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import filter_arrow, map_arrow

ERROR_RATE = 0.08
MIN_CHARS = 16           # shorter items are matched exactly
BLOCK_BYTES = 4 << 20


def normal(text: str | None) -> str:
    """Lower case, white space runs as one space, trimmed."""
    return " ".join((text or "").lower().split())


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, piece): k + 1 pieces of nearly equal length that cover the item."""
    cut = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


def least_distance(item: str, masks: dict[str, int], text: str) -> int:
    """Least edit distance between ``item`` and any passage of ``text`` (Myers)."""
    m = len(item)
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x_v = eq | minus
        x_h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(x_h | plus))
        down = plus & x_h
        if up & high:
            score += 1
        elif down & high:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & full
        down = (down << 1) & full
        plus = down | (full & ~(x_v | up))
        minus = up & x_v
    return best


def char_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def _runs_on(a: str, b: str) -> bool:
    """Whether two neighbouring characters belong to one word. Scripts from U+2E80 on
    write no spaces, so any place in them is a boundary."""
    return a.isalnum() and b.isalnum() and a < "\u2e80" and b < "\u2e80"


class Matcher:
    """One block of items: the automaton of their pieces and their bit masks."""

    def __init__(self, items: list[tuple[int, str]], rate: float, min_chars: int = MIN_CHARS) -> None:
        self.items = []
        self.min_chars = min_chars
        words: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            k = math.floor(len(text) * rate) if len(text) >= min_chars else 0
            self.items.append((item_id, text, k, char_masks(text)))
            for offset, piece in pieces(text, k):
                words.setdefault(piece, []).append((len(self.items) - 1, offset))
        self.auto = ahocorasick.Automaton()
        for piece, places in words.items():
            self.auto.add_word(piece, (len(piece), tuple(places)))
        self.auto.make_automaton()

    def match(self, text: str) -> list[tuple[int, int]]:
        """(item id, least distance) of the items that occur in a whole text."""
        spans: dict[int, list[tuple[int, int]]] = {}
        if not self.items:
            return []
        for end, (size, places) in self.auto.iter(text):
            for which, offset in places:
                _, item, k, _ = self.items[which]
                if len(item) < self.min_chars and (
                        (end >= size and _runs_on(text[end - size], item[0]))
                        or (end + 1 < len(text) and _runs_on(item[-1], text[end + 1]))):
                    continue
                s = max(0, end + 1 - size - offset - k)
                e = end + 1 - size - offset + len(item) + k
                own = spans.setdefault(which, [])
                if own and s <= own[-1][1] and s >= own[-1][0]:
                    own[-1] = (own[-1][0], max(e, own[-1][1]))
                else:
                    own.append((s, e))
        out = []
        for which, own in spans.items():
            item_id, item, k, masks = self.items[which]
            best = k + 1
            for s, e in own:
                best = min(best, least_distance(item, masks, text[s:e]))
                if best == 0:
                    break
            if best <= k:
                out.append((item_id, best))
        return out


_matchers: dict[str, Matcher] = {}


def _matcher(items: list[tuple[int, str]], rate: float, min_chars: int) -> Matcher:
    """The automaton of a block, built once per Python worker."""
    key = hashlib.md5(repr((items, rate, min_chars)).encode()).hexdigest()
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(items, rate, min_chars)
    return _matchers[key]


def _blocks(benchmark: DataFrame, block_bytes: int):
    """Broadcasts of about ``block_bytes`` of normalised items each."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").filter(
        F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, math.ceil(size / block_bytes))
    for block in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(
            sorted((r["item_id"] if r["item_id"] is not None else -1, t) for r in rows
                   if (t := normal(r["text"]))))


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
            block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, distance) for every document that holds an item of
    ``benchmark(item_id, text)`` within ``rate`` edits per character of the item.

    Items shorter than ``min_chars`` (normalised) are found exactly and between word
    boundaries alone. Null and empty items match nothing; equal items each give their row; a null ``item_id`` shows as -1. Null or
    empty texts hold nothing. Repeated rows of a document give one row per item,
    with the least distance. Empty tables give no rows.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = []
    for sent in _blocks(benchmark, block_bytes):
        def make(sent=sent):
            def step(cols):
                found = []
                if sent.value:
                    matcher = _matcher(sent.value, rate, min_chars)
                    found = [(d, i, n) for d, t in zip(cols["doc_id"], cols["text"]) if t
                             for i, n in matcher.match(normal(t))]
                return {"doc_id": [f[0] for f in found], "item_id": [f[1] for f in found],
                        "distance": [f[2] for f in found]}
            return step

        parts.append(map_arrow(texts, make, "doc_id long, item_id long, distance long"))
    return (reduce(DataFrame.unionByName, parts).groupBy("doc_id", "item_id")
            .agg(F.min("distance").alias("distance")))


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, min_chars: int = MIN_CHARS,
          block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text holds no item, all columns; rules as in ``matches``."""
    for sent in _blocks(benchmark, block_bytes):
        def make(sent=sent):
            def keep(texts):
                if not sent.value:
                    return [True] * len(texts)
                matcher = _matcher(sent.value, rate, min_chars)
                return [not t or not matcher.match(normal(t)) for t in texts]
            return keep

        docs = filter_arrow(docs, make)
    return docs
