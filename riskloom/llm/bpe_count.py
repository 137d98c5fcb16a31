"""Token counts by byte-pair merging, without making token ids.

Each pre-token starts as a linked list of byte symbols. A heap holds the
adjacent pairs that the vocabulary merges, by rank and then position; the
lowest is popped again and again, stale entries are skipped. The count of a
pre-token is its bytes minus its merges. Equal pre-tokens of a task are merged
once. A pre-token of n bytes costs n log n, so a text without any break (one
"word" of megabytes) does not degrade to quadratic time.

The vocabulary file is read where the query is built and sent as a broadcast;
its size does not depend on the data.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import map_arrow

# Fixed value: the split pattern of a byte-level pre-tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_CHARS = 64       # longer pre-tokens hardly repeat
CACHE_ENTRIES = 300_000
LIMIT = 1024


def byte_symbols() -> list[str]:
    """The character that stands for each byte: printable Latin-1 bytes for
    themselves, the others for the code points from 256 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in shown else next(spare)) for b in range(256)]


class MergeTable:
    """Ranks of the pairs of a byte-level BPE vocabulary file (.json)."""

    def __init__(self, spec: str) -> None:
        doc = json.loads(spec)
        pre = doc["pre_tokenizer"]
        if doc["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level vocabularies without a normalizer are counted")
        vocab = doc["model"]["vocab"]
        self.first = [vocab[s] for s in byte_symbols()]
        self.rank: dict[tuple[int, int], int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(x.split(" ") if isinstance(x, str) else x for x in doc["model"]["merges"]):
            self.rank[vocab[a], vocab[b]] = rank
            self.made.append(vocab[a + b])
        added = doc.get("added_tokens") or []
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("added tokens that take in their surroundings are not counted")
        words = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, words))) if words else None
        self.pattern = regex.compile(PATTERN)
        self.cache: dict[str, int] = {}

    def pieces(self, piece: bytes) -> int:
        """Symbols left of one pre-token when no pair of it can be merged."""
        symbol: list[int] = [self.first[b] for b in piece]
        n = len(symbol)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p], i) for i, p in enumerate(zip(symbol, symbol[1:])) if p in self.rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbol[i] < 0 or self.rank.get((symbol[i], symbol[j])) != rank:
                continue  # one of the two was merged away meanwhile
            symbol[i], symbol[j] = self.made[rank], -1
            after[i] = k = after[j]
            merges += 1
            if k < n:
                before[k] = i
                if (r := self.rank.get((symbol[i], symbol[k]))) is not None:
                    heapq.heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := self.rank.get((symbol[h], symbol[i]))) is not None:
                heapq.heappush(heap, (r, h))
        return n - merges

    def count(self, text: str) -> int:
        """Tokens of a text; strings of added tokens inside it count one each."""
        if not text:
            return 0
        total = 0
        parts = [text]
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            total = len(parts) - 1
        for part in parts:
            for piece, times in Counter(m[0] for m in self.pattern.finditer(part)).items() \
                    if len(part) > 1_000_000 else Counter(self.pattern.findall(part)).items():
                known = self.cache.get(piece)
                if known is None:
                    known = self.pieces(piece.encode())
                    if len(piece) <= CACHED_CHARS:
                        if len(self.cache) >= CACHE_ENTRIES:
                            self.cache.clear()
                        self.cache[piece] = known
                total += known * times
        return total


_tables: dict[int, MergeTable] = {}


def _table(spec: str) -> MergeTable:
    """The parsed vocabulary, once per Python worker."""
    key = hash(spec)
    if key not in _tables:
        _tables.clear()
        _tables[key] = MergeTable(spec)
    return _tables[key]


def token_counts(docs: DataFrame, vocab_path: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs(doc_id, text)``.

    A null or empty text has 0 bytes and 0 tokens. Repeated rows give repeated
    results, a null ``doc_id`` stays null, an empty table gives no rows.
    ``vocab_path`` is read on the driver.
    """
    with open(vocab_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def make():
        merges = _table(spec.value)

        def step(cols):
            texts = [t or "" for t in cols["text"]]
            counts = [merges.count(t) for t in texts]
            return {"doc_id": cols["doc_id"], "n_bytes": [len(t.encode()) for t in texts],
                    "n_tokens": counts, "over_limit": [c > limit for c in counts]}
        return step

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make,
                     "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
