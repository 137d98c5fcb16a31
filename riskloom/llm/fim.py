"""Fill-in-middle transformation with a Fenwick tree over fixed text blocks.

A unit is a word with the ASCII white space before it, or white space that ends
the text. The UTF-8 bytes of a text are cut into blocks of fixed length. A
Fenwick tree over the blocks stores how many units end in each and how many code
points start in each. A cut after the k-th unit is found by binary lifting down
the tree, which names the block, and by a look at that block alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import body, map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE = 50           # per cent of the documents that are transformed
SPM_RATE = 80       # per cent of those that take the suffix first
BLOCK = 4096        # bytes

_SPACE = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])


class Fenwick:
    """Prefix sums over positions 0..n-1 of several counts at once."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = len(counts)
        self.tree = np.zeros((self.n + 1, counts.shape[1]), np.int64)
        self.tree[1:] = counts
        for i in range(1, self.n + 1):
            up = i + (i & -i)
            if up <= self.n:
                self.tree[up] += self.tree[i]

    def descend(self, k: int, column: int) -> tuple[int, np.ndarray]:
        """The position that holds the k-th unit (from 1) of ``column``, and the
        sums of all columns before it. Binary lifting: the longest prefix whose
        sum is still below k."""
        at, before = 0, np.zeros(self.tree.shape[1], np.int64)
        step = 1 << (self.n.bit_length() - 1) if self.n else 0
        while step:
            if at + step <= self.n and before[column] + self.tree[at + step][column] < k:
                at += step
                before = before + self.tree[at]
            step >>= 1
        return at, before


class Units:
    """The units of one text, by block."""

    def __init__(self, data: bytes, block: int = BLOCK) -> None:
        self.data, self.block = data, block
        self.bytes = np.frombuffer(data, np.uint8)
        n_blocks = -(-len(data) // block)
        counts = np.zeros((n_blocks, 2), np.int64)
        for i in range(n_blocks):
            counts[i] = len(self._ends(i)), self._starts(i).sum()
        self.n, self.n_chars = (int(x) for x in counts.sum(axis=0))
        self.tree = Fenwick(counts)

    def _ends(self, i: int) -> np.ndarray:
        """Offsets in block ``i`` of the last byte of each unit: the last byte of a
        word, or of the text."""
        part = self.bytes[i * self.block:(i + 1) * self.block + 1]
        space = _SPACE[part]
        if len(part) <= self.block:  # the text ends here
            return np.flatnonzero(np.concatenate([~space[:-1] & space[1:], [True]]))
        return np.flatnonzero(~space[:-1] & space[1:])

    def _starts(self, i: int) -> np.ndarray:
        """Which bytes of block ``i`` start a code point."""
        return (self.bytes[i * self.block:(i + 1) * self.block] & 0xC0) != 0x80

    def cut(self, k: int) -> tuple[int, int]:
        """(bytes, code points) of the first ``k`` units."""
        if k <= 0:
            return 0, 0
        at, before = self.tree.descend(k, 0)
        end = int(self._ends(at)[k - before[0] - 1]) + 1
        return at * self.block + end, int(before[1] + self._starts(at)[:end].sum())


def draws(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four unsigned integers that decide about a document."""
    name = "null" if doc_id is None else str(doc_id)
    hexed = hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()
    return [int(hexed[i:i + 8], 16) for i in range(0, 32, 8)]


def cut_text(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE,
             block: int = BLOCK) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    data = text.encode()
    units = Units(data, block)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not data or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= rate:
        return units.n, "plain", None, None, text
    first, last = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    (a, a_chars), (b, b_chars) = units.cut(first), units.cut(last)
    prefix, middle, suffix = (part.decode() for part in (data[:a], data[a:b], data[b:]))
    if h4 % 100 < spm_rate:
        form, out = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, out = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return units.n, form, a_chars, b_chars - a_chars, out


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output for every row of ``docs(doc_id, text)``.

    A null or empty text has no units and stays as it is (form plain, output
    empty); so does a text that holds a mark. White space alone is one unit. A null
    ``doc_id`` draws as the word "null". Rows that share a ``doc_id`` are cut each by
    its own text with the same draws, so equal rows have equal results. Long texts
    need their own length and a few numbers a block. An empty table gives no rows;
    other columns are not read.
    """
    def make():
        def step(cols):
            rows = [cut_text(i, t, seed, rate, spm_rate) for i, t in zip(cols["doc_id"], cols["text"])]
            names = ("n", "form", "prefix_chars", "middle_chars", "output")
            return {"doc_id": cols["doc_id"], **{c: [r[k] for r in rows] for k, c in enumerate(names)}}
        return step

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text")), make, schema,
                     rows_per_step=64)


def _after(col: Column, mark: str) -> Column:
    """What follows the first ``mark``."""
    return F.substr(col, F.instr(col, F.lit(mark)) + F.lit(len(mark)))


def restored(output: Column, form: Column) -> Column:
    """The text from its transformed form. Marks never overlap and no part holds
    one, so each first occurrence is the one that was put there."""
    before = lambda col, mark: F.substring_index(col, mark, 1)
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    middle = _after(output, MIDDLE)
    psm = F.concat(before(rest, SUFFIX), middle, before(_after(rest, SUFFIX), MIDDLE))
    spm = F.concat(before(_after(rest, PREFIX), MIDDLE), middle, before(rest, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """Digests of the transformed and of the restored texts, one row per row of ``docs``."""
    digest = lambda col: F.sha2(col.cast("binary"), 256)
    return transform(docs).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def sql(marks: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> str:
    """The same over the whole table in DuckDB's SQL."""
    p, s, m = marks
    h = [f"('0x' || substr(hx, {8 * i + 1}, 8))::BIGINT" for i in range(4)]
    return rf"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')) AS hx,
         regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
cuts AS (
  SELECT *, len(u) AS n, {h[0]} % (len(u) + 1) AS c1, {h[1]} % (len(u) + 1) AS c2,
         CASE WHEN t = '' OR contains(t, '{p}') OR contains(t, '{s}') OR contains(t, '{m}')
                   OR {h[2]} % 100 >= {RATE} THEN 'plain'
              WHEN {h[3]} % 100 < {SPM_RATE} THEN 'spm' ELSE 'psm' END AS form
  FROM units),
parts AS (
  SELECT *, array_to_string(u[1:least(c1, c2)], '') AS pre,
         array_to_string(u[least(c1, c2) + 1:greatest(c1, c2)], '') AS mid,
         array_to_string(u[greatest(c1, c2) + 1:], '') AS suf
  FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || pre || '{s}' || suf || '{m}' || mid
                        ELSE '{s}' || suf || '{p}' || pre || '{m}' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""


SQL = sql()
