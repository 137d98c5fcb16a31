"""Dedup of lines across documents (DataFrame functions only).

Lines are exploded and keyed by a 128-bit hash of their normalised form. Lines
of one key and document are pre-aggregated to one row with their positions, so
a line that sits in a third of all documents is spread over (key, document)
before it is counted, and the count per key is a partial aggregate. The join
that brings the verdict back is salted for the keys that many documents hold.
Text is moved once, to meet the positions its document loses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.shared import ascii_lower, body, materialize

MIN_CHARS = 10
MIN_DOCS = 2
HOT_PARTS = 2000
ASCII_SPACE = " \t\n\x0b\f\r"


def line_key(line):
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _repeated(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, row_key, positions) of the lines each document loses."""
    lines = docs.select("doc_id", "row_key", F.posexplode("lines").alias("pos", "line"))
    lines = lines.withColumn("k", line_key(F.col("line"))).filter(F.length("k") >= min_chars)
    held = lines.select("doc_id", "row_key", "pos", F.unhex(F.md5(F.col("k").cast("binary"))).alias("h"))
    held = materialize(held.groupBy("h", "doc_id", "row_key").agg(F.collect_list("pos").alias("positions")),
                       "line-keys")
    # rows that share a doc_id are one document, hence the inner distinct
    keys = (held.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"),
                                  F.max("doc_id").alias("last_id"),
                                  F.max(F.col("doc_id").isNull()).alias("unnamed"))
            .filter(F.col("n") >= min_docs))
    if min_docs > 2:
        exact = (held.select("h", "doc_id").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("docs"))
                 .filter(F.col("docs") >= min_docs).select("h"))
        keys = keys.join(exact, "h", "left_semi")
    else:
        keys = keys.filter((F.col("first_id") != F.col("last_id"))
                           | (F.col("unnamed") & F.col("first_id").isNotNull()))
    keys = materialize(keys.select("h", "n", "first_id"), "repeated-keys")
    # a key that holds over 1/HOT_PARTS of all (key, document) rows: at most HOT_PARTS of them
    total = held.count()
    hot = F.broadcast(keys.filter(F.col("n") * HOT_PARTS > total).select("h", "first_id"))
    calm = keys.filter(F.col("n") * HOT_PARTS <= total).select("h", "first_id")
    found = held.join(calm.hint("merge"), "h").unionByName(held.join(hot, "h"))
    return (found.filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
            .groupBy("doc_id", "row_key").agg(F.array_distinct(F.flatten(F.collect_list("positions"))).alias("dropped")))


def _judged(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """Every row of ``docs`` as the struct ``row``, with n_lines, n_dropped and the kept text."""
    base = docs.select(F.col("doc_id").alias("doc_id"), F.xxhash64(body()).alias("row_key"),
                       F.split(body(), "\n").alias("lines"), F.col("text").isNull().alias("no_text"),
                       F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    dropped = _repeated(base.select("doc_id", "row_key", "lines"), min_chars, min_docs)
    dropped = dropped.select(F.col("doc_id").alias("d_id"), F.col("row_key").alias("d_key"), "dropped")
    joined = base.join(dropped, F.col("doc_id").eqNullSafe(F.col("d_id"))
                       & (F.col("row_key") == F.col("d_key")), "left")
    # array_except hashes, so this is linear in the lines; `lines` is a column of
    # the join, so the lambda indexes an array that exists instead of splitting again
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    kept = F.when(F.col("dropped").isNull(), F.col("lines")).otherwise(
        F.transform(stay, lambda i: F.get(F.col("lines"), i)))
    return joined.select(
        "row", "no_text", F.array_join(kept, "\n").alias("kept"), F.size("lines").cast("long").alias("n_lines"),
        F.when(F.col("dropped").isNull(), F.lit(0)).otherwise(F.size("dropped")).cast("long").alias("n_dropped"))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop repeated lines of ``docs(doc_id, text, ...)``; the smallest ``doc_id`` keeps them.

    Returns the columns of ``docs`` with the kept lines as ``text``, and the
    number of code points as ``n_chars`` if that column exists. A row that
    loses nothing keeps its text as it is, null included.

    A null or empty text is one empty line. A document that loses every line
    has the empty text. Rows that share a ``doc_id`` are one document: a line
    in several of them is not repeated by that, and equal rows get equal
    results. A null ``doc_id`` counts as one document after all others. An
    empty table gives no rows. Keys shorter than ``min_chars`` always stay.
    """
    found = _judged(docs, min_chars, min_docs)
    out = []
    for c in docs.columns:
        if c == "text":
            out.append(F.when((F.col("n_dropped") > 0) | ~F.col("no_text"), F.col("kept")).alias("text"))
        elif c == "n_chars":
            out.append(F.when(F.col("n_dropped") > 0, F.length("kept").cast(docs.schema["n_chars"].dataType))
                       .otherwise(F.col("row.n_chars")).alias("n_chars"))
        else:
            out.append(F.col(f"row.`{c}`").alias(c))
    return found.select(*out)


def line_report(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 of every row; rules as in ``line_dedup``."""
    found = _judged(docs.select("doc_id", "text"), min_chars, min_docs)
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped",
                        F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
k AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
g AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (
  SELECT k.doc_id, k.pos, k.line, g.first_id IS NOT NULL AND g.first_id <> k.doc_id AS dropped
  FROM k LEFT JOIN g ON g.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
