"""Exact dedup over a persistent digest index (DataFrame functions only).

The index is a table bucketed and sorted by the digest. A batch is absorbed in
three steps: group the batch by digest, keep the digests that a sort-merge
anti-join does not find in the index, append those to the index. The index side
of both joins is read in bucket order, so it is never shuffled again.

A digest that many rows share is one row of the index. Attaching it to its rows
would send them all to one task, so the digests that hold over 1/``HOT_PARTS``
of the batch go by broadcast: there can be at most ``HOT_PARTS`` of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.shared import WS, body, materialize
from riskloom.session import scratch_path

HOT_PARTS = 2000


class DigestIndex:
    """A bucketed table (digest binary, keep_id bigint), appended to by ``absorb``.

    ``name`` is a table of the session's catalog, ``path`` its place in a store
    that all executors share. ``buckets`` is fixed when the table is made.
    """

    def __init__(self, spark: SparkSession, name: str, path: str, buckets: int) -> None:
        self.spark, self.name, self.path, self.buckets = spark, name, path, buckets

    def create(self) -> DigestIndex:
        """Make the table, without rows, if it is not there."""
        if not self.spark.catalog.tableExists(self.name):
            self.append(self.spark.range(0).select(F.unhex(F.lit("")).alias("digest"), F.col("id").alias("keep_id")))
        return self

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        (rows.select("digest", "keep_id")
         .repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .write.format("parquet").mode("append").option("path", self.path)
         .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def digest(text_col: str = "text"):
    """SHA-256 (32 bytes) of the UTF-8 text after white-space runs became one space."""
    return F.unhex(F.sha2(F.regexp_replace(body(text_col), WS, " ").cast("binary"), 256))


def absorb(index: DigestIndex, docs: DataFrame, hot_parts: int = HOT_PARTS) -> DataFrame:
    """Deduplicate ``docs(doc_id, text)`` against the index and itself; append what is new.

    Returns one row per input row: doc_id, keep_id, group_size (rows of this
    batch with that text), kept, text_sha256. ``keep_id`` is the id the index
    already holds for the text, or else the smallest ``doc_id`` of the batch.

    Null or empty text: all such rows are one group. Repeated rows of the kept
    ``doc_id`` are the same document and all count as kept. A null ``doc_id``
    stays only if no row of its text has an id. An empty batch leaves the index
    as it is and returns no rows.
    """
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest")),
                       "digests")
    groups = materialize(rows.groupBy("digest").agg(F.min("doc_id").alias("least"),
                                                    F.count(F.lit(1)).alias("group_size")), "groups")
    new = groups.join(index.create().read().hint("merge"), "digest", "left_anti")
    index.append(new.select("digest", F.col("least").alias("keep_id")))

    held = index.read().withColumnRenamed("digest", "held_digest")
    total = rows.count()
    hot = groups.filter(F.col("group_size") * hot_parts > total)  # at most hot_parts rows
    hot_kept = hot.join(held.hint("merge"), F.col("digest") == F.col("held_digest")).drop("held_digest")
    calm = rows.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    calm_groups = groups.filter(F.col("group_size") * hot_parts <= total)
    calm_kept = calm_groups.hint("merge").join(held.hint("merge"), F.col("digest") == F.col("held_digest")).drop(
        "held_digest")
    joined = calm.hint("merge").join(calm_kept, "digest").unionByName(
        rows.join(F.broadcast(hot_kept), "digest"))
    return joined.select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def fresh_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """A new, empty index below the shared folder."""
    tag = uuid.uuid4().hex
    return DigestIndex(spark, f"digest_index_{tag}", scratch_path(spark, f"riskloom/index-{tag}"),
                       buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))).create()


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""
