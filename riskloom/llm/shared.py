"""Helpers shared by the training-data operators.

Conventions that hold for every operator of the package:

* Rows that share a ``doc_id`` are one document. A null ``doc_id`` counts as an
  id of its own that comes after all others.
* A null text counts as the empty text.
* Operators read only the columns they name, under internal names, so extra
  columns of the input cannot clash with theirs.
* Intermediate tables are Parquet below the shared folder of
  ``spark.checkpoint.dir``; a lost executor never loses them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.session import scratch_path

# Fixed value of the contracts: ASCII white space.
WS = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def body(col: str | Column = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def word_count(col: Column) -> Column:
    """Number of maximal runs of characters other than ASCII white space."""
    core = F.btrim(F.regexp_replace(col, WS, " "), F.lit(" "))
    return F.when(core == "", F.lit(0)).otherwise(
        F.length(core) - F.length(F.translate(core, " ", "")) + 1).cast("long")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared folder and read it back: cuts the
    lineage, survives executor loss, and is computed once for several readers."""
    spark = df.sparkSession
    path = scratch_path(spark, f"riskloom/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def restrict(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose id is in ``ids`` (column ``key``), all columns, null-safe."""
    wanted = ids.select(F.col(key).alias("_wanted")).distinct()
    return docs.join(wanted, docs[key].eqNullSafe(wanted["_wanted"]), "left_semi")


def map_arrow(df: DataFrame, make: Callable, schema: str, rows_per_step: int = 256) -> DataFrame:
    """Run ``make()`` once per task; it returns a function from a dict of column
    lists to a dict of column lists. Batches are handed over in small steps, so
    the memory of a task is bounded by a few hundred texts."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark_schema = StructType.fromDDL(schema)

    def run(batches):
        arrow_schema = to_arrow_schema(spark_schema)
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_step):
                out = step(batch.slice(at, rows_per_step).to_pydict())
                yield pa.RecordBatch.from_pydict(out, schema=arrow_schema)

    return df.mapInArrow(run, schema=spark_schema)


def filter_arrow(df: DataFrame, make: Callable, column: str = "text", rows_per_step: int = 256) -> DataFrame:
    """Rows of ``df`` for which ``make()(values)`` says True, all columns as they are.
    ``make`` runs once per task; no row is moved."""
    def run(batches):
        keep = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_step):
                part = batch.slice(at, rows_per_step)
                yield part.filter(pa.array(keep(part.column(column).to_pylist()), pa.bool_()))

    return df.mapInArrow(run, schema=df.schema)


def fold(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3


def sample_ids(rows: DataFrame, stratum: str, size: int, seed: int = 7) -> DataFrame:
    """At most ``size`` ids per value of ``stratum``: the id with the least seeded
    hash in each of ``size`` hash buckets. A partial aggregate, so no stratum is
    gathered or sorted, and the choice does not depend on partitioning."""
    h = F.xxhash64("doc_id", F.lit(seed))
    return (rows.groupBy(F.col(stratum).alias("stratum"), F.pmod(h, F.lit(size)).alias("bucket"))
            .agg(F.min(F.struct(h.alias("h"), F.col("doc_id").alias("doc_id"))).alias("least"))
            .select("stratum", F.col("least.doc_id").alias("doc_id")))
