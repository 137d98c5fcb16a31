"""Scans and sinks (IO1-IO4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import INPUTS, StudyInputs

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one driver table; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str,
             header: bool = True) -> DataFrame:
    """CSV scan with a header and a declared schema (IO1); no inference pass."""
    return (spark.read.schema(schema).option("header", header)
            .option("mode", "FAILFAST").csv(path))


def read_input(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One of the study's raw inputs by logical name, schema from ``schemas``."""
    return read_csv(spark, path, INPUTS[name])


def read_study(spark: SparkSession, folder: str) -> StudyInputs:
    """All raw inputs from ``<folder>/<name>.csv``, one file or folder each."""
    return StudyInputs(**{name: read_input(spark, f"{folder.rstrip('/')}/{name}.csv", name) for name in INPUTS})


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Sink without a row index (IO2). Parquet by default, CSV with a header on request."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.option("header", True).csv(path)
    else:
        w.format(fmt).save(path)


def preview(df: DataFrame, n: int = 5, order_by: list[str] | None = None) -> DataFrame:
    """First rows (IO3). With an order it is a TakeOrdered, otherwise any n rows."""
    if order_by:
        df = df.orderBy(*order_by)
    return df.limit(n)
