"""Default labels, first default per firm, sector filter and sector table.

Operators: PR7 PR13 SC8 WN3 ST1 ST2 AG3 JN10.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import least_skip_null

# Regulated GICS sectors left out of the study (financials,
# utilities, real estate).
REGULATED_SECTORS = (40, 55, 60)

# GICS sector codes and names.
SECTOR_NAMES = [
    (10, "Energy"), (15, "Materials"), (20, "Industrials"),
    (25, "Consumer Discretionary"), (30, "Consumer Staples"), (35, "Health Care"),
    (40, "Financials"), (45, "Information Technology"), (50, "Communication Services"),
    (55, "Utilities"), (60, "Real Estate"),
]


def label_defaults(df: DataFrame, rating_date: str = "rating_date",
                   delist_date: str = "delist_date") -> DataFrame:
    """``default`` = 1 if either event matched, ``default_date`` = the earlier one (PR13, SC8)."""
    r, d = F.col(rating_date), F.col(delist_date)
    return (df.withColumn("default", F.when(r.isNotNull() | d.isNotNull(), 1).otherwise(0))
            .withColumn("default_date", least_skip_null(r, d)))


def keep_first_default(df: DataFrame, key: str = "gvkey",
                       order: Sequence[str] = ("datadate", "fyear")) -> DataFrame:
    """Non-default rows plus each firm's first default row (WN3 + ST2).

    Equals the union of ``default == 0`` rows with the first ``default == 1``
    row per firm; later non-default rows of a defaulted firm stay. A firm has
    at most one row per fiscal year, so the window over a firm is bounded, and
    it reuses the partitioning of the lags instead of reading the panel twice.
    ``order`` must be unique within a firm (it is for a firm-year panel).
    """
    place = F.struct(*order)
    first = F.min(F.when(F.col("default") == 1, place)).over(Window.partitionBy(key))
    return (df.withColumn("_first", first)
            .where((F.col("default") == 0) | (place == F.col("_first")))
            .drop("_first"))


def drop_sectors(df: DataFrame, sectors: Sequence[int] = REGULATED_SECTORS,
                 col: str = "gsector") -> DataFrame:
    """Drop rows in ``sectors``; a missing sector is kept (PR7)."""
    c = F.col(col)
    return df.where(c.isNull() | ~c.isin(*sectors))


def sector_names(spark: SparkSession) -> DataFrame:
    schema = T.StructType([T.StructField("gsector", T.IntegerType()),
                           T.StructField("sector", T.StringType())])
    return spark.createDataFrame(SECTOR_NAMES, schema)


def sector_table(df: DataFrame, key: str = "gvkey", col: str = "gsector",
                 order: Sequence[str] = ("datadate", "fyear")) -> DataFrame:
    """Per sector: defaults, firms (counted under each firm's first row), observations (AG3, JN10).

    Rows with no sector are left out, as a group-by on a missing key does.
    The firm count takes each firm's sector at its first row with ``min_by``,
    a partial aggregate. Sector names come from a fixed 11-row table.
    """
    d = df.where(F.col(col).isNotNull())
    obs = d.groupBy(col).agg(F.sum("default").cast("long").alias("defaults"),
                             F.count(F.lit(1)).alias("observations"))
    first = (df.groupBy(key).agg(F.min_by(col, F.struct(*order)).alias(col))
             .where(F.col(col).isNotNull())
             .groupBy(col).agg(F.count(F.lit(1)).alias("companies")))
    names = F.broadcast(sector_names(df.sparkSession))
    return (obs.join(first, col, "left").join(names, col, "left")
            .select(col, "sector", "defaults",
                    F.coalesce("companies", F.lit(0)).alias("companies"), "observations"))
