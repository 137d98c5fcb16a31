"""Study-shaped inputs derived from the driver's star-schema tables.

The study's inputs are licensed files; the engine is exercised on tables that
Spark derives from the given parquet tables, so every query's work grows
with them. Mapping (firm = customer, fiscal year = order year):

* ``financials``: one row per (customer, order year); balance-sheet roles are
  sums over the firm's orders and line items, summed in integer cents so any
  engine gets bit-identical doubles. ``rect`` and ``emp`` are NULL on a stated
  rule (no open orders, no kept items) to create missing cells.
* ``gdp``: yearly growth of total order value (first year NULL).
* ``delist``: returned, deeply discounted, low-tax line items, keyed by customer.
* ``link``: partial-status orders as identifier intervals, customer -> firm.
* ``rating``: line items with discount >= 8%; ``D`` for returned, 10%-discount,
  high-tax items.
* ``loans``/``deal_link``: line items as facilities, orders as the facility map.
* ``quotes``: line items as rate quotes for their order.
* ``scores``: firm-years with five rule-based (pred, pd) pairs.

Each derivation has a twin in :mod:`riskloom.plans.oracle` written in SQL.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.io import read_table
from ..sources.schemas import StudyInputs

# GICS sector per nation key modulo 12 (11 sectors, then missing).
SECTOR_BY_MOD12 = [10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, None]
MODEL_SEEDS = {"lr": 0, "lasso": 1, "svm": 2, "rf": 3, "gb": 4}


def _cents(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def _pct(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("long")


def yyyymmdd(c: Column) -> Column:
    return F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)


def items_per_order(li: DataFrame) -> DataFrame:
    """Line items pre-aggregated per order (map-side combine, then one shuffle)."""
    cents = _cents("l_extendedprice")
    return li.groupBy("l_orderkey").agg(
        F.sum(cents).alias("rev_c"),
        F.sum(cents * _pct("l_discount")).alias("disc_c"),
        F.sum(cents * _pct("l_tax")).alias("tax_c"),
        F.sum(F.col("l_quantity").cast("long")).alias("qty"),
        F.count(F.lit(1)).alias("n_items"),
        F.sum(F.when(F.col("l_returnflag") != "R", 1).otherwise(0)).cast("long").alias("n_keep"))


def firm_years(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    items = items_per_order(read_table(spark, sf, "lineitem"))
    tot = _cents("o_totalprice")
    st = F.col("o_orderstatus")
    j = o.join(items, o.o_orderkey == items.l_orderkey, "left")
    z = F.lit(0).cast("long")
    return j.groupBy(F.col("o_custkey").alias("gvkey"),
                     F.year("o_orderdate").alias("fyear")).agg(
        F.max(F.col("o_orderdate").cast("date")).alias("datadate"),
        F.sum(tot).alias("tot_c"),
        F.sum(F.when(st == "F", tot).otherwise(z)).alias("totF_c"),
        F.sum(F.when(st == "O", tot).otherwise(z)).alias("totO_c"),
        F.sum(F.when(st == "P", tot).otherwise(z)).alias("totP_c"),
        *[F.sum(F.coalesce(F.col(c), z)).alias(c)
          for c in ("rev_c", "disc_c", "tax_c", "qty", "n_items", "n_keep")])


def sector_of(nationkey: Column) -> Column:
    m = nationkey % 12
    expr = None
    for i, code in enumerate(SECTOR_BY_MOD12):
        if code is None:
            continue
        expr = (F.when(m == i, F.lit(code)) if expr is None else expr.when(m == i, F.lit(code)))
    return expr.cast("int")


def financials(spark: SparkSession, sf: str) -> DataFrame:
    """Raw-format financial statements (``datadate`` as yyyymmdd int)."""
    fy = firm_years(spark, sf)
    cust = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("gvkey"), sector_of(F.col("c_nationkey")).alias("gsector"))
    c = F.col
    k5, k7 = 1e5, 1e7
    return fy.join(cust, "gvkey", "left").select(
        "gvkey", yyyymmdd(c("datadate")).alias("datadate"), "fyear", "gsector",
        ((c("rev_c") * 5 - c("disc_c")) / k7).alias("ni"),
        ((c("totF_c") - c("totO_c")) / k5).alias("ceq"),
        (F.nullif(c("totO_c"), F.lit(0)) / k5).alias("rect"),
        (c("tot_c") / k5).alias("at"),
        (c("rev_c") / k5).alias("sale"),
        F.nullif(c("n_keep"), F.lit(0)).cast("double").alias("emp"),
        ((c("totF_c") - c("totO_c")) / k5).alias("wcap"),
        (c("totF_c") / k5).alias("act"),
        ((c("rev_c") * 10 - c("disc_c")) / k7).alias("ibc"),
        (c("tax_c") / k7).alias("dp"),
        (c("totP_c") / k5).alias("dltt"),
        (c("totO_c") / k5).alias("dlc"),
        (c("disc_c") / k7).alias("ch"),
        ((c("rev_c") - c("totF_c")) / k5).alias("oancf"),
        (-c("tax_c") / k7).alias("ivncf"),
        ((c("disc_c") - c("tax_c")) / k7).alias("fincf"),
        ((c("totF_c") - c("totP_c")) / k5).alias("re"),
        ((c("rev_c") * 20 - c("disc_c")) / k7).alias("ebitda"),
        (c("tax_c") / k7).alias("pstkc"),
        (c("qty") / 100.0).alias("csho"),
        ((c("totO_c") + c("totP_c")) / k5).alias("lt"),
        (c("disc_c") / k7).alias("che"),
    )


def gdp(spark: SparkSession, sf: str) -> DataFrame:
    """Yearly growth of total order value; one row per year (a small, bounded table)."""
    y = (read_table(spark, sf, "orders")
         .groupBy(F.year("o_orderdate").alias("year")).agg(F.sum(_cents("o_totalprice")).alias("v")))
    # one row per year, so an unpartitioned window is small
    by_year = Window.orderBy("year")
    last = F.when(F.lag("year").over(by_year) == F.col("year") - 1, F.lag("v").over(by_year))
    return y.withColumn("pv", last).select(
        F.col("year").cast("int").alias("year"),
        ((F.col("v") - F.col("pv")).cast("double") / F.col("pv").cast("double")).alias("gdp_growth"))


def discounted_items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with a discount of 8 % or more and their customer: delistings and
    ratings are both drawn from them."""
    li = read_table(spark, sf, "lineitem").where(F.col("l_discount") >= 0.075).select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_discount", "l_tax", "l_shipdate")
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, li.l_orderkey == o.o_orderkey).drop("l_orderkey", "o_orderkey")


def delist(items: DataFrame) -> DataFrame:
    """Raw delistings (PERMNO = customer, date yyyymmdd, code by part key)."""
    j = items.where(
        (F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.085) & (F.col("l_tax") <= 0.015))
    m = F.col("l_partkey") % 10
    code = (F.when(m == 0, 560).when(m == 1, 572).when(m == 2, 574).when(m == 3, 520)
            .when(m == 4, 600).otherwise((F.col("l_partkey") % 5 + 1) * 100))
    return j.select(F.col("o_custkey").alias("PERMNO"),
                    yyyymmdd(F.col("l_shipdate")).alias("DLSTDT"),
                    code.cast("int").alias("DLSTCD"))


def link(spark: SparkSession, sf: str) -> DataFrame:
    """Raw identifier intervals from partial-status orders; the last interval is open ('E').

    The next order date comes from a window per customer and year of order, and
    from the first date of the customer's next year with orders, so a customer
    with very many orders is spread over the years.
    """
    o = read_table(spark, sf, "orders").where(F.col("o_orderstatus") == "P").select(
        "o_custkey", "o_orderkey", "o_orderdate", F.year("o_orderdate").alias("yr"))
    w = Window.partitionBy("o_custkey", "yr").orderBy("o_orderdate", "o_orderkey")
    years = o.groupBy("o_custkey", "yr").agg(F.min("o_orderdate").alias("first"))
    by_year = Window.partitionBy("o_custkey").orderBy("yr")  # one row per year
    years = years.select("o_custkey", "yr", F.lead("first").over(by_year).alias("later"))
    nxt = F.coalesce(F.lead("o_orderdate").over(w), F.col("later"))
    return o.join(years, ["o_custkey", "yr"]).select(
        (F.col("o_custkey") + F.col("o_orderkey") % 2).alias("gvkey"),
        F.col("o_custkey").alias("LPERMNO"),
        yyyymmdd(F.col("o_orderdate")).alias("LINKDT"),
        F.coalesce(yyyymmdd(nxt).cast("string"), F.lit("E")).alias("LINKENDDT"))


def rating(items: DataFrame) -> DataFrame:
    grade = (F.when((F.col("l_returnflag") == "R") & (F.col("l_discount") >= 0.095)
                    & (F.col("l_tax") >= 0.065), "D")
             .when(F.col("l_returnflag") == "A", "BB").otherwise("A"))
    return items.select(F.col("o_custkey").alias("gvkey"),
                        F.date_format("l_shipdate", "yyyy/MM/dd").alias("datadate"),
                        grade.alias("splticrm"))


def deal_link(spark: SparkSession, sf: str) -> DataFrame:
    """Facility map: (order, status) -> firm."""
    return read_table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("facid"), F.col("o_orderstatus").alias("bcoid"),
        F.col("o_custkey").alias("gvkey"))


def loans(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as loan facilities (raw: start date as yyyymmdd int)."""
    li = read_table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("FacilityID"), F.col("l_linestatus").alias("BorrowerCompanyID"),
        yyyymmdd(F.col("l_shipdate")).alias("FacilityStartDate"),
        F.col("l_extendedprice").alias("FacilityAmt"),
        (F.lit(1.0) + F.col("l_tax")).alias("ExchangeRate"),
        F.col("l_quantity").alias("Maturity"),
        F.col("l_returnflag").alias("LoanType"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"))


def quotes(spark: SparkSession, sf: str) -> DataFrame:
    """Rate quotes per facility (order); duplicates per facility on purpose."""
    li = read_table(spark, sf, "lineitem")
    m = F.col("l_linenumber") % 3
    base = F.when(m == 0, "LIBOR").when(m == 1, "Fixed Rate").otherwise("Prime")
    mn = F.round(F.col("l_discount") * 10000)
    mx = F.when(F.col("l_tax") == 0, F.lit(None).cast("double")).otherwise(
        mn + F.round(F.col("l_tax") * 10000))
    return li.select(
        F.col("l_orderkey").alias("FacilityID"), base.alias("BaseRate"),
        mn.alias("MinBps"), mx.alias("MaxBps"),
        F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("partkey"),
        F.col("l_suppkey").alias("suppkey"), F.col("l_shipdate").cast("date").alias("quoted"),
        F.col("l_extendedprice").alias("amt"))


QUOTE_ORDER = ("line", "partkey", "suppkey", "quoted", "amt", "MinBps", "MaxBps")


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """Firm-years with sector, a rule-based default flag and five rule-based scores.

    PD grid: ``((7 gvkey + 13 fyear + 17 seed) mod 600) / 1000``, pred = PD >= 0.25.
    """
    fy = firm_years(spark, sf).select("gvkey", "fyear", "datadate")
    cust = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("gvkey"), sector_of(F.col("c_nationkey")).alias("gsector"))
    df = fy.join(cust, "gvkey", "left").withColumn(
        "default", F.when((F.col("gvkey") + F.col("fyear")) % 11 == 0, 1).otherwise(0))
    cols = []
    for m, s in MODEL_SEEDS.items():
        pd_ = ((F.col("gvkey") * 7 + F.col("fyear") * 13 + 17 * s) % 600).cast("double") / 1000.0
        cols += [F.when(pd_ >= 0.25, 1).otherwise(0).alias(f"pred_{m}"), pd_.alias(f"pd_{m}")]
    return df.select("gvkey", "datadate", "fyear", "default", "gsector", *cols)


class DriverInputs(StudyInputs):
    """The study's raw tables drawn from one folder of driver tables, each on demand.

    What several raw tables or several steps read again is written once to the
    shared folder, as the study's files would be.
    """

    def __init__(self, spark: SparkSession, sf: str) -> None:
        self.spark, self.sf = spark, sf

    @cached_property
    def financials(self) -> DataFrame:
        return financials(self.spark, self.sf)

    @cached_property
    def gdp(self) -> DataFrame:
        return gdp(self.spark, self.sf)

    @cached_property
    def _items(self) -> DataFrame:
        return materialize(discounted_items(self.spark, self.sf), "discounted-items", keep=True)

    @cached_property
    def delist(self) -> DataFrame:
        return delist(self._items)

    @cached_property
    def rating(self) -> DataFrame:
        return rating(self._items)

    @cached_property
    def link(self) -> DataFrame:
        return materialize(link(self.spark, self.sf), "link", keep=True)

    @cached_property
    def dealscan_link(self) -> DataFrame:
        return deal_link(self.spark, self.sf)

    @cached_property
    def loan(self) -> DataFrame:
        return loans(self.spark, self.sf)

    @cached_property
    def interest(self) -> DataFrame:
        return quotes(self.spark, self.sf)

    @cached_property
    def scores(self) -> DataFrame:
        return scores(self.spark, self.sf)
