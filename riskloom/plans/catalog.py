"""Registered queries: one Spark callable per operator group, with a SQL twin.

``QUERIES[name](spark, sf_dir) -> DataFrame``; ``SQL[name]`` is the same result
in SQL over the driver's tables (absent for non-SQL operators). Floating
values that depend on summation order or on different numeric methods are
rounded with :func:`fround` on both sides; exact values are not rounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import fround, normal_cdf, normal_ppf, sigmoid
from ..operators import capital as cap
from ..operators import evaluate as ev
from ..operators import labels as lab
from ..operators import linkage as lk
from ..operators import lsh, neighbors
from ..operators import panel as pn
from ..operators import prep
from ..operators import resample as rs
from ..operators import stats as st
from ..session import materialize, scratch_path
from ..sources import io
from ..sources.schemas import RATIOS
from . import flows
from . import oracle as o
from . import testbed as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

PANEL_RATIOS = [r for r in RATIOS if r not in flows.DROP_AFTER_CORR]


def query(name: str, sql: str | None = None):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def W(body: str, needed: list[str] | None = None, ctes: dict | None = None) -> str:
    return o.with_ctes(ctes if ctes is not None else o.BASE_CTES, body, needed)


A = o.entry_a_ctes()
C = o.entry_c_ctes()

# --------------------------------------------------------------------------- scans

_SPS_SQL = """
SELECT o_custkey AS gvkey, o_orderkey AS orderkey, CAST(o_orderdate AS DATE) AS datadate,
       o_totalprice AS amount, c_mktsegment AS segment
FROM orders JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND o_totalprice > 300000"""


def _scan_prune(spark: SparkSession, sf: str) -> DataFrame:
    orders = io.read_table(spark, sf, "orders")
    cust = io.read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    j = (orders.where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 300000))
         .join(cust, F.col("o_custkey") == F.col("c_custkey")))
    return (j.withColumnRenamed("o_custkey", "gvkey").withColumnRenamed("o_orderkey", "orderkey")
            .withColumn("datadate", F.col("o_orderdate").cast("date"))
            .withColumnRenamed("o_totalprice", "amount").withColumnRenamed("c_mktsegment", "segment")
            .drop("o_orderstatus", "o_orderdate", "o_orderpriority", "c_custkey")
            .select("gvkey", "orderkey", "datadate", "amount", "segment"))


@query("scan_prune_sort", _SPS_SQL + " ORDER BY gvkey, datadate, orderkey")
def q_scan_prune_sort(spark, sf):
    return _scan_prune(spark, sf).orderBy("gvkey", "datadate", "orderkey")


@query("preview_head", _SPS_SQL + " ORDER BY gvkey, datadate, orderkey LIMIT 10")
def q_preview_head(spark, sf):
    return io.preview(_scan_prune(spark, sf), 10, ["gvkey", "datadate", "orderkey"])


CUSTOMER_SCHEMA = "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("csv_round_trip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_csv_round_trip(spark, sf):
    path = scratch_path(spark, f"csv_round_trip/{uuid.uuid4().hex}")
    io.write_table(io.read_table(spark, sf, "customer"), path, fmt="csv")
    return io.read_csv(spark, path, CUSTOMER_SCHEMA)


@query("row_counts", """
SELECT 'orders' AS tbl, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM orders
UNION ALL
SELECT 'events' AS tbl, count(*) AS n_rows, count(DISTINCT user_id) AS n_keys FROM events
WHERE user_id IS NOT NULL""")
def q_row_counts(spark, sf):
    orders = io.read_table(spark, sf, "orders")
    events = io.read_table(spark, sf, "events").where(F.col("user_id").isNotNull())
    a = orders.agg(F.lit("orders").alias("tbl"), F.count(F.lit(1)).alias("n_rows"),
                   st.distinct_count(orders, "o_custkey").alias("n_keys"))
    b = events.agg(F.lit("events").alias("tbl"), F.count(F.lit(1)).alias("n_rows"),
                   st.distinct_count(events, "user_id").alias("n_keys"))
    return a.unionByName(b)


# --------------------------------------------------------------------------- panel

@query("panel_lag_gap", W("SELECT gvkey, fyear, datadate, roe, lag_rect, lag_at, lag_sale, lag_emp, lag_roe "
                          "FROM lagged"))
def q_panel_lag_gap(spark, sf):
    return flows.lagged_financials(tb.DriverInputs(spark, sf)).select(
        "gvkey", "fyear", "datadate", "roe", "lag_rect", "lag_at", "lag_sale", "lag_emp", "lag_roe")


def _round_s(df: DataFrame, col: str = "S", digits: int = 9) -> DataFrame:
    return df.withColumn(col, fround(col, digits)) if col in df.columns else df


@query("ratio_panel", W(f"SELECT * REPLACE ({o.fround('S', 9)} AS S) FROM pred",
                        ctes={**o.BASE_CTES, "pred": o.PANEL_CTES["pred"]}))
def q_ratio_panel(spark, sf):
    return _round_s(flows.predictors(tb.DriverInputs(spark, sf)))


_PANEL_C = {**o.BASE_CTES, **o.PANEL_CTES}


@query("macro_join", W("SELECT gvkey, fyear, gsector, gdp_growth FROM mpred", ctes=_PANEL_C))
def q_macro_join(spark, sf):
    return flows.macro_predictors(tb.DriverInputs(spark, sf)).select("gvkey", "fyear", "gsector", "gdp_growth")


@query("null_census", W(" UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_missing FROM mpred" for c in o.MPRED_COLS),
    ctes=_PANEL_C))
def q_null_census(spark, sf):
    return st.null_census(flows.macro_predictors(tb.DriverInputs(spark, sf)))


@query("thresh_sweep", W(
    "SELECT " + ", ".join(f"CAST(sum(CASE WHEN pc >= {t} THEN 1 ELSE 0 END) AS BIGINT) AS thresh_{t}"
                          for t in (21, 22, 23))
    + f", CAST(sum(CASE WHEN pc = {len(o.MPRED_COLS)} THEN 1 ELSE 0 END) AS BIGINT) AS complete "
    f"FROM (SELECT {o.present_sql(o.MPRED_COLS)} AS pc FROM mpred WHERE gsector IS NOT NULL)",
    ctes=_PANEL_C))
def q_thresh_sweep(spark, sf):
    p = pn.drop_missing(flows.macro_predictors(tb.DriverInputs(spark, sf)), ["gsector"])
    return pn.thresh_sweep(p, [21, 22, 23])


@query("thresh_keep", W("SELECT gvkey, fyear FROM screened", ctes=_PANEL_C))
def q_thresh_keep(spark, sf):
    return flows.screened_predictors(tb.DriverInputs(spark, sf)).select("gvkey", "fyear")


@query("semi_union", W("SELECT gvkey, fyear FROM screened WHERE gvkey IN (SELECT gvkey FROM firms)", ctes=_PANEL_C))
def q_semi_union(spark, sf):
    inputs = tb.DriverInputs(spark, sf)
    firms = lk.linked_firms(inputs.delist, inputs.link, inputs.rating)
    return lk.restrict_to_firms(flows.screened_predictors(inputs), firms).select("gvkey", "fyear")


# --------------------------------------------------------------------------- linkage

@query("link_extend", W("SELECT LPERMNO, gvkey, LINKDT, LINKENDDT, n_cand FROM lk", ctes=_PANEL_C))
def q_link_extend(spark, sf):
    return flows.extended_links(tb.DriverInputs(spark, sf)).select("LPERMNO", "gvkey", "LINKDT", "LINKENDDT", "n_cand")


@query("link_resolve", W("SELECT PERMNO, DLSTDT, DLSTCD, gvkey FROM res", ctes=_PANEL_C))
def q_link_resolve(spark, sf):
    return flows.resolved_delistings(tb.DriverInputs(spark, sf)).select("PERMNO", "DLSTDT", "DLSTCD", "gvkey")


@query("link_unresolved", W("""
SELECT CASE WHEN lk.LPERMNO IS NULL THEN 'no link' ELSE 'several, none valid' END AS reason, count(*) AS n_events
FROM ev LEFT JOIN (SELECT DISTINCT LPERMNO FROM lk) lk ON ev.PERMNO = lk.LPERMNO
WHERE NOT EXISTS (SELECT 1 FROM lk l WHERE l.LPERMNO = ev.PERMNO
                  AND (l.n_cand = 1 OR (l.LINKDT < ev.DLSTDT AND l.LINKENDDT > ev.DLSTDT)))
GROUP BY 1""", ctes=_PANEL_C))
def q_link_unresolved(spark, sf):
    """How many default delistings have no firm, and why."""
    return flows.unresolved_delistings(tb.DriverInputs(spark, sf))


@query("rating_first", W("SELECT gvkey, datadate, splticrm FROM rdef", ctes=_PANEL_C))
def q_rating_first(spark, sf):
    return flows.rating_events(tb.DriverInputs(spark, sf)).select("gvkey", "datadate", "splticrm")


_EW = {**_PANEL_C,
       "base": "SELECT gvkey, datadate, fyear, gsector FROM fin",
       "ewb": o.event_cte("base")}
_EW["lab"] = o.label_cte("ewb")
_EW["fd"] = o.first_default_cte("lab")

EVENT_COLS = ["gvkey", "datadate", "fyear", "gsector", "rating_date", "delist_date", "default", "default_date"]


@query("event_window", W('SELECT gvkey, datadate, fyear, gsector, rating_date, delist_date, "default", '
                         'default_date FROM lab', ctes=_EW))
def q_event_window(spark, sf):
    return flows.event_panel(tb.DriverInputs(spark, sf)).select(*EVENT_COLS)


@query("first_default", W('SELECT gvkey, datadate, fyear, "default", default_date FROM fd', ctes=_EW))
def q_first_default(spark, sf):
    return lab.keep_first_default(flows.event_panel(tb.DriverInputs(spark, sf))).select(
        "gvkey", "datadate", "fyear", "default", "default_date")


@query("sector_filter", W("SELECT gvkey, fyear, gsector FROM fin WHERE gsector IS NULL OR gsector NOT IN (40, 55, 60)",
                          ctes=_PANEL_C))
def q_sector_filter(spark, sf):
    f = pn.clean_financials(tb.DriverInputs(spark, sf).financials)
    return lab.drop_sectors(f).select("gvkey", "fyear", "gsector")


_SECTOR_VALUES = ", ".join(f"({c}, '{n}')" for c, n in o.SECTOR_NAMES)


@query("sector_table", W(f"""
SELECT ob.gsector, nm.sector, ob.defaults, COALESCE(fr.companies, 0) AS companies, ob.observations
FROM (SELECT gsector, CAST(sum("default") AS BIGINT) AS defaults, count(*) AS observations
      FROM fd WHERE gsector IS NOT NULL GROUP BY gsector) ob
LEFT JOIN (SELECT gsector, count(*) AS companies FROM (
             SELECT gsector, row_number() OVER (PARTITION BY gvkey ORDER BY datadate, fyear) AS rn FROM fd)
           WHERE rn = 1 AND gsector IS NOT NULL GROUP BY gsector) fr ON ob.gsector = fr.gsector
LEFT JOIN (SELECT CAST(c AS INTEGER) AS gsector, n AS sector FROM (VALUES {_SECTOR_VALUES}) t(c, n)) nm
  ON ob.gsector = nm.gsector""", ctes=_EW))
def q_sector_table(spark, sf):
    return lab.sector_table(lab.keep_first_default(flows.event_panel(tb.DriverInputs(spark, sf))))


# --------------------------------------------------------------------------- statistics

@query("year_means", W("SELECT fyear, " + ", ".join(
    f"{o.fround(o.nn(f'avg({r})'), 6)} AS {r}" for r in RATIOS) + " FROM pred GROUP BY fyear",
    ctes={**o.BASE_CTES, "pred": o.PANEL_CTES["pred"]}))
def q_year_means(spark, sf):
    m = st.year_means(flows.predictors(tb.DriverInputs(spark, sf)), "fyear", RATIOS)
    return m.select("fyear", *[fround(r, 6).alias(r) for r in RATIOS])


_PANEL_BODY_COLS = ["gvkey", "datadate", "fyear", *PANEL_RATIOS, "gsector", "gdp_growth", "default",
                    "default_date"]


@query("credit_panel", W("SELECT " + ", ".join(
    o.fround("S", 9) + " AS S" if c == "S" else f'"{c}"' if c == "default" else c for c in _PANEL_BODY_COLS)
    + " FROM panel", ctes=A))
def q_credit_panel(spark, sf):
    return _round_s(flows.labelled_panel(tb.DriverInputs(spark, sf)).select(*_PANEL_BODY_COLS))


@query("winsorize_rank", W("SELECT gvkey, datadate, " + ", ".join(
    o.fround("S", 9) + " AS S" if c == "S" else c for c in RATIOS) + " FROM wins", ctes=A))
def q_winsorize_rank(spark, sf):
    kept = materialize(flows.unwinsorized_panel(tb.DriverInputs(spark, sf)), "panel")
    return _round_s(st.winsorize(kept, RATIOS).select("gvkey", "datadate", *RATIOS))


def _describe_sql(digits: int, na: bool) -> str:
    parts = []
    for c in PANEL_RATIOS:
        cols = [f"'{c}' AS \"column\""]
        if na:
            pct = o.fround(f"{o.dbl('count(*) - count(' + c + ')')} / {o.dbl('count(*)')} * {o.lit(100.0)}", 2)
            cols += [f"{pct} AS na_pct", f"CAST({pct} AS VARCHAR) || '%' AS na"]
        else:
            cols += [f"count({c}) AS count"]
        stats = [(f"avg({c})", "mean"), (f"stddev_samp({c})", "std"), (f"min({c})", "min"),
                 (f"quantile_cont({c}, 0.25)", "q25"), (f"quantile_cont({c}, 0.5)", "q50"),
                 (f"quantile_cont({c}, 0.75)", "q75"), (f"max({c})", "max")]
        cols += [f"{o.fround(o.nn(e), digits)} AS {n}" for e, n in stats]
        parts.append("SELECT " + ", ".join(cols) + " FROM panel")
    return W(" UNION ALL ".join(parts), ctes=A)


@query("describe", _describe_sql(9, na=False))
def q_describe(spark, sf):
    p = flows.labelled_panel(tb.DriverInputs(spark, sf))
    d = st.describe(p, PANEL_RATIOS)
    return d.select("column", "count", *[fround(c, 9).alias(c) for c in
                                         ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("summary_na", _describe_sql(3, na=True))
def q_summary_na(spark, sf):
    p = flows.labelled_panel(tb.DriverInputs(spark, sf))
    return st.summary_na(p, PANEL_RATIOS, digits=3)


CORR_COLS = [*PANEL_RATIOS, "gdp_growth"]


def _corr_sql(threshold: float | None) -> str:
    pairs = [(a, b) for i, a in enumerate(CORR_COLS) for b in CORR_COLS[i + 1:]]
    body = " UNION ALL ".join(f"SELECT '{a}' AS col_a, '{b}' AS col_b, {o.nn(f'corr({a}, {b})')} AS r FROM panel"
                              for a, b in pairs)
    where = f" WHERE abs(r) >= {o.lit(threshold)}" if threshold is not None else ""
    return W(f"SELECT col_a, col_b, {o.fround('r', 9)} AS r FROM ({body}){where}", ctes=A)


@query("corr_pairs", _corr_sql(None))
def q_corr_pairs(spark, sf):
    c = st.corr_pairs(flows.labelled_panel(tb.DriverInputs(spark, sf)), CORR_COLS)
    return c.withColumn("r", fround("r", 9))


@query("collinear", _corr_sql(0.5))
def q_collinear(spark, sf):
    c = st.collinear(st.corr_pairs(flows.labelled_panel(tb.DriverInputs(spark, sf)), CORR_COLS), 0.5)
    return c.withColumn("r", fround("r", 9))


# --------------------------------------------------------------------------- loans and capital

LOAN_OUT = ["FacilityID", "line", "partkey", "suppkey", "gvkey", "FacilityStartDate", "FacilityAmt"]


@query("two_key_join", W("SELECT " + ", ".join(LOAN_OUT) + ", BorrowerCompanyID FROM floans", ctes=C))
def q_two_key_join(spark, sf):
    return flows.facility_loans(tb.DriverInputs(spark, sf)).select(*LOAN_OUT, "BorrowerCompanyID")


@query("dedupe_rate", W("SELECT FacilityID, BaseRate, MinBps, MaxBps, rate FROM rates", ctes=C))
def q_dedupe_rate(spark, sf):
    return flows.facility_rates(tb.DriverInputs(spark, sf), tb.QUOTE_ORDER).select("FacilityID", "BaseRate", "MinBps", "MaxBps", "rate")


@query("left_drop", W("SELECT " + ", ".join(f"fl.{c}" for c in LOAN_OUT) + """, r.rate
FROM floans fl LEFT JOIN rates r ON fl.FacilityID = r.FacilityID
WHERE r.rate IS NOT NULL AND fl.Maturity IS NOT NULL""", ctes=C))
def q_left_drop(spark, sf):
    rates = flows.facility_rates(tb.DriverInputs(spark, sf), tb.QUOTE_ORDER).select("FacilityID", "rate")
    return cap.attach_rates(flows.facility_loans(tb.DriverInputs(spark, sf)), rates).select(*LOAN_OUT, "rate")


@query("asof_loan", W("SELECT " + ", ".join(LOAN_OUT) + ', datadate, fyear, "default", gsector, pd_lr FROM asofm',
                      ctes=C))
def q_asof_loan(spark, sf):
    m = lk.asof_match(flows.facility_loans(tb.DriverInputs(spark, sf)), tb.scores(spark, sf))
    return m.select(*LOAN_OUT, "datadate", "fyear", "default", "gsector", "pd_lr")


@query("lgd_lookup", W("SELECT gvkey, fyear, gsector, COALESCE(CASE gsector " + " ".join(
    f"WHEN {g} THEN {o.lit(v)}" for g, v in o.LGD_PAIRS) + f" END, {o.lit(0.0)}) AS LGD FROM scores", ctes=C))
def q_lgd_lookup(spark, sf):
    return cap.attach_lgd(tb.scores(spark, sf)).select("gvkey", "fyear", "gsector", "LGD")


def _capital_long(spark, sf) -> DataFrame:
    inputs = tb.DriverInputs(spark, sf)
    return flows.capital_long(inputs, inputs.scores, tb.QUOTE_ORDER)


@query("capital_long", W("SELECT " + ", ".join(LOAN_OUT) + ", model, pred, pd, LGD, rate, "
                         + o.fround("CR", 2) + " AS CR FROM cpx", ctes=C))
def q_capital_long(spark, sf):
    return _capital_long(spark, sf).select(*LOAN_OUT, "model", "pred", "pd", "LGD", "rate",
                                                fround("CR", 2).alias("CR"))


_T0 = f"""SELECT model,
  {o.fround('avg(CASE WHEN pred = 0 THEN 1.0 ELSE 0.0 END)', 3)} AS loan_rate,
  {o.fround('sum(CR) / 1e9', 3)} AS capital_bn FROM cpx GROUP BY model"""


@query("capital_table", W(f"""
SELECT model, loan_rate, capital_bn, {o.fround('b - capital_bn', 3)} AS savings_bn,
  {o.fround(o.fround('b - capital_bn', 3) + ' / nullif(b, 0) * 100.0', 1)} AS percent
FROM (SELECT *, (SELECT capital_bn FROM t0 WHERE model = 'lr') AS b FROM t0)""", ctes={**C, "t0": _T0}))
def q_capital_table(spark, sf):
    return cap.capital_table(_capital_long(spark, sf))


_LOSS_T0 = f"""SELECT model,
  {o.fround('COALESCE(sum(CASE WHEN "default" = 1 AND pred = 0 THEN FacilityAmt * ExchangeRate * LGD END), 0.0) / 1e9', 3)} AS loss_ii,
  {o.fround('COALESCE(sum(CASE WHEN "default" = 0 AND pred = 1 THEN FacilityAmt * ExchangeRate * rate END), 0.0) / 1e9', 3)} AS loss_i,
  {o.fround('COALESCE(' + o.lit(0.115) + ' * sum(CR), 0.0) / 1e9', 3)} AS loss_cr,
  {o.fround('(COALESCE(sum(CASE WHEN "default" = 1 AND pred = 0 THEN FacilityAmt * ExchangeRate * LGD END), 0.0) + COALESCE(sum(CASE WHEN "default" = 0 AND pred = 1 THEN FacilityAmt * ExchangeRate * rate END), 0.0) + COALESCE(' + o.lit(0.115) + ' * sum(CR), 0.0)) / 1e9', 3)} AS loss_total
FROM cpx GROUP BY model"""


@query("eco_loss", W(f"""
SELECT model, loss_ii, loss_i, loss_cr, loss_total, {o.fround('b - loss_total', 3)} AS gains,
  {o.fround(o.fround('b - loss_total', 3) + ' / nullif(b, 0) * 100.0', 1)} AS percent
FROM (SELECT *, (SELECT loss_total FROM t1 WHERE model = 'lr') AS b FROM t1)""", ctes={**C, "t1": _LOSS_T0}))
def q_eco_loss(spark, sf):
    return cap.eco_loss(_capital_long(spark, sf))


@query("loss_skipped", W("""
SELECT model, count(*) AS n_rows,
  count(*) FILTER (WHERE "default" = 1 AND pred = 0 AND FacilityAmt * ExchangeRate * LGD IS NULL) AS skipped_ii,
  count(*) FILTER (WHERE "default" = 0 AND pred = 1 AND FacilityAmt * ExchangeRate * rate IS NULL) AS skipped_i,
  count(*) FILTER (WHERE CR IS NULL) AS skipped_cr FROM cpx GROUP BY model""", ctes=C))
def q_loss_skipped(spark, sf):
    """Rows that the sums of the loss table leave out for want of an amount."""
    return cap.skipped_rows(_capital_long(spark, sf))


@query("eco_loss_exact", W(f"""
SELECT model, {o.fround('t', 3)} AS loss_total, {o.fround('b - t', 3)} AS gains, {o.fround('(b - t) / nullif(b, 0) * 100.0', 1)} AS percent
FROM (SELECT *, (SELECT t FROM t2 WHERE model = 'lr') AS b FROM t2)""", ctes={**C, "t2": f"""SELECT model,
  (COALESCE(sum(CASE WHEN "default" = 1 AND pred = 0 THEN FacilityAmt * ExchangeRate * LGD END), 0.0)
   + COALESCE(sum(CASE WHEN "default" = 0 AND pred = 1 THEN FacilityAmt * ExchangeRate * rate END), 0.0)
   + COALESCE({o.lit(0.115)} * sum(CR), 0.0)) / 1e9 AS t FROM cpx GROUP BY model"""}))
def q_eco_loss_exact(spark, sf):
    """Gains taken before rounding."""
    return cap.eco_loss(_capital_long(spark, sf), exact=True).select("model", "loss_total", "gains", "percent")


# --------------------------------------------------------------------------- normal distribution

@query("normal_cdf", f"""
SELECT p_partkey, x, {o.fround(o.simpson_cdf('x'), 8)} AS cdf,
  {o.fround(f'{o.lit(1.0)} / ({o.lit(1.0)} + exp(-x))', 12)} AS logistic,
  {o.fround('sqrt(x * x)', 12)} AS abs_x
FROM (SELECT p_partkey, (p_retailprice - {o.lit(1500.0)}) / {o.lit(250.0)} AS x FROM part)""")
def q_normal_cdf(spark, sf):
    p = io.read_table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_retailprice") - 1500.0) / 250.0).alias("x"))
    return p.select("p_partkey", "x", fround(normal_cdf("x"), 8).alias("cdf"),
                    fround(sigmoid("x"), 12).alias("logistic"),
                    fround(F.sqrt(F.col("x") * F.col("x")), 12).alias("abs_x"))


def _newton_ppf_sql() -> str:
    ctes = {"qp": f"SELECT p_partkey, {o.dbl('p_partkey % 997 + 1')} / {o.lit(999.0)} AS p FROM part",
            "ps": "SELECT DISTINCT p FROM qp", **o.newton_ctes("ps", "n")}
    return o.with_ctes(ctes, f"SELECT q.p_partkey, q.p, {o.fround('n.x', 7)} AS ppf FROM qp q JOIN n16 n ON q.p = n.p")


@query("normal_ppf", _newton_ppf_sql())
def q_normal_ppf(spark, sf):
    p = io.read_table(spark, sf, "part").select(
        "p_partkey", ((F.col("p_partkey") % 997 + 1).cast("double") / 999.0).alias("p"))
    return p.select("p_partkey", "p", fround(normal_ppf("p"), 7).alias("ppf"))


# --------------------------------------------------------------------------- classification metrics

_LABEL_LONG_SQL = """
SELECT 'quality_flip' AS model, toxic AS label, 1 - quality AS pred FROM labels
UNION ALL SELECT 'quality' AS model, toxic AS label, quality AS pred FROM labels
UNION ALL SELECT 'never' AS model, toxic AS label, 0 AS pred FROM labels"""


def _label_long(spark, sf) -> DataFrame:
    lb = io.read_table(spark, sf, "labels")
    args = "'quality_flip', toxic, 1 - quality, 'quality', toxic, quality, 'never', toxic, 0"
    return lb.select(F.expr(f"stack(3, {args}) AS (model, label, pred)"))


_CM_SQL = f"""
SELECT model,
  CAST(sum(CASE WHEN label = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN label = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN label = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN label = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
FROM ({_LABEL_LONG_SQL}) GROUP BY model"""


@query("confusion", _CM_SQL)
def q_confusion(spark, sf):
    return ev.confusion(_label_long(spark, sf))


def _ratio_sql(n: str, d: str) -> str:
    return f"(CASE WHEN ({d}) = 0 THEN {o.lit(0.0)} ELSE {o.dbl(n)} / {o.dbl(d)} END)"


@query("scores", f"""
SELECT model, tn, fp, fn, tp,
  {_ratio_sql('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
  {_ratio_sql('tp', 'tp + fp')} AS precision,
  {_ratio_sql('tp', 'tp + fn')} AS recall,
  (CASE WHEN ({o.lit(5.0)} * tp + {o.lit(4.0)} * fn + fp) = 0 THEN {o.lit(0.0)}
        ELSE ({o.lit(5.0)} * tp) / ({o.lit(5.0)} * tp + {o.lit(4.0)} * fn + fp) END) AS f_beta
FROM ({_CM_SQL})""")
def q_scores(spark, sf):
    return ev.classification_metrics(_label_long(spark, sf))


@query("class_balance", """
SELECT CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_pos,
       CAST(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_neg,
       CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE)
         / CAST(nullif(sum(CASE WHEN toxic = 0 THEN 1 ELSE 0 END), 0) AS DOUBLE) AS ratio,
       CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS share
FROM labels""")
def q_class_balance(spark, sf):
    return st.class_balance(io.read_table(spark, sf, "labels"), "toxic")


# --------------------------------------------------------------------------- preparation

IMPUTE_FEATS = ["f1", "f2", "f3"]


def _impute_input(spark, sf) -> DataFrame:
    p = io.read_table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(
        "p_partkey",
        F.when(k % 17 == 0, F.lit(None)).otherwise(F.col("p_size").cast("double")).alias("f1"),
        F.when(k % 23 == 0, F.lit(None)).otherwise(F.col("p_retailprice") / 100.0).alias("f2"),
        (k % 50).cast("double").alias("f3"))


def _impute_sql() -> str:
    ctes = {"x": f"""SELECT p_partkey,
  CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE {o.dbl('p_size')} END AS f1,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE p_retailprice / {o.lit(100.0)} END AS f2,
  {o.dbl('p_partkey % 50')} AS f3 FROM part"""}
    # NaN-aware distance over the three features
    terms = [f"(CASE WHEN r.{f} IS NOT NULL AND d.{f} IS NOT NULL THEN (r.{f} - d.{f}) * (r.{f} - d.{f}) END)"
             for f in IMPUTE_FEATS]
    present = " + ".join(f"(CASE WHEN r.{f} IS NOT NULL AND d.{f} IS NOT NULL THEN 1 ELSE 0 END)"
                         for f in IMPUTE_FEATS)
    ssum = " + ".join(f"COALESCE({t}, 0.0)" for t in terms)
    dist = f"sqrt(({ssum}) * 3.0 / ({present}))"
    for f in ("f1", "f2"):
        ctes[f"imp_{f}"] = f"""SELECT rid, avg(v) AS v FROM (
  SELECT r.p_partkey AS rid, d.{f} AS v,
         row_number() OVER (PARTITION BY r.p_partkey ORDER BY {dist}, d.p_partkey) AS rn
  FROM x r JOIN x d ON r.{f} IS NULL AND d.{f} IS NOT NULL AND ({present}) > 0) WHERE rn <= 5 GROUP BY rid"""
    body = f"""SELECT x.p_partkey,
  {o.fround('COALESCE(x.f1, i1.v, (SELECT avg(f1) FROM x))', 9)} AS f1,
  {o.fround('COALESCE(x.f2, i2.v, (SELECT avg(f2) FROM x))', 9)} AS f2,
  x.f3 FROM x LEFT JOIN imp_f1 i1 ON x.p_partkey = i1.rid LEFT JOIN imp_f2 i2 ON x.p_partkey = i2.rid"""
    return o.with_ctes(ctes, body)


@query("knn_impute", _impute_sql())
def q_knn_impute(spark, sf):
    out = prep.knn_impute(_impute_input(spark, sf), "p_partkey", IMPUTE_FEATS, k=5)
    return out.select("p_partkey", fround("f1", 9).alias("f1"), fround("f2", 9).alias("f2"), "f3")


SECTOR_LEVELS = [c for c in tb.SECTOR_BY_MOD12 if c is not None]


@query("one_hot", f"SELECT c_custkey, " + ", ".join(
    f"CASE WHEN {o.sector_case('c_nationkey')} = {v} THEN 1 ELSE 0 END AS gsector_{v}" for v in SECTOR_LEVELS[1:])
    + " FROM customer")
def q_one_hot(spark, sf):
    c = io.read_table(spark, sf, "customer").select("c_custkey", tb.sector_of(F.col("c_nationkey")).alias("gsector"))
    return prep.one_hot(c, "gsector", SECTOR_LEVELS)


def _rank_sql(seed: int) -> str:
    return (f"row_number() OVER (PARTITION BY toxic ORDER BY substr(md5('{seed}:' || CAST(doc_id AS VARCHAR)), 1, 13), "
            f"doc_id) - 1")


@query("strat_split", f"""
SELECT doc_id, toxic, CASE WHEN rk < floor({o.lit(0.2)} * n + 0.5) THEN 'test' ELSE 'train' END AS split FROM (
  SELECT doc_id, toxic, {_rank_sql(0)} AS rk, count(*) OVER (PARTITION BY toxic) AS n FROM labels)""")
def q_strat_split(spark, sf):
    lb = io.read_table(spark, sf, "labels").select("doc_id", "toxic")
    return prep.stratified_split(lb, ["doc_id"], "toxic", 0.2, seed=0)


@query("hash_split", f"""
SELECT doc_id, CASE WHEN CAST('0x' || substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) < {int(0.2 * 2 ** 52)}
  THEN 'test' ELSE 'train' END AS split FROM documents""")
def q_hash_split(spark, sf):
    """Split by a hash threshold: a projection of the scan."""
    return prep.threshold_split(io.read_table(spark, sf, "documents").select("doc_id"), ["doc_id"], 0.2, seed=0)


@query("folds", f"""
SELECT doc_id, toxic, CAST(({_rank_sql(0)}) % 5 AS INTEGER) AS fold FROM labels""")
def q_folds(spark, sf):
    lb = io.read_table(spark, sf, "labels").select("doc_id", "toxic")
    return prep.stratified_folds(lb, ["doc_id"], "toxic", 5, seed=0)


@query("undersample", f"""
SELECT doc_id, toxic FROM labels WHERE toxic = 1
UNION ALL
SELECT doc_id, toxic FROM (SELECT doc_id, toxic, {_rank_sql(42)} AS rk FROM labels WHERE toxic <> 1)
WHERE rk < CAST(floor((SELECT count(*) FROM labels WHERE toxic = 1) / {o.lit(0.5)}) AS BIGINT)""")
def q_undersample(spark, sf):
    lb = io.read_table(spark, sf, "labels").select("doc_id", "toxic")
    return rs.undersample(lb, ["doc_id"], "toxic", 0.5, minority=1, seed=42)


def embedding_frame(spark, sf) -> DataFrame:
    """Embeddings as columns e0, e1, ...; minority = label 0 with vec_id divisible by 3."""
    e = io.read_table(spark, sf, "embeddings")
    width = e.agg(F.max(F.size("embedding"))).first()[0] or 0
    return e.select(F.col("vec_id"),
                    *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i}") for i in range(width)],
                    F.when((F.col("label") == 0) & (F.col("vec_id") % 3 == 0), 1).otherwise(0).alias("y"))


def _draw_sql(tag: str) -> str:
    return f"CAST('0x' || substr(md5('0:{tag}:' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT)"


@query("smote", f"""
WITH m AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label = 0 AND vec_id % 3 = 0),
c AS (SELECT (SELECT count(*) FROM m) AS n_min, (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM m) AS n_maj),
nn AS (
  SELECT a.id AS qid, b.id AS pid,
         row_number() OVER (PARTITION BY a.id ORDER BY list_sum(list_transform(range(1, len(a.e) + 1),
             lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i]))), b.id) AS nn
  FROM m a JOIN m b ON a.id <> b.id),
ranked AS (SELECT id, row_number() OVER (ORDER BY substr(md5('0:' || CAST(id AS VARCHAR)), 1, 13), id) - 1 AS r FROM m),
d AS (
  SELECT j, {_draw_sql('row')} % n_min AS r, {_draw_sql('nb')} % least(5, n_min - 1) + 1 AS nn,
         CAST({_draw_sql('u')} AS DOUBLE) / 4503599627370496.0 AS u
  FROM (SELECT unnest(range(CAST(floor({o.lit(0.1)} * n_maj) AS BIGINT) - n_min)) AS j, n_min FROM c)),
s AS (
  SELECT d.j, d.u, x.e AS x, y.e AS y FROM d JOIN ranked USING (r) JOIN m x ON x.id = ranked.id
  JOIN nn ON nn.qid = ranked.id AND nn.nn = d.nn JOIN m y ON y.id = nn.pid)
SELECT -(j + 1) AS vec_id, i - 1 AS dim, {o.fround('x[i] + u * (y[i] - x[i])', 9)} AS value
FROM (SELECT *, unnest(range(1, len(x) + 1)) AS i FROM s)""")
def q_smote(spark, sf):
    e = embedding_frame(spark, sf)
    dims = [c for c in e.columns if c not in ("vec_id", "y")]
    made = rs.smote(e, "vec_id", dims, "y", ratio=0.1, k=5, minority=1, seed=0)
    values = F.posexplode(F.array(*[F.col(c) for c in dims])).alias("dim", "value")
    return made.select("vec_id", values).select("vec_id", F.col("dim").cast("long").alias("dim"),
                                                fround("value", 9).alias("value"))


def _embedding_queries(spark, sf) -> tuple[DataFrame, DataFrame, list[str]]:
    """(queries, points, coordinates): every fiftieth embedding against all."""
    e = embedding_frame(spark, sf)
    return e.where(F.col("vec_id") % 50 == 0), e, [c for c in e.columns if c not in ("vec_id", "y")]


@query("knn_search", f"""
SELECT qid AS vec_id, pid AS neighbour, nn, {o.fround('dist', 9)} AS dist FROM (
  SELECT a.vec_id AS qid, b.vec_id AS pid, d AS dist,
         CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY d, b.vec_id) AS INTEGER) AS nn
  FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 50 = 0) a
  JOIN (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b ON a.vec_id <> b.vec_id,
  LATERAL (SELECT sqrt(list_sum(list_transform(range(1, len(a.e) + 1),
             lambda i: (a.e[i] - b.e[i]) * (a.e[i] - b.e[i])))) AS d)) WHERE nn <= 10""")
def q_knn_search(spark, sf):
    """The ten nearest other embeddings of every fiftieth, exactly."""
    q, e, dims = _embedding_queries(spark, sf)
    found = neighbors.knn(q, e, dims, 10, id_col="vec_id", exclude_self=True)
    return found.select(F.col("qid").alias("vec_id"), F.col("pid").alias("neighbour"), F.col("nn").cast("int").alias("nn"),
                        fround("dist", 9).alias("dist"))


@query("knn_lsh")
def q_knn_lsh(spark, sf):
    """The same from hash tables: nearly all of them (recall is tested, so no SQL twin)."""
    q, e, dims = _embedding_queries(spark, sf)
    found = lsh.lsh_knn(q, e, dims, 10, id_col="vec_id", exclude_self=True)
    return found.select(F.col("qid").alias("vec_id"), F.col("pid").alias("neighbour"), F.col("nn").cast("int").alias("nn"),
                        fround("dist", 9).alias("dist"))


@query("knn_work")
def q_knn_work(spark, sf):
    """Cells, visits and compared pairs of the imputation and of the search for minority neighbours."""
    x = _impute_input(spark, sf)
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(IMPUTE_FEATS)]))
    impute = neighbors.PivotTree(x, IMPUTE_FEATS, "p_partkey").work(
        x.withColumn("need", F.explode(gaps)), 5, "p_partkey", "need")
    e = embedding_frame(spark, sf)
    dims, few = [c for c in e.columns if c not in ("vec_id", "y")], e.where("y = 1")
    smote = neighbors.PivotTree(few, dims, "vec_id").work(few, 5, "vec_id", exclude_self=True)
    return impute.withColumn("search", F.lit("knn_impute")).unionByName(smote.withColumn("search", F.lit("smote")))
