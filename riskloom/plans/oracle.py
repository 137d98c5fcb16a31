"""SQL twins of the derived inputs and flows, for checking with another engine.

Written for DuckDB-style ANSI SQL over the driver's pre-registered views. The
text is built from small helpers so each formula is stated once; nothing here
runs on Spark.
"""

from __future__ import annotations

from ..sources.schemas import RATIOS

# Fixed values, restated: what the twins check must not come from the code they check.
SECTOR_BY_MOD12 = [10, 15, 20, 25, 30, 35, 40, 45, 50, 55, 60, None]
SECTOR_NAMES = [
    (10, "Energy"), (15, "Materials"), (20, "Industrials"), (25, "Consumer Discretionary"),
    (30, "Consumer Staples"), (35, "Health Care"), (40, "Financials"), (45, "Information Technology"),
    (50, "Communication Services"), (55, "Utilities"), (60, "Real Estate"),
]
INF = "CAST('Infinity' AS DOUBLE)"


def dbl(x) -> str:
    return f"CAST({x} AS DOUBLE)"


def lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def nn(x: str) -> str:
    return f"(CASE WHEN isnan({x}) THEN NULL ELSE {x} END)"


def div(n: str, d: str) -> str:
    return (f"(CASE WHEN ({d}) <> 0 THEN {nn(f'(({n}) / ({d}))')} WHEN ({d}) = 0 THEN "
            f"(CASE WHEN ({n}) > 0 THEN {INF} WHEN ({n}) < 0 THEN -{INF} END) END)")


def sub(a: str, b: str) -> str:
    return nn(f"(({a}) - ({b}))")


def ln(x: str) -> str:
    return f"(CASE WHEN ({x}) > 0 THEN ln({x}) WHEN ({x}) = 0 THEN -{INF} END)"


def fround(x: str, d: int) -> str:
    m = lit(float(10 ** d))
    r = f"(floor(abs({x}) * {m} + {lit(0.5)}) / {m})"
    return (f"(CASE WHEN abs({x}) * {m} < {lit(float(2 ** 53))} THEN (CASE WHEN ({x}) < 0 THEN -{r} ELSE {r} END) "
            f"ELSE {x} END)")


def ymd_int(x: str) -> str:
    return f"CAST(strftime({x}, '%Y%m%d') AS INTEGER)"


def parse_ymd(x: str) -> str:
    return f"CAST(strptime(CAST({x} AS VARCHAR), '%Y%m%d') AS DATE)"


def cents(x: str) -> str:
    return f"CAST(round({x} * 100) AS BIGINT)"


def sector_case(x: str) -> str:
    whens = " ".join(f"WHEN {i} THEN {c}" for i, c in enumerate(SECTOR_BY_MOD12) if c is not None)
    return f"CAST(CASE ({x}) % 12 {whens} END AS INTEGER)"


# --------------------------------------------------------------------------- inputs

BASE_CTES = {
    "items": f"""
SELECT l_orderkey,
  SUM({cents('l_extendedprice')}) AS rev_c,
  SUM({cents('l_extendedprice')} * {cents('l_discount')}) AS disc_c,
  SUM({cents('l_extendedprice')} * {cents('l_tax')}) AS tax_c,
  SUM(CAST(l_quantity AS BIGINT)) AS qty,
  COUNT(*) AS n_items,
  SUM(CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END) AS n_keep
FROM lineitem GROUP BY l_orderkey""",
    "fy": f"""
SELECT o_custkey AS gvkey, CAST(year(o_orderdate) AS INTEGER) AS fyear,
  MAX(CAST(o_orderdate AS DATE)) AS datadate,
  SUM({cents('o_totalprice')}) AS tot_c,
  SUM(CASE WHEN o_orderstatus = 'F' THEN {cents('o_totalprice')} ELSE 0 END) AS totF_c,
  SUM(CASE WHEN o_orderstatus = 'O' THEN {cents('o_totalprice')} ELSE 0 END) AS totO_c,
  SUM(CASE WHEN o_orderstatus = 'P' THEN {cents('o_totalprice')} ELSE 0 END) AS totP_c,
  SUM(COALESCE(rev_c, 0)) AS rev_c, SUM(COALESCE(disc_c, 0)) AS disc_c,
  SUM(COALESCE(tax_c, 0)) AS tax_c, SUM(COALESCE(qty, 0)) AS qty,
  SUM(COALESCE(n_items, 0)) AS n_items, SUM(COALESCE(n_keep, 0)) AS n_keep
FROM orders LEFT JOIN items ON o_orderkey = l_orderkey GROUP BY 1, 2""",
    "sect": f"SELECT c_custkey AS gvkey, {sector_case('c_nationkey')} AS gsector FROM customer",
    "fin_raw": f"""
SELECT f.gvkey, f.datadate, f.fyear, s.gsector,
  {dbl('rev_c * 5 - disc_c')} / 1e7 AS ni,
  {dbl('totF_c - totO_c')} / 1e5 AS ceq,
  {dbl('nullif(totO_c, 0)')} / 1e5 AS rect,
  {dbl('tot_c')} / 1e5 AS "at",
  {dbl('rev_c')} / 1e5 AS sale,
  {dbl('nullif(n_keep, 0)')} AS emp,
  {dbl('totF_c - totO_c')} / 1e5 AS wcap,
  {dbl('totF_c')} / 1e5 AS act,
  {dbl('rev_c * 10 - disc_c')} / 1e7 AS ibc,
  {dbl('tax_c')} / 1e7 AS dp,
  {dbl('totP_c')} / 1e5 AS dltt,
  {dbl('totO_c')} / 1e5 AS dlc,
  {dbl('disc_c')} / 1e7 AS ch,
  {dbl('rev_c - totF_c')} / 1e5 AS oancf,
  {dbl('-tax_c')} / 1e7 AS ivncf,
  {dbl('disc_c - tax_c')} / 1e7 AS fincf,
  {dbl('totF_c - totP_c')} / 1e5 AS re,
  {dbl('rev_c * 20 - disc_c')} / 1e7 AS ebitda,
  {dbl('tax_c')} / 1e7 AS pstkc,
  {dbl('qty')} / {lit(100.0)} AS csho,
  {dbl('totO_c + totP_c')} / 1e5 AS lt,
  {dbl('disc_c')} / 1e7 AS che
FROM fy f LEFT JOIN sect s ON f.gvkey = s.gvkey""",
    "fin": """
SELECT * REPLACE (CASE WHEN dltt = 0 THEN CAST(1.0 AS DOUBLE) ELSE dltt END AS dltt)
FROM fin_raw WHERE emp > 0""",
    "lagged": f"""
SELECT *,
  CASE WHEN fyear - lag(fyear) OVER w = 1 THEN lag(rect) OVER w END AS lag_rect,
  CASE WHEN fyear - lag(fyear) OVER w = 1 THEN lag("at") OVER w END AS lag_at,
  CASE WHEN fyear - lag(fyear) OVER w = 1 THEN lag(sale) OVER w END AS lag_sale,
  CASE WHEN fyear - lag(fyear) OVER w = 1 THEN lag(emp) OVER w END AS lag_emp,
  CASE WHEN fyear - lag(fyear) OVER w = 1 THEN lag(roe) OVER w END AS lag_roe
FROM (SELECT *, {div('ni', 'ceq')} AS roe FROM fin)
WINDOW w AS (PARTITION BY gvkey ORDER BY datadate, fyear)""",
    "yv": f"SELECT CAST(year(o_orderdate) AS INTEGER) AS year, SUM({cents('o_totalprice')}) AS v FROM orders GROUP BY 1",
    "gdp": f"""
SELECT y.year, {dbl('y.v - p.v')} / {dbl('p.v')} AS gdp_growth
FROM yv y LEFT JOIN yv p ON p.year + 1 = y.year""",
    "items_c": """
SELECT l.*, o.o_custkey, o.o_orderstatus FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "delist": f"""
SELECT o_custkey AS PERMNO, {ymd_int('l_shipdate')} AS DLSTDT,
  CAST(CASE l_partkey % 10 WHEN 0 THEN 560 WHEN 1 THEN 572 WHEN 2 THEN 574 WHEN 3 THEN 520
       WHEN 4 THEN 600 ELSE (l_partkey % 5 + 1) * 100 END AS INTEGER) AS DLSTCD
FROM items_c WHERE l_returnflag = 'R' AND l_discount >= 0.085 AND l_tax <= 0.015""",
    "link": f"""
SELECT o_custkey + o_orderkey % 2 AS gvkey, o_custkey AS LPERMNO, {ymd_int('o_orderdate')} AS LINKDT,
  COALESCE(CAST({ymd_int('lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)')}
           AS VARCHAR), 'E') AS LINKENDDT
FROM orders WHERE o_orderstatus = 'P'""",
    "rating": """
SELECT o_custkey AS gvkey, strftime(l_shipdate, '%Y/%m/%d') AS datadate,
  CASE WHEN l_returnflag = 'R' AND l_discount >= 0.095 AND l_tax >= 0.065 THEN 'D'
       WHEN l_returnflag = 'A' THEN 'BB' ELSE 'A' END AS splticrm
FROM items_c WHERE l_discount >= 0.075""",
}


def ratio_sql() -> dict[str, str]:
    return {
        "L1": div("wcap", '"at"'),
        "L2": div("act", sub('"at"', "act")),
        "L3": div(div("ibc + dp", '"at"'), "dltt"),
        "L4": div("oancf + ivncf + fincf", "sale"),
        "L5": div("dlc", "act"),
        "L6": div("ch", '"at"'),
        "P1": div("re", '"at"'),
        "P2": div("ni", '"at"'),
        "P3": div("ebitda", "sale"),
        "E1": div("ebitda", '"at"'),
        "E2": div("sale", '"at"'),
        "E3": div(f"(rect + lag_rect) / {lit(2.0)}", "sale"),
        "R1": div("pstkc + csho", '"at"'),
        "R2": div(sub("lt", "che"), "ebitda"),
        "G1": div(sub('"at"', "lag_at"), "lag_at"),
        "G2": div(sub("sale", "lag_sale"), "lag_sale"),
        "G3": sub("roe", "lag_roe"),
        "G4": div(sub("emp", "lag_emp"), "lag_emp"),
        "S": ln('"at"'),
    }


def present_sql(cols: list[str]) -> str:
    return " + ".join(f"(CASE WHEN {c} IS NULL THEN 0 ELSE 1 END)" for c in cols)


PRED_COLS = ["gvkey", "datadate", "fyear", *RATIOS, "gsector"]
MPRED_COLS = [*PRED_COLS, "gdp_growth"]

PANEL_CTES = {
    "pred": "SELECT gvkey, datadate, fyear, "
            + ", ".join(f"{e} AS {r}" for r, e in ratio_sql().items()) + ", gsector FROM lagged",
    "mpred": "SELECT pred.*, gdp.gdp_growth FROM pred JOIN gdp ON pred.fyear = gdp.year",
    "screened": f"SELECT * FROM mpred WHERE gsector IS NOT NULL AND ({present_sql(MPRED_COLS)}) >= 23",
    "firms": """
SELECT gvkey FROM link WHERE LPERMNO IN (SELECT PERMNO FROM delist)
UNION SELECT gvkey FROM rating""",
    "delist_def": f"""
SELECT PERMNO, {parse_ymd('DLSTDT')} AS DLSTDT, DLSTCD FROM delist
WHERE DLSTCD < 500 OR DLSTCD IN (560, 572, 574)""",
    "lk": f"""
SELECT gvkey, LPERMNO, LINKDT,
  CASE WHEN le = maxend THEN DATE '2024-12-31' ELSE le END AS LINKENDDT, n_cand
FROM (SELECT gvkey, LPERMNO, {parse_ymd('LINKDT')} AS LINKDT, le,
        max(le) OVER (PARTITION BY LPERMNO) AS maxend,
        count(*) OVER (PARTITION BY LPERMNO) AS n_cand
      FROM (SELECT *, CASE WHEN LINKENDDT = 'E' THEN DATE '2022-03-16'
                           ELSE {parse_ymd('LINKENDDT')} END AS le FROM link))""",
    "ev": "SELECT *, row_number() OVER () AS rid FROM delist_def",
    "res": """
SELECT ev.PERMNO, ev.DLSTDT, ev.DLSTCD, lk.gvkey FROM ev JOIN lk ON ev.PERMNO = lk.LPERMNO AND lk.n_cand = 1
UNION ALL
SELECT PERMNO, DLSTDT, DLSTCD, gvkey FROM (
  SELECT ev.PERMNO, ev.DLSTDT, ev.DLSTCD, lk.gvkey,
         row_number() OVER (PARTITION BY ev.rid ORDER BY lk.LINKDT, lk.gvkey) AS rn
  FROM ev JOIN lk ON ev.PERMNO = lk.LPERMNO AND lk.n_cand > 1
   AND lk.LINKDT < ev.DLSTDT AND lk.LINKENDDT > ev.DLSTDT) WHERE rn = 1""",
    "rdef": """
SELECT gvkey, datadate, splticrm FROM (
  SELECT gvkey, CAST(strptime(datadate, '%Y/%m/%d') AS DATE) AS datadate, splticrm,
         row_number() OVER (PARTITION BY gvkey ORDER BY strptime(datadate, '%Y/%m/%d')) AS rn
  FROM rating WHERE splticrm = 'D') WHERE rn = 1""",
}


def event_cte(base: str) -> str:
    win = "{a}.gvkey = b.gvkey AND {d} > b.datadate AND {d} < b.datadate + INTERVAL 1 YEAR"
    return f"""
SELECT b.*,
  (SELECT max(r.datadate) FROM rdef r WHERE {win.format(a='r', d='r.datadate')}) AS rating_date,
  (SELECT max(x.DLSTDT) FROM res x WHERE {win.format(a='x', d='x.DLSTDT')}) AS delist_date
FROM {base} b"""


def label_cte(src: str) -> str:
    return f"""
SELECT *, CASE WHEN rating_date IS NOT NULL OR delist_date IS NOT NULL THEN 1 ELSE 0 END AS "default",
  least(rating_date, delist_date) AS default_date FROM {src}"""


def first_default_cte(src: str) -> str:
    return f"""
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY gvkey, "default" ORDER BY datadate, fyear) AS rn FROM {src})
WHERE "default" = 0 OR rn = 1"""


def entry_a_ctes() -> dict[str, str]:
    c = dict(BASE_CTES)
    c.update(PANEL_CTES)
    c["kept_in"] = "SELECT * FROM screened WHERE gvkey IN (SELECT gvkey FROM firms)"
    c["ewin"] = event_cte("kept_in")
    c["labelled"] = label_cte("ewin")
    c["first"] = first_default_cte("labelled")
    c["kept"] = ("SELECT * EXCLUDE (rating_date, delist_date) FROM first "
                 "WHERE gsector IS NULL OR gsector NOT IN (40, 55, 60)")
    for r in RATIOS:
        c[f"b_{r}"] = f"""
SELECT max(CASE WHEN rk = k THEN v END) AS lo, max(CASE WHEN rk = n - 1 - k THEN v END) AS hi FROM (
  SELECT {r} AS v, row_number() OVER (ORDER BY {r}) - 1 AS rk, count(*) OVER () AS n,
         CAST(floor({lit(0.05)} * count(*) OVER ()) AS BIGINT) AS k
  FROM kept WHERE {r} IS NOT NULL)"""
    clip = ", ".join(
        f"CASE WHEN {r} < (SELECT lo FROM b_{r}) THEN (SELECT lo FROM b_{r}) "
        f"WHEN {r} > (SELECT hi FROM b_{r}) THEN (SELECT hi FROM b_{r}) ELSE {r} END AS {r}"
        for r in RATIOS)
    c["wins"] = f"SELECT * REPLACE ({clip}) FROM kept"
    c["panel"] = "SELECT * EXCLUDE (P2) FROM wins"
    return c


def with_ctes(ctes: dict[str, str], body: str, needed: list[str] | None = None) -> str:
    """``WITH`` clause of the named CTEs (in definition order) plus ``body``."""
    names = list(ctes) if needed is None else [n for n in ctes if n in set(needed)]
    return "WITH " + ",\n".join(f"{n} AS ({ctes[n]})" for n in names) + "\n" + body


# --------------------------------------------------------------------------- entry C

def simpson_cdf(x: str, n: int = 2000) -> str:
    """Normal CDF by integration: 0.5 + Simpson's rule of the density on [0, x]."""
    h = f"(({x}) / {n})"
    return (f"({lit(0.5)} + {h} / 3.0 * list_sum(list_transform(range(0, {n + 1}), lambda i: "
            f"(CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * "
            f"exp(-0.5 * (i * {h}) * (i * {h})))) / sqrt(2 * pi()))")


def newton_ctes(source: str, prefix: str, iters: int = 16, n: int = 2000) -> dict[str, str]:
    """Normal quantiles ``x`` of the ``p`` of a CTE, by Newton's method on the integral."""
    steps = {f"{prefix}0": f"SELECT p, CAST(0.0 AS DOUBLE) AS x FROM {source}"}
    for k in range(1, iters + 1):
        steps[f"{prefix}{k}"] = (f"SELECT p, x - ({simpson_cdf('x', n)} - p) / (exp(-0.5 * x * x) / sqrt(2 * pi())) "
                                 f"AS x FROM {prefix}{k - 1}")
    return steps


def capital_ctes(src: str) -> dict[str, str]:
    """Capital per row of ``src`` (needs pd, LGD, Maturity, FacilityAmt, ExchangeRate). The
    normal distribution is integrated and inverted once per distinct PD, with no
    code or coefficients in common with the Spark side."""
    n = 4000
    return {
        "pds": f"""SELECT DISTINCT pd AS p FROM {src} WHERE pd >= {lit(2.93e-6)} AND pd < {lit(0.5)}
UNION SELECT {lit(0.999)} AS p""",
        **newton_ctes("pds", "q", 14, n),
        "cp1": f"""SELECT p, x / sqrt({lit(1.0)} - r) + sqrt(r / ({lit(1.0)} - r)) * (SELECT x FROM q14 WHERE p = {lit(0.999)}) AS xin,
  pow({lit(0.11852)} - {lit(0.05478)} * ln(p), 2) AS b FROM (
  SELECT *, {lit(0.12)} * w + {lit(0.24)} * ({lit(1.0)} - w) AS r FROM (
    SELECT *, ({lit(1.0)} - exp({lit(-50.0)} * p)) / ({lit(1.0)} - exp({lit(-50.0)})) AS w FROM q14))""",
        "cp2": f"SELECT p, b, {simpson_cdf('xin', n)} AS phi FROM cp1",
        "cpx": f"""SELECT s.*,
  CASE WHEN pd IS NULL THEN NULL WHEN pd < {lit(2.93e-6)} THEN {lit(0.0)} WHEN pd >= {lit(0.5)} THEN {lit(0.0)}
  ELSE (LGD * phi - LGD * pd) * ({lit(1.0)} + ({dbl('Maturity')} / {lit(12.0)} - {lit(2.5)}) * b)
       / ({lit(1.0)} - {lit(1.5)} * b) * {lit(1.25)} * {lit(1.06)} * FacilityAmt * ExchangeRate * {lit(0.08)}
  END AS CR FROM {src} s LEFT JOIN cp2 ON s.pd = cp2.p""",
    }


MODELS = ["lr", "lasso", "svm", "rf", "gb"]
LGD_PAIRS = [(10, 0.59), (15, 0.41), (20, 0.38), (25, 0.40), (30, 0.32), (35, 0.28), (45, 0.32), (50, 0.34)]


def entry_c_ctes() -> dict[str, str]:
    c = {k: BASE_CTES[k] for k in ("items", "fy", "sect")}
    pd_cols = []
    for s, m in enumerate(MODELS):
        pdx = f"{dbl(f'(s.gvkey * 7 + f.fyear * 13 + {17 * s}) % 600')} / {lit(1000.0)}"
        pd_cols.append(f"CASE WHEN {pdx} >= {lit(0.25)} THEN 1 ELSE 0 END AS pred_{m}, {pdx} AS pd_{m}")
    c["scores"] = f"""
SELECT f.gvkey, f.datadate, f.fyear,
  CASE WHEN (f.gvkey + f.fyear) % 11 = 0 THEN 1 ELSE 0 END AS "default", s2.gsector,
  {', '.join(x.replace('s.gvkey', 'f.gvkey') for x in pd_cols)}
FROM fy f LEFT JOIN sect s2 ON f.gvkey = s2.gvkey"""
    c["loans"] = f"""
SELECT l_orderkey AS FacilityID, l_linestatus AS BorrowerCompanyID,
  CAST(l_shipdate AS DATE) AS FacilityStartDate, l_extendedprice AS FacilityAmt,
  {lit(1.0)} + l_tax AS ExchangeRate, l_quantity AS Maturity, l_returnflag AS LoanType,
  l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey FROM lineitem"""
    c["deal"] = "SELECT o_orderkey AS facid, o_orderstatus AS bcoid, o_custkey AS gvkey FROM orders"
    c["floans"] = """
SELECT l.*, d.gvkey FROM loans l JOIN deal d ON l.FacilityID = d.facid AND l.BorrowerCompanyID = d.bcoid"""
    c["quotes"] = f"""
SELECT l_orderkey AS FacilityID,
  CASE l_linenumber % 3 WHEN 0 THEN 'LIBOR' WHEN 1 THEN 'Fixed Rate' ELSE 'Prime' END AS BaseRate,
  round(l_discount * 10000) AS MinBps,
  CASE WHEN l_tax = 0 THEN NULL ELSE round(l_discount * 10000) + round(l_tax * 10000) END AS MaxBps,
  l_linenumber AS line, l_partkey AS partkey, l_suppkey AS suppkey,
  CAST(l_shipdate AS DATE) AS quoted, l_extendedprice AS amt FROM lineitem"""
    c["rates"] = f"""
SELECT * EXCLUDE (rn),
  CASE WHEN BaseRate = 'LIBOR' THEN (MinBps + MaxBps) / {lit(2.0)} / {lit(10000.0)} + {lit(0.0093457)}
       WHEN BaseRate = 'Fixed Rate' THEN (MinBps + MaxBps) / {lit(2.0)} / {lit(10000.0)} END AS rate
FROM (SELECT *, row_number() OVER (PARTITION BY FacilityID ORDER BY line, partkey, suppkey, quoted, amt,
        MinBps NULLS FIRST, MaxBps NULLS FIRST) AS rn
      FROM quotes WHERE BaseRate IN ('LIBOR', 'Fixed Rate')) WHERE rn = 1"""
    c["m"] = """
SELECT fl.*, (SELECT max(s.datadate) FROM scores s WHERE s.gvkey = fl.gvkey AND s.datadate < fl.FacilityStartDate
              AND s.datadate + INTERVAL 1 YEAR > fl.FacilityStartDate) AS md FROM floans fl"""
    score_cols = ", ".join(f"s.pred_{m}, s.pd_{m}" for m in MODELS)
    c["asofm"] = f"""
SELECT m.* EXCLUDE (md), s.datadate, s.fyear, s."default", s.gsector, {score_cols}
FROM m JOIN scores s ON s.gvkey = m.gvkey AND s.datadate = m.md"""
    c["rated"] = """
SELECT a.*, r.rate FROM asofm a LEFT JOIN rates r ON a.FacilityID = r.FacilityID
WHERE r.rate IS NOT NULL AND a.Maturity IS NOT NULL"""
    lgd_case = " ".join(f"WHEN {g} THEN {lit(v)}" for g, v in LGD_PAIRS)
    c["lgd"] = f"SELECT *, COALESCE(CASE gsector {lgd_case} END, {lit(0.0)}) AS LGD FROM rated"
    c["long"] = " UNION ALL ".join(
        f"SELECT * EXCLUDE ({', '.join(f'pred_{x}, pd_{x}' for x in MODELS)}), '{m}' AS model, "
        f"CAST(pred_{m} AS INTEGER) AS pred, pd_{m} AS pd FROM lgd" for m in MODELS)
    c.update(capital_ctes("long"))
    return c
