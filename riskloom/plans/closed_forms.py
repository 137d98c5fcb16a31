"""Model queries whose result has a closed form, so that SQL can check them.

* A logit without intercept on disjoint sector dummies: the coefficient of a
  sector is ``ln(p / (1 - p))`` of its default share and the standard error
  ``sqrt(1 / (n p (1 - p)))``.
* A gradient-boosted model of one tree of depth one on a 0/1 feature: its two
  leaves are the group means of the label coded -1 and 1, so predictions,
  importance, attributions and cross-validated metrics follow from group counts.
  So do a search among such models, a forest of one such tree, and the logistic
  model on that feature. A tree of depth two on two 0/1 features has the group
  means of their combinations as leaves, and attributions from those.
* Platt's sigmoid by Newton steps, which SQL takes as well.
* Random features of kernels whose draws are md5 hashes.
* Linear models at their optimum: the conditions of optimality hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import fround
from ..operators import attribution as at
from ..operators import models as md
from ..operators import prep
from ..operators.evaluate import classification_metrics
from ..session import materialize
from ..sources import io
from . import modeling
from . import oracle as o
from . import testbed as tb
from .catalog import A, C, W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def deco(fn: Query) -> Query:
        QUERIES[name], SQL[name] = fn, sql
        return fn
    return deco


# --------------------------------------------------------------------------- logit on sectors

def _sector_logit(spark: SparkSession, sf: str) -> md.Logit:
    rows = tb.scores(spark, sf).where(F.col("gsector").isNotNull()).select(
        "gsector", F.col("default").cast("double").alias("label"))
    levels = prep.observed_levels(rows, "gsector")
    names = [f"gs_{v}" for v in levels]
    hot = prep.one_hot(rows, "gsector", levels, drop_first=False, prefix="gs")
    return md.Logit(md.assemble(materialize(hot, "sector-dummies"), names), names)


_SECTORS = """SELECT gsector, count(*) AS n, sum("default") AS k, sum("default") / CAST(count(*) AS DOUBLE) AS p
FROM scores WHERE gsector IS NOT NULL GROUP BY gsector"""
_Z = o.lit(1.959963984540054)


@query("logit_sectors", o.with_ctes({**C, "g": _SECTORS, "t": "SELECT gsector, ln(p / (1 - p)) AS c, sqrt(1 / (n * p * (1 - p))) AS e FROM g"}, f"""
SELECT 'gs_' || gsector AS feature, {o.fround('c', 5)} AS coef, {o.fround('e', 5)} AS std_err, {o.fround('c / e', 4)} AS z,
  {o.fround(f'c - {_Z} * e', 4)} AS ci_low, {o.fround(f'c + {_Z} * e', 4)} AS ci_high FROM t""",
    [*C, "g", "t"]))
def q_logit_sectors(spark, sf):
    t = _sector_logit(spark, sf).table()
    return t.select("feature", *[fround(c, d).alias(c) for c, d in
                                 (("coef", 5), ("std_err", 5), ("z", 4), ("ci_low", 4), ("ci_high", 4))])


@query("logit_sectors_summary", o.with_ctes({**C, "g": _SECTORS}, f"""
SELECT CAST(sum(n) AS BIGINT) AS n_obs, count(*) - 1 AS df_model, {o.fround('sum(k * ln(p) + (n - k) * ln(1 - p))', 4)} AS llf,
  {o.fround('sum(k) * ln(sum(k) / CAST(sum(n) AS DOUBLE)) + (sum(n) - sum(k)) * ln(1 - sum(k) / CAST(sum(n) AS DOUBLE))', 4)} AS llnull
FROM g"""))
def q_logit_sectors_summary(spark, sf):
    s = _sector_logit(spark, sf).summary()
    return s.select("n_obs", "df_model", fround("llf", 4).alias("llf"), fround("llnull", 4).alias("llnull"))


# --------------------------------------------------------------------------- one split on one feature

STUMP = {"n_estimators": 1, "max_depth": 1}
FEATURES = ["short", "nothing"]
SHORT = 400


def _stump_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents: is the text short, is it good; folds as everywhere."""
    d = io.read_table(spark, sf, "documents").select("doc_id", (F.col("n_chars") < SHORT).cast("int").alias("short"))
    q = io.read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("double").alias("label"))
    rows = d.join(q, "doc_id").withColumn("nothing", F.lit(0))
    folded = materialize(prep.stratified_folds(rows, ["doc_id"], "label", 5, seed=0), "stump-rows")
    return md.assemble(md.sized(folded, len(FEATURES)), FEATURES)


_STUMP = {
    "x": f"""SELECT doc_id, CAST(n_chars < {SHORT} AS INTEGER) AS short, quality AS label,
  (row_number() OVER (PARTITION BY quality ORDER BY substr(md5('0:' || CAST(doc_id AS VARCHAR)), 1, 13), doc_id) - 1) % 5 AS fold
FROM documents JOIN labels USING (doc_id)""",
    "g": "SELECT short, avg(2.0 * label - 1.0) AS f FROM x GROUP BY short",
    "b": "SELECT 2 * avg(2.0 * label - 1.0) AS base FROM x",
}


@query("stump_scores", o.with_ctes(_STUMP, f"""
SELECT doc_id, CAST(f > 0 AS INTEGER) AS pred, {o.fround('1 / (1 + exp(-2 * f))', 9)} AS pd FROM x JOIN g USING (short)"""))
def q_stump_scores(spark, sf):
    rows = _stump_rows(spark, sf)
    return md.fit(rows, "gb", STUMP).score(rows).select("doc_id", "pred", fround("pd", 9).alias("pd"))


def _metrics_sql(source: str, by: str) -> str:
    tp, fp, fn, tn = (f"sum(CASE WHEN label = {a} AND pred = {b} THEN 1 ELSE 0 END)" for a, b in ((1, 1), (0, 1), (1, 0), (0, 0)))
    ratio = lambda n, d: f"COALESCE(({n}) / CAST(nullif({d}, 0) AS DOUBLE), 0)"
    return f"""SELECT {by}, {ratio(f'{tp} + {tn}', 'count(*)')} AS accuracy, {ratio(tp, f'{tp} + {fp}')} AS precision,
  {ratio(tp, f'{tp} + {fn}')} AS recall, {ratio(f'5 * {tp}', f'5 * {tp} + 4 * {fn} + {fp}')} AS f_beta
FROM ({source}) GROUP BY ALL"""


_METRICS = ("accuracy", "precision", "recall", "f_beta")


@query("stump_metrics", o.with_ctes({**_STUMP, "m": _metrics_sql(
    "SELECT 'gb' AS model, label, CAST(f > 0 AS INTEGER) AS pred FROM x JOIN g USING (short)", "model")},
    "SELECT model, " + ", ".join(f"{o.fround(c, 9)} AS {c}" for c in _METRICS) + " FROM m"))
def q_stump_metrics(spark, sf):
    rows = _stump_rows(spark, sf)
    preds = md.fit(rows, "gb", STUMP).score(rows).select(F.lit("gb").alias("model"), F.col("label").cast("int").alias("label"), "pred")
    return classification_metrics(preds).select("model", *[fround(c, 9).alias(c) for c in _METRICS])


@query("stump_cv", o.with_ctes({
    **_STUMP,
    "k": "SELECT unnest(range(5)) AS part",
    "gk": "SELECT part, short, avg(2.0 * label - 1.0) AS f FROM k JOIN x ON x.fold <> k.part GROUP BY part, short",
    "ak": "SELECT part, avg(2.0 * label - 1.0) AS f FROM k JOIN x ON x.fold <> k.part GROUP BY part",
    "p": """SELECT x.fold, x.label, CAST(COALESCE(gk.f, ak.f) > 0 AS INTEGER) AS pred FROM x
JOIN ak ON ak.part = x.fold LEFT JOIN gk ON gk.part = x.fold AND gk.short = x.short""",
    "m": _metrics_sql("SELECT * FROM p", "fold")},
    "SELECT 'gb' AS model, " + ", ".join(f"{o.fround(f'avg({c})', 9)} AS {c}" for c in _METRICS) + " FROM m"))
def q_stump_cv(spark, sf):
    m = md.cv_metrics(_stump_rows(spark, sf), "gb", STUMP)
    return m.select("model", *[fround(c, 9).alias(c) for c in _METRICS])


@query("stump_importance", """
SELECT 'short' AS feature, CAST(1.0 AS DOUBLE) AS importance UNION ALL SELECT 'nothing', CAST(0.0 AS DOUBLE)""")
def q_stump_importance(spark, sf):
    return md.importances(md.fit(_stump_rows(spark, sf), "gb", STUMP), FEATURES)


def _stump_attribution(spark: SparkSession, sf: str) -> DataFrame:
    rows = _stump_rows(spark, sf)
    return at.gbt_attribution(md.fit(rows, "gb", STUMP).model, rows, "doc_id", FEATURES)


@query("stump_attribution", o.with_ctes(_STUMP, f"""
SELECT doc_id, 'short' AS feature, CAST(short AS DOUBLE) AS value, {o.fround('2 * f - base', 9)} AS phi, {o.fround('base', 9)} AS base
FROM x JOIN g USING (short), b
UNION ALL SELECT doc_id, 'nothing', CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), {o.fround('base', 9)} FROM x, b"""))
def q_stump_attribution(spark, sf):
    a = _stump_attribution(spark, sf)
    return a.select("doc_id", "feature", "value", fround("phi", 9).alias("phi"), fround("base", 9).alias("base"))


@query("stump_ranking", o.with_ctes(_STUMP, f"""
SELECT 'short' AS feature, {o.fround('avg(abs(2 * f - base))', 9)} AS mean_abs_phi FROM x JOIN g USING (short), b
UNION ALL SELECT 'nothing', CAST(0 AS DOUBLE)"""))
def q_stump_ranking(spark, sf):
    r = at.mean_abs_ranking(_stump_attribution(spark, sf))
    return r.select("feature", fround("mean_abs_phi", 9).alias("mean_abs_phi"))


@query("stump_probability", o.with_ctes(_STUMP, f"""
SELECT doc_id, {o.fround('1 / (1 + exp(-base))', 9)} AS expected_pd, {o.fround('1 / (1 + exp(-2 * f))', 9)} AS pd
FROM x JOIN g USING (short), b"""))
def q_stump_probability(spark, sf):
    p = at.probabilities(_stump_attribution(spark, sf), "doc_id")
    return p.select("doc_id", fround("expected_pd", 9).alias("expected_pd"), fround("pd", 9).alias("pd"))


# --------------------------------------------------------------------------- search, forest, logistic model

# Draws whose fits are known: a leaf share that the smaller group does not reach forbids the split.
_DRAWS = [{**STUMP, "min_samples_leaf": 0.0}, {**STUMP, "min_samples_leaf": 0.49}, {**STUMP, "learning_rate": 1.0},
          {**STUMP, "min_samples_leaf": 0.05}, {**STUMP, "min_samples_leaf": 0.2}]


@query("stump_search", o.with_ctes({
    **_STUMP,
    "d": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}, {o.lit(float(p.get('min_samples_leaf', 0.0)))})" for i, p in enumerate(_DRAWS)) + ") v(draw, leaf)",
    "k": "SELECT unnest(range(5)) AS part",
    "gk": "SELECT part, short, count(*) AS n, avg(2.0 * label - 1.0) AS f FROM k JOIN x ON x.fold <> k.part GROUP BY part, short",
    "ak": """SELECT part, sum(n) AS n, CASE WHEN count(*) = 2 THEN min(n) ELSE 0 END AS least, sum(n * f) / sum(n) AS f
FROM gk GROUP BY part""",
    "p": """SELECT draw, x.fold, x.label, CAST(CASE WHEN ak.least > 0 AND ak.least >= leaf * ak.n THEN gk.f ELSE ak.f END > 0 AS INTEGER) AS pred
FROM d CROSS JOIN x JOIN ak ON ak.part = x.fold LEFT JOIN gk ON gk.part = x.fold AND gk.short = x.short""",
    "m": _metrics_sql("SELECT * FROM p", "draw, fold"),
    "t": "SELECT draw, avg(f_beta) AS mean FROM m GROUP BY draw"}, f"""
SELECT draw, CAST(fold AS INTEGER) AS fold, {o.fround('f_beta', 9)} AS f_beta, {o.fround('mean', 9)} AS mean_f_beta,
  draw = (SELECT draw FROM t ORDER BY round(mean, 12) DESC, draw LIMIT 1) AS best FROM m JOIN t USING (draw)"""))
def q_stump_search(spark, sf):
    t = md.search_table(_stump_rows(spark, sf), "gb", _DRAWS)
    return t.select("draw", "fold", fround("f_beta", 9).alias("f_beta"), fround("mean_f_beta", 9).alias("mean_f_beta"), "best")


_LABEL_MEANS = {"x": _STUMP["x"], "h": "SELECT short, avg(CAST(label AS DOUBLE)) AS p FROM x GROUP BY short"}
# Half of the labels turned: Spark merges leaves that predict the same class.
_TURNED = {
    "x": """SELECT doc_id, doc_id % 2 AS even, CASE WHEN doc_id % 2 = 0 THEN quality ELSE 1 - quality END AS label
FROM documents JOIN labels USING (doc_id)""",
    "h": "SELECT even, avg(CAST(label AS DOUBLE)) AS p FROM x GROUP BY even",
}


@query("forest_stump", o.with_ctes(_TURNED, f"""
SELECT doc_id, CAST(p > 0.5 AS INTEGER) AS pred, {o.fround('p', 9)} AS pd FROM x JOIN h USING (even)"""))
def q_forest_stump(spark, sf):
    """A forest of one tree of depth one, without bootstrap."""
    even = (F.col("doc_id") % 2).cast("int")
    rows = _stump_rows(spark, sf).drop("features").withColumn("even", even).withColumn(
        "label", F.when(even == 0, F.col("label")).otherwise(1 - F.col("label")))
    rows = md.assemble(rows, ["even", "nothing"])
    model = md.fit(rows, "rf", {**STUMP, "bootstrap": False, "subset": "all"})
    return model.score(rows).select("doc_id", "pred", fround("pd", 9).alias("pd"))


_LOGIT = {**_LABEL_MEANS, "c": """SELECT ln(a.p / (1 - a.p)) AS b0, ln(b.p / (1 - b.p)) - ln(a.p / (1 - a.p)) AS b1,
  (SELECT avg(CAST(short AS DOUBLE)) FROM x) AS mean FROM h a JOIN h b ON a.short = 0 AND b.short = 1"""}


def _stump_logit(spark: SparkSession, sf: str) -> tuple[md.FittedModel, DataFrame]:
    rows = _stump_rows(spark, sf)
    one = md.assemble(rows.drop("features"), ["short"])
    return md.fit(one, "lr", {"tol": 1e-12}), one


@query("logistic_binary", o.with_ctes(_LOGIT, f"""
SELECT doc_id, {o.fround('p', 5)} AS pd, CAST(p > 0.5 AS INTEGER) AS pred FROM x JOIN h USING (short)"""))
def q_logistic_binary(spark, sf):
    """The unpenalised logistic model on one 0/1 feature: its probabilities are the group shares."""
    model, rows = _stump_logit(spark, sf)
    return model.score(rows).select("doc_id", fround("pd", 5).alias("pd"), "pred")


@query("linear_shap", o.with_ctes(_LOGIT, f"""
SELECT doc_id, 'short' AS feature, CAST(short AS DOUBLE) AS value, {o.fround('b1 * (short - mean)', 4)} AS phi,
  {o.fround('b0 + b1 * mean', 4)} AS base FROM x, c"""))
def q_linear_shap(spark, sf):
    model, rows = _stump_logit(spark, sf)
    a = at.linear_attribution(model.model, rows, "doc_id", ["short"])
    return a.select("doc_id", "feature", "value", fround("phi", 4).alias("phi"), fround("base", 4).alias("base"))


@query("linear_optimum", "SELECT model, TRUE AS optimal FROM (VALUES ('lr'), ('lasso')) v(model)")
def q_linear_optimum(spark, sf):
    """Whether the linear models of entry B meet the conditions of optimality within ``modeling.GAP``."""
    t = modeling.optimality(modeling.run_of(spark, sf))
    return t.groupBy("model").agg((F.max("gap") <= modeling.GAP).alias("optimal"))


# --------------------------------------------------------------------------- two levels of a tree

TWO = ["short", "even"]
_TWO = {
    "x": f"""SELECT doc_id, CAST(n_chars < {SHORT} AS INTEGER) AS a, CAST(doc_id % 2 AS INTEGER) AS b, 2.0 * quality - 1.0 AS y
FROM documents JOIN labels USING (doc_id)""",
    "t": "SELECT avg(y) AS f, CAST(count(*) AS DOUBLE) AS n FROM x",
    "ga": "SELECT a, avg(y) AS f, count(*) AS n FROM x GROUP BY a",
    "gb": "SELECT b, avg(y) AS f, count(*) AS n FROM x GROUP BY b",
    "gab": "SELECT a, b, avg(y) AS f FROM x GROUP BY a, b",
    # the root is the feature that explains more, the first of equals
    "r": "SELECT (SELECT sum(n * f * f) FROM ga) >= (SELECT sum(n * f * f) FROM gb) AS root_a",
    # leaves of all combinations, and what the tree expects when only one feature is known
    "l": """SELECT ga.a, gb.b, COALESCE(gab.f, CASE WHEN root_a THEN ga.f ELSE gb.f END) AS f, ga.f AS fa, gb.f AS fb,
  ga.n / t.n AS pa, gb.n / t.n AS pb, root_a, t.f AS f0
FROM ga CROSS JOIN gb CROSS JOIN r CROSS JOIN t LEFT JOIN gab ON gab.a = ga.a AND gab.b = gb.b""",
    "e": """SELECT *, CASE WHEN root_a THEN fa ELSE sum(pb * f) OVER (PARTITION BY a) END AS ea,
  CASE WHEN root_a THEN sum(pa * f) OVER (PARTITION BY b) ELSE fb END AS eb FROM l""",
}


@query("tree_shap", o.with_ctes(_TWO, f"""
SELECT doc_id, 'short' AS feature, CAST(x.a AS DOUBLE) AS value, {o.fround('(e.ea - e.f0) + (e.f - e.eb)', 9)} AS phi,
  {o.fround('2 * e.f0', 9)} AS base FROM x JOIN e ON x.a = e.a AND x.b = e.b
UNION ALL
SELECT doc_id, 'even', CAST(x.b AS DOUBLE), {o.fround('(e.eb - e.f0) + (e.f - e.ea)', 9)}, {o.fround('2 * e.f0', 9)}
FROM x JOIN e ON x.a = e.a AND x.b = e.b"""))
def q_tree_shap(spark, sf):
    """TreeSHAP on a boosted model of one tree with two levels on two features."""
    rows = _stump_rows(spark, sf).drop("features", "nothing").withColumn("even", (F.col("doc_id") % 2).cast("int"))
    rows = md.assemble(rows, TWO)
    model = md.fit(rows, "gb", {"n_estimators": 1, "max_depth": 2}).model
    a = at.gbt_attribution(model, rows, "doc_id", TWO)
    return a.select("doc_id", "feature", "value", fround("phi", 9).alias("phi"), fround("base", 9).alias("base"))


# --------------------------------------------------------------------------- Platt's sigmoid

_NEWTON_STEPS = 20


def _platt_ctes() -> dict[str, str]:
    ctes = {
        "d": "SELECT ln(n_chars + 1.0) AS m, quality AS y FROM documents JOIN labels USING (doc_id)",
        "n": "SELECT CAST(sum(y) AS DOUBLE) AS n1, CAST(sum(1 - y) AS DOUBLE) AS n0 FROM d",
        "s": "SELECT m, CASE WHEN y = 1 THEN (n1 + 1) / (n1 + 2) ELSE 1 / (n0 + 2) END AS t FROM d, n",
        "w0": "SELECT CAST(0 AS DOUBLE) AS a, ln((n1 + 1) / (n0 + 1)) AS b FROM n",
    }
    for i in range(_NEWTON_STEPS):
        ctes[f"q{i}"] = f"""SELECT any_value(a) AS a, any_value(b) AS b, sum((p - t) * m) AS ga, sum(p - t) AS gb,
  sum(p * (1 - p) * m * m) AS haa, sum(p * (1 - p) * m) AS hab, sum(p * (1 - p)) AS hbb
FROM (SELECT s.*, w{i}.a, w{i}.b, 1 / (1 + exp(-(w{i}.a * m + w{i}.b))) AS p FROM s, w{i})"""
        ctes[f"w{i + 1}"] = f"""SELECT a - (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a,
  b - (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM q{i}"""
    return ctes


@query("platt_table", o.with_ctes(_platt_ctes(), f"""
SELECT {o.fround('a', 6)} AS slope, {o.fround('b', 6)} AS intercept FROM w{_NEWTON_STEPS}"""))
def q_platt_table(spark, sf):
    """Slope and intercept of Platt's sigmoid of a label over a margin."""
    d = io.read_table(spark, sf, "documents").select("doc_id", F.log(F.col("n_chars") + 1.0).alias("m"))
    rows = d.join(io.read_table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    a, b = md.platt_fit(materialize(rows, "margins"))
    return spark.createDataFrame([(a, b)], "slope double, intercept double").select(
        fround("slope", 6).alias("slope"), fround("intercept", 6).alias("intercept"))


# --------------------------------------------------------------------------- kernels

_KERNEL = {"gamma": 0.5, "n_random": 8}
_KX = ["x0", "x1"]


def _u(tag: str, *place: str) -> str:
    text = " || ':' || ".join(["'0'", f"'{tag}'", *[f"CAST({p} AS VARCHAR)" for p in place]])
    return f"((CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0)"


_KERNEL_CTES = {
    "x": "SELECT p_partkey, p_size / 10.0 AS x0, p_retailprice / 1000.0 AS x1 FROM part",
    "j": f"SELECT unnest(range({_KERNEL['n_random']})) AS j",
    "i": "SELECT unnest(range(2)) AS i",
    "w": f"""SELECT i, j, sqrt(2 * {o.lit(_KERNEL['gamma'])}) * sqrt(-2 * ln({_u('r', 'i', 'j')})) * cos(2 * pi() * {_u('a', 'i', 'j')}) AS w
FROM i CROSS JOIN j""",
    "v": "SELECT unnest(range(2)) AS t",
    "g": f"SELECT t, i, j, CASE WHEN {_u('s', 't', 'i', 'j')} < 0.5 THEN -1.0 ELSE 1.0 END AS g FROM v CROSS JOIN i CROSS JOIN j",
    "f": f"""SELECT j.j, a.w AS w0, b.w AS w1, 2 * pi() * {_u('b', 'j.j')} AS b, p.g AS p0, q.g AS p1, r.g AS q0, s.g AS q1
FROM j JOIN w a ON a.j = j.j AND a.i = 0 JOIN w b ON b.j = j.j AND b.i = 1
JOIN g p ON p.j = j.j AND p.t = 0 AND p.i = 0 JOIN g q ON q.j = j.j AND q.t = 0 AND q.i = 1
JOIN g r ON r.j = j.j AND r.t = 1 AND r.i = 0 JOIN g s ON s.j = j.j AND s.t = 1 AND s.i = 1""",
}


@query("kernel_features", o.with_ctes(_KERNEL_CTES, f"""
SELECT p_partkey, 'rbf' AS kernel, CAST(j AS INTEGER) AS j, {o.fround('sqrt(2 / 8.0) * cos(x0 * w0 + x1 * w1 + b)', 8)} AS value FROM x CROSS JOIN f
UNION ALL
SELECT p_partkey, 'poly', CAST(j AS INTEGER), {o.fround(f"{o.lit(_KERNEL['gamma'])} * (x0 * p0 + x1 * p1) * (x0 * q0 + x1 * q1) / sqrt(8.0)", 8)}
FROM x CROSS JOIN f"""))
def q_kernel_features(spark, sf):
    """Random features of both kernels for two columns of every part."""
    p = io.read_table(spark, sf, "part").select(
        "p_partkey", (F.col("p_size") / 10.0).alias("x0"), (F.col("p_retailprice") / 1000.0).alias("x1"))
    rows, out = md.assemble(p, _KX), None
    for params in ({"kernel": "rbf", **_KERNEL}, {"kernel": "poly", "degree": 2, **_KERNEL}):
        z = md.kernel_map(params, rows)(rows).select(
            "p_partkey", F.lit(params["kernel"]).alias("kernel"), F.posexplode(vector_to_array("features")).alias("j", "value"))
        out = z if out is None else out.unionByName(z)
    return out.withColumn("value", fround("value", 8))


# --------------------------------------------------------------------------- rows of the scored panel

@query("scored_keys", W(f"""
SELECT gvkey, datadate, fyear, "default", m.model FROM (
  SELECT *, row_number() OVER (PARTITION BY "default" ORDER BY
            substr(md5('0:' || CAST(gvkey AS VARCHAR) || ':' || CAST(datadate AS VARCHAR)), 1, 13), gvkey, datadate) - 1 AS rk,
         count(*) OVER (PARTITION BY "default") AS n FROM panel) p
CROSS JOIN (VALUES {', '.join(f"('{m}')" for m in o.MODELS)}) m(model)
WHERE rk < floor({o.lit(0.2)} * n + 0.5)""", ctes=A))
def q_scored_keys(spark, sf):
    """Which firm-years every model scores (the scores themselves have no twin)."""
    return modeling.run_of(spark, sf).scored().select("gvkey", "datadate", "fyear", "default", "model")
