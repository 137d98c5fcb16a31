import contextlib
import io
import math
import re
import statistics
import tempfile

from pyspark.sql import functions as F

from riskloom.functions.capital import with_capital, with_risk_weight
from riskloom.functions.numeric import fround, ieee_div, ln_ieee, normal_cdf, normal_ppf, sub, with_normal_ppf
from riskloom.operators import capital as cap

INF = float("inf")


def test_ieee_division_edges(spark):
    rows = [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (None, 0.0), (1.0, None), (6.0, 3.0), (INF, INF)]
    df = spark.createDataFrame(rows, "n double, d double")
    got = [r.q for r in df.select(ieee_div("n", "d").alias("q")).collect()]
    assert got == [INF, -INF, None, None, None, 2.0, None]


def test_ln_and_sub(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (math.e,), (None,)], "x double")
    assert [r.y for r in df.select(ln_ieee("x").alias("y")).collect()] == [-INF, None, 1.0, None]
    d = spark.createDataFrame([(INF, INF), (3.0, 1.0)], "a double, b double")
    assert [r.y for r in d.select(sub("a", "b").alias("y")).collect()] == [None, 2.0]


def test_normal_cdf_against_erfc(spark):
    xs = [-9.0, -5.5, -2.0, -0.3, 0.0, 0.7, 3.3, 8.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for r in df.select("x", normal_cdf("x").alias("c")).collect():
        assert abs(r.c - 0.5 * math.erfc(-r.x / math.sqrt(2))) < 1e-15


def test_normal_ppf_against_stdlib(spark):
    nd = statistics.NormalDist()
    ps = [2.95e-6, 1e-4, 0.01, 0.3, 0.5, 0.77, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for r in df.select("p", normal_ppf("p").alias("q")).collect():
        assert abs(r.q - nd.inv_cdf(r.p)) < 1e-10
    edge = spark.createDataFrame([(0.0,), (1.0,), (1.5,)], "p double").select(normal_ppf("p").alias("q"))
    assert [r.q for r in edge.collect()] == [-INF, INF, None]


def test_risk_weight_check_values(spark):
    cases = [(0.001, 0.4, 36.0, 0.031390431752), (0.01, 0.4, 60.0, 0.116880312046),
             (0.1, 0.59, 60.0, 0.308503715849), (0.4999, 0.28, 12.0, 0.138434710471)]
    df = spark.createDataFrame([c[:3] for c in cases], "pd double, lgd double, m double")
    got = [r.RW for r in with_risk_weight(df, "pd", "lgd", "m").collect()]
    for g, c in zip(got, cases):
        assert abs(g - c[3]) < 1e-11


def test_capital_outside_range_and_missing(spark):
    rows = [(0.0,), (2.9e-6,), (0.5,), (0.7,), (None,), (0.01,)]
    df = spark.createDataFrame(rows, "pd double").select(
        "pd", F.lit(0.4).alias("lgd"), F.lit(36.0).alias("m"), F.lit(1e6).alias("amt"), F.lit(1.0).alias("fx"))
    got = [r.CR for r in with_capital(df, "pd", "lgd", "m", "amt", "fx").collect()]
    assert got[:4] == [0.0, 0.0, 0.0, 0.0] and got[4] is None and got[5] > 0


def test_capital_plan_stays_in_codegen(spark):
    df = spark.range(10).select((F.col("id") / 100.0 + 0.001).alias("pd"), F.lit(0.4).alias("lgd"),
                                F.lit(36.0).alias("m"), F.lit(1.0).alias("a"), F.lit(1.0).alias("f"))
    plan = with_capital(df, "pd", "lgd", "m", "a", "f")._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_fround_half_away_from_zero(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (0.125,), (INF,), (None,)], "x double")
    assert [r.y for r in df.select(fround("x", 0).alias("y")).collect()][:2] == [3.0, -3.0]
    assert [r.y for r in df.select(fround("x", 2).alias("y")).collect()][2:] == [0.13, INF, None]


def test_fround_of_large_values(spark):
    values = [1e10, 1e12, -5e11, 1e17, float("inf"), 2.5, -2.5, 0.1234567894999, 123456.7890123456]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r.y for r in df.select(fround("x", 9).alias("y")).collect()]
    assert got[:5] == values[:5]
    assert got[5:] == [2.5, -2.5, 0.123456789, 123456.789012346]


def test_capital_is_compiled_by_the_jvm(spark):
    """HotSpot interprets methods over 8,000 bytes for ever, so the generated code has to stay below."""
    path = tempfile.mkdtemp(prefix="riskloom-capital-") + "/t"
    spark.range(10).selectExpr("id / 20.0D AS pd_lr", "0 AS pred_lr", "id / 30.0D AS pd_gb", "1 AS pred_gb",
                               "0.4D AS LGD", "36.0D AS Maturity", "2.0D AS FacilityAmt", "1.0D AS ExchangeRate",
                               "0.05D AS rate", "CAST(id % 2 AS INT) AS default").write.parquet(path)
    long = cap.add_capital(cap.scores_long(spark.read.parquet(path), models=["lr", "gb"]))
    spark.conf.set("spark.sql.adaptive.enabled", "false")      # an adaptive plan has no code yet
    try:
        for of in (cap.capital_table, cap.eco_loss):
            text = io.StringIO()
            with contextlib.redirect_stdout(text):
                of(long).explain("codegen")
            sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_staged_quantile_equals_the_expression(spark):
    ps = [None, float("nan"), -1.0, 0.0, 1e-9, 2.95e-6, 0.02424, 0.02425, 0.3, 0.5, 0.97575, 0.97576, 0.9999, 1.0, 2.0]
    rows = with_normal_ppf(spark.createDataFrame([(p,) for p in ps], "p double"), "p", "q").withColumn(
        "one", normal_ppf("p"))
    assert rows.columns == ["p", "q", "one"]
    assert rows.where(~F.col("q").eqNullSafe(F.col("one"))).count() == 0
