import random

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskloom.operators import models as md
from riskloom.operators.attribution import gbt_attribution, linear_attribution, mean_abs_ranking


def test_treeshap_sums_to_log_odds(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append((i, a, b, c, 1.0 if a + 0.5 * b + 0.1 * rng.random() > 0.9 else 0.0))
    df = md.assemble(spark.createDataFrame(rows, "k long, a double, b double, c double, label double"),
                     ["a", "b", "c"])
    m = GBTClassifier(maxIter=8, maxDepth=3, seed=0).fit(df)
    attr = gbt_attribution(m, df, "k", ["a", "b", "c"])
    sums = {r.k: (r.s, r.base) for r in attr.groupBy("k").agg(F.sum("phi").alias("s"), F.first("base").alias("base")).collect()}
    raw = {r.k: 2.0 * r.m for r in m.transform(df).select("k", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    assert len(sums) == 400
    for k, (s, base) in sums.items():
        assert abs(s + base - raw[k]) < 1e-9
    top = [r.feature for r in mean_abs_ranking(attr, 2).collect()]
    assert "c" not in top


def test_linear_attribution_sums_to_log_odds(spark):
    rng = random.Random(3)
    rows = [(i, rng.gauss(0, 1), rng.gauss(2, 3), float(rng.random() < 0.5)) for i in range(80)]
    df = md.assemble(spark.createDataFrame(rows, "k long, a double, b double, label double").coalesce(1), ["a", "b"])
    m = md.fit(df, "lr", {})
    attr = linear_attribution(m.model, df.where("k < 10"), "k", ["a", "b"], background=df)
    assert attr.columns == ["k", "feature", "value", "phi", "base"] and attr.count() == 20
    assert "Python" not in attr._jdf.queryExecution().executedPlan().toString()
    raw = {r.k: r.m for r in m.predict(df).select("k", vector_to_array("rawPrediction")[1].alias("m")).collect()}
    for r in attr.groupBy("k").agg((F.sum("phi") + F.first("base")).alias("s")).collect():
        assert abs(r.s - raw[r.k]) < 1e-9
    mean = sum(r[1] for r in rows) / 80
    for r in attr.where("feature = 'a'").collect():
        assert abs(r.phi - m.model.coefficients[0] * (rows[r.k][1] - mean)) < 1e-12
