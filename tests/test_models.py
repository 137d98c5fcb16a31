"""Models on data with a planted signal, and the run that ties entry A, B and C."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import models as md
from riskloom.operators import prep, resample
from riskloom.plans import flows, modeling
from riskloom.plans.testbed import DriverInputs
from riskloom.sources import io
from riskloom.sources.schemas import INPUTS, RATIOS

SF = "/root/testdata/sf0.001"


def _planted(spark, n=120, seed=0, ring=False):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = rng.gauss(0, 1), rng.gauss(0, 1), rng.gauss(0, 1)
        y = (a * a + b * b < 1.2) if ring else (a - b + 0.3 * rng.gauss(0, 1) > 0)
        rows.append((i, a, b, c, 1.0 if y else 0.0))
    df = spark.createDataFrame(rows, "k long, a double, b double, c double, label double").coalesce(1)
    return md.assemble(prep.stratified_folds(df, ["k"], "label", 5, seed=1).coalesce(1).persist(), ["a", "b", "c"])


def _accuracy(model, df):
    return model.score(df).agg(F.avg((F.col("pred") == F.col("label")).cast("double"))).first()[0]


SMALL = {"lr": {"max_iter": 20}, "lasso": {"max_iter": 15}, "svm": {"max_iter": 10},
         "rf": {"n_estimators": 5, "max_depth": 3}, "gb": {"n_estimators": 3}}


def test_every_family_finds_a_planted_signal(spark):
    train, test = _planted(spark), _planted(spark, seed=1)
    for name in md.MODEL_NAMES:
        m = md.fit(train, name, SMALL[name])
        assert _accuracy(m, test) > 0.8, name
        p = m.score(test).agg(F.min("pd"), F.max("pd")).first()
        assert 0 <= p[0] < 0.4 and 0.6 < p[1] <= 1, name
        if name in ("lasso", "rf"):
            cv = md.cv_metrics(train, name, SMALL[name]).first()
            assert cv.model == name and cv.accuracy > 0.8


def test_kernels_see_what_a_line_cannot(spark):
    train, test = _planted(spark, n=300, ring=True), _planted(spark, n=300, seed=1, ring=True)

    def accuracy(**params):
        m = md.fit(train, "svm", {"C": 10.0, "max_iter": 20, "n_random": 64, **params}, probabilities=False)
        return m.predict(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]

    linear, rbf, poly = accuracy(), accuracy(kernel="rbf"), accuracy(kernel="poly", degree=2)
    assert rbf > 0.8 and poly > 0.8 and linear < 0.75
    with pytest.raises(ValueError):
        md.kernel_map({"kernel": "other"}, train)


def test_random_features_approach_the_kernels(spark):
    df = _planted(spark, n=40)
    x = np.array([r.features.toArray() for r in df.collect()])
    gamma = 1 / (3 * x.var())
    for params, kernel in (({"kernel": "rbf"}, np.exp(-gamma * ((x[:, None] - x[None]) ** 2).sum(2))),
                           ({"kernel": "poly", "degree": 2}, (gamma * x @ x.T) ** 2)):
        z = np.array([r.features.toArray() for r in md.kernel_map({**params, "n_random": 4000}, df)(df).collect()])
        assert np.abs(z @ z.T - kernel).mean() < 0.1


def test_platt_scaling_uses_margins_of_other_rows(spark):
    rng = random.Random(3)
    rows = [(i, *[rng.gauss(0, 1) for _ in range(12)], float(rng.random() < 0.5)) for i in range(120)]  # noise only
    names = [f"x{i}" for i in range(12)]
    df = spark.createDataFrame(rows, "k long, " + ", ".join(f"{n} double" for n in names) + ", label double").coalesce(1)
    train = md.assemble(prep.stratified_folds(df, ["k"], "label", 5).coalesce(1).persist(), names)
    m = md.fit(train, "svm", {"C": 10.0, "max_iter": 15})
    spread = m.score(train).agg(F.stddev("pd")).first()[0]
    assert spread < 0.15  # in-sample margins would look far more certain


def test_search_tries_all_draws_and_fits_the_best(spark):
    train = _planted(spark)
    draws = [{"n_estimators": 1, "max_depth": 1}, {"n_estimators": 8, "max_depth": 4}, {"n_estimators": 2, "max_depth": 1}]
    model, best, found = md.search(train, "rf", draws=draws, parallelism=3)
    assert len(found) == 3 and best == draws[max(range(3), key=lambda i: found[i])]
    assert model.model.getNumTrees == best["n_estimators"]
    assert len(md.sample_params("gb")) == md.TRIALS == 100
    assert max(d["n_estimators"] for d in md.sample_params("rf", 300)) > 1000
    assert {d["kernel"] for d in md.sample_params("svm", 60)} == {"rbf", "linear", "poly"}
    assert {d["degree"] for d in md.sample_params("svm", 200) if "degree" in d} <= set(range(2, 9))


def test_search_table_has_every_draw_and_fold(spark):
    train = _planted(spark)
    draws = [{"C": 1e-4}, {"C": 1.0}, {"C": 1.0}]
    rows = md.search_table(train, "lasso", draws).collect()
    assert sorted((r.draw, r.fold) for r in rows) == [(d, f) for d in range(3) for f in range(5)]
    by_draw = {d: [r for r in rows if r.draw == d] for d in range(3)}
    for d, of in by_draw.items():
        assert abs(sum(r.f_beta for r in of) / 5 - of[0].mean_f_beta) < 1e-12 and json.loads(of[0].parameters) == draws[d]
    assert {r.draw for r in rows if r.best} == {1}     # the first of equals
    assert by_draw[0][0].mean_f_beta < by_draw[1][0].mean_f_beta
    fold0 = md.fit(train.where("fold <> 0"), "lasso", {"C": 1.0}).predict(train.where("fold = 0"))
    y = [(r.label, r.prediction) for r in fold0.collect()]
    tp, fn, fp = (sum(v == w for v in y) for w in ((1, 1), (1, 0), (0, 1)))
    assert abs(5 * tp / (5 * tp + 4 * fn + fp) - next(r.f_beta for r in by_draw[1] if r.fold == 0)) < 1e-12


def test_linear_models_reach_their_optimum(spark):
    train = _planted(spark)
    for name, params in (("lr", {}), ("lasso", {"C": 0.05})):
        m = md.fit(train, name, params)
        gaps = {r.term: r for r in md.optimality(m, train, params).collect()}
        assert set(gaps) == {"intercept", "x0", "x1", "x2"} and max(r.gap for r in gaps.values()) < 1e-4
        if name == "lasso":
            assert gaps["x2"].coef == 0.0          # the feature that tells nothing
    early = md.fit(train, "lr", {"max_iter": 1})
    assert max(r.gap for r in md.optimality(early, train).collect()) > 1e-3


def test_platt_matches_a_dense_search(spark):
    rng = random.Random(8)
    pairs = [(rng.gauss(1.5 * y, 1), float(y)) for y in (0, 1) for _ in range(60)]
    a, b = md.platt_fit(spark.createDataFrame(pairs + [(None, 1.0), (1.0, None)], "m double, label double").coalesce(1))
    m, y = np.array(pairs).T
    t = np.where(y > 0, 61 / 62, 1 / 62)

    def loss(a, b):
        z = a * m + b
        return (np.logaddexp(0, z) - t * z).sum()

    best = loss(a, b)
    assert all(loss(a + da, b + db) >= best for da in (-1e-4, 0, 1e-4) for db in (-1e-4, 0, 1e-4))
    parted = spark.createDataFrame([(-1.0, 0.0), (-2.0, 0.0), (1.0, 1.0), (2.0, 1.0)], "m double, label double").coalesce(1)
    a, b = md.platt_fit(parted)
    assert 0 < a < 10 and abs(b) < 1e-6              # smoothed targets keep it finite
    assert md.platt_fit(parted.limit(0)) == (0.0, 0.0)


def test_kernel_draws_are_hashes_of_seed_and_place():
    draws = [md.uniform_draw(0, "b", i) for i in range(2000)]
    assert draws == [md.uniform_draw(0, "b", i) for i in range(2000)] and min(draws) > 0 and max(draws) < 1
    assert abs(np.mean(draws) - 0.5) < 0.03 and md.uniform_draw(1, "b", 0) != draws[0]
    z = md._normal(0, 3, 500)
    assert abs(z.mean()) < 0.1 and abs(z.std() - 1) < 0.1


def test_sized_follows_the_rows(spark):
    df = spark.range(1000).repartition(8)
    assert md.sized(df, 3).rdd.getNumPartitions() == 1
    assert md.sized(df, 10 ** 7).rdd.getNumPartitions() == 8       # never more than there are


def test_study_iterations_are_the_defaults(spark):
    assert md.make_estimator("lr", {}, 10).getMaxIter() == 1000
    assert md.make_estimator("lasso", {}, 10).getMaxIter() == 3000
    svm = md.make_estimator("svm", {}, 10)
    assert svm.getMaxIter() == 3000 and svm.getStandardization() is False


def test_logit_summary_and_chi_square(spark):
    assert abs(md.chi2_tail(3.841458820694124, 1) - 0.05) < 1e-12
    assert abs(md.chi2_tail(18.307038053275146, 10) - 0.05) < 1e-12
    assert abs(md.chi2_tail(11.070497693516351, 5) - 0.05) < 1e-12
    train = _planted(spark)
    s = md.Logit(train, ["a", "b", "c"]).summary().first()
    assert s.n_obs == 120 and s.df_model == 2 and s.llf > s.llnull and 0.3 < s.pseudo_r2 < 1 and s.llr_p < 1e-4
    y = [r.label for r in train.collect()]
    p = sum(y) / len(y)
    assert abs(s.llnull - len(y) * (p * math.log(p) + (1 - p) * math.log(1 - p))) < 1e-9


# -- entry A, B and C from files --------------------------------------------------

def _write_study(spark, folder):
    """Invented study files: 32 firms over 6 years, some of which default."""
    rng = random.Random(5)
    rows, rates, links, delist, gdp, loans, deals, interest = [], [], [], [], [], [], [], []
    for firm in range(1, 33):
        weak = firm % 4 == 0
        links.append((firm, 1000 + firm, 19900101, "E"))
        for year in range(2002, 2008):
            at = rng.uniform(50, 500)
            low = rng.uniform(0.0, 0.2) if weak else rng.uniform(0.4, 0.9)
            fin = {"ni": at * (low - 0.1) * 0.2, "ceq": at * 0.4, "rect": at * 0.1, "at": at, "sale": at * rng.uniform(0.5, 1.5),
                   "emp": rng.uniform(1, 20), "wcap": at * low, "act": at * 0.5, "ibc": at * 0.05, "dp": at * 0.02,
                   "dltt": 0.0 if firm == 1 else at * 0.3, "dlc": at * 0.1, "ch": at * low * 0.2, "oancf": at * 0.1,
                   "ivncf": -at * 0.05, "fincf": at * 0.01, "re": at * (low - 0.2), "ebitda": at * 0.12, "pstkc": 0.0,
                   "csho": 5.0, "lt": at * 0.6, "che": at * 0.1}
            names = [f.name for f in INPUTS["financials"] if f.name in fin]
            rows.append((firm, year * 10000 + 1231, year, 10 + 5 * (firm % 3), *[float(fin[n]) for n in names],
                         "INDL", "C", "D", "STD", "T", "USD", 12, "A"))
        if weak:
            rates.append((firm, f"200{firm % 4 + 4}/06/15", "D"))
            delist.append((1000 + firm, 20070301, 574))
        rates.append((firm, "2001/01/01", "BB"))
        for n in range(3):
            facility = firm * 10 + n
            loans.append((facility, firm, 20040315 + n * 10000, 1e6 * (n + 1), "USD", 1.0, 36.0, "Term"))
            deals.append((facility, firm, firm))
            interest += [(facility, "LIBOR", 150.0, 250.0), (facility, "Prime", 10.0, 20.0)]
    gdp = [(y, 0.01 * (y - 1999)) for y in range(2000, 2008)]
    data = {"financials": rows, "gdp": gdp, "delist": delist, "rating": rates, "link": links, "dealscan_link": deals,
            "loan": loans, "interest": interest}
    for name, values in data.items():
        io.write_table(spark.createDataFrame(values, INPUTS[name]), f"{folder}/{name}.csv", fmt="csv")


def test_study_from_files_to_panel_and_capital(spark, tmp_path):
    _write_study(spark, str(tmp_path))
    inputs = io.read_study(spark, str(tmp_path))
    panel = flows.labelled_panel(inputs, sink=str(tmp_path / "panel"))
    written = spark.read.parquet(str(tmp_path / "panel")).cache()
    assert written.count() > 100 and "P2" not in panel.columns and set(written.columns) == set(panel.columns)
    assert {r.default for r in written.select("default").distinct().collect()} == {0, 1}
    assert written.where("default = 1").groupBy("gvkey").count().agg(F.max("count")).first()[0] == 1
    long = None
    for i, m in enumerate(md.MODEL_NAMES):     # scores by a rule instead of five fits
        one = written.select(*modeling.ROW_KEYS, F.col("gsector").cast("int").alias("gsector"), F.lit(m).alias("model"),
                             (F.col("gvkey") % (4 + i) == 0).cast("int").alias("pred"), F.lit(0.01 * (i + 1)).alias("pd"))
        long = one if long is None else long.unionByName(one)
    priced = flows.capital_long(inputs, modeling.wide_scores(long)).cache()
    assert priced.count() > 0 and priced.where("CR IS NULL OR CR < 0").count() == 0
    assert {r.model for r in priced.select("model").distinct().collect()} == set(md.MODEL_NAMES)


def test_smote_above_its_ratio_raises(spark):
    rows = spark.createDataFrame([(i, float(i), int(i < 3)) for i in range(9)], "k long, x double, y int")
    with pytest.raises(ValueError, match="already above"):
        resample.smote(rows, "k", ["x"], "y", ratio=0.001)


def test_runs_follow_their_session(spark):
    a = modeling.run_of(spark, SF)
    assert modeling.run_of(spark, SF) is a and isinstance(a.inputs, DriverInputs)
    modeling.release(spark)
    assert modeling.run_of(spark, SF) is not a


def test_folds_are_fitted_at_the_same_time():
    from threading import Barrier

    together = Barrier(5, timeout=20)

    def of(f):
        together.wait()
        return f
    assert md.all_folds(of, 5) == [0, 1, 2, 3, 4]


def test_search_fits_folds_and_draws_at_the_same_time(spark, monkeypatch):
    """The folds were taken one after the other, with as many fits at a time as there are draws."""
    import threading

    met = threading.Barrier(6)

    class Fitted:
        def __init__(self, draw):
            self.draw = draw

        def predict(self, held):
            return self.draw["C"] + held.first()["fold"]

    def fit(rest, name, params, seed, probabilities):
        met.wait(30)
        return Fitted(params)

    monkeypatch.setattr(md, "fit", fit)
    monkeypatch.setattr(md, "evaluate_fbeta", float)
    train = spark.createDataFrame([(f,) for f in range(3)], "fold int")
    assert md.fold_scores(train, "lasso", [{"C": 10}, {"C": 20}], k=3) == [[10.0, 11.0, 12.0], [20.0, 21.0, 22.0]]
    assert md.fold_scores(train, "lasso", [], k=3) == []
    assert not train.is_cached


def test_temporary_tables_are_deleted(spark):
    import os

    from riskloom import session

    def exists(df):
        return [os.path.exists(f.removeprefix("file://")) for f in df.inputFiles()]

    with session.temporary(spark):
        gone, kept = session.materialize(spark.range(5), "gone"), session.materialize(spark.range(6), "kept", keep=True)
        with session.temporary(spark):
            inner = session.materialize(spark.range(7), "inner")
            files = inner.inputFiles()
        assert exists(gone) and all(exists(gone)) and not any(os.path.exists(f.removeprefix("file://")) for f in files)
        files = gone.inputFiles()
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert all(exists(kept)) and kept.count() == 6
    after = session.materialize(spark.range(3), "after")
    assert all(exists(after))


def test_fits_at_once_fit_into_memory(spark):
    """All folds were fitted at once, each with its own copy of the rows, however many rows there are."""
    train = _planted(spark)
    assert md.fits_at_once(train, 5) == 5
    assert md.fits_at_once(train, 5, width=10 ** 10) == 1
    running, most = [], []

    def of(f):
        running.append(f)
        most.append(len(running))
        running.remove(f)
        return f
    assert md.all_folds(of, 5, at_once=1) == [0, 1, 2, 3, 4] and max(most) == 1


def test_searched_families_are_fitted_at_the_same_time(spark, monkeypatch):
    """They were searched one after the other; the result has the same order."""
    import threading

    met = threading.Barrier(len(modeling.SEARCHED))

    class Run:
        train = spark.range(1)

        def search_table(self, name, trials, max_trees):
            met.wait(30)
            return spark.createDataFrame([(name, trials)], "asked string, trials int")

    monkeypatch.setattr(modeling, "run_of", lambda spark, sf: Run())
    rows = modeling.q_search_table(spark, SF).collect()
    assert [(r.asked, r.model, r.trials) for r in rows] == [(n, n, t) for n, (t, _) in modeling.SEARCHED.items()]
