"""Entry B: labelled panel -> imputed features -> split -> resampling -> models -> scores.

A ``StudyRun`` holds the prepared tables and fitted models of one set of raw
tables; its parameters default to the study's. The registered queries fit every
family once with the parameters in ``PARAMS``: the operators at work, within
what a test machine can fit. The study's search (100 trials, up to 2000 trees)
is ``StudyRun.search``. Queries named ``*_raw`` use the training set without
resampling, as the study's second notebook does.

``tests/test_models.py`` checks models on data with a planted signal; queries
whose result has a closed form (``plans/closed_forms.py``) have SQL twins.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from functools import cached_property
from multiprocessing.pool import ThreadPool

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import attribution as at
from ..operators import capital as cap
from ..operators import models as md
from ..operators import prep
from ..operators import resample as rs
from ..operators.evaluate import classification_metrics
from ..session import materialize, temporary
from ..sources import io
from ..sources.schemas import RATIOS, StudyInputs
from . import flows
from . import testbed as tb

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RAW_FEATURES = [*[r for r in RATIOS if r not in flows.DROP_AFTER_CORR], "gdp_growth"]
KEY = "rid"
ROW_KEYS = ["gvkey", "datadate", "fyear", "default", "default_date"]
SEED = 0
# Parameters of the registered queries; any others can be passed to a StudyRun.
PARAMS: dict[str, dict] = {
    "lr": {},
    "lasso": {"C": 1.0},
    "svm": {"C": 1.0, "kernel": "linear"},
    "rf": {"n_estimators": 50, "max_depth": 5},
    "gb": {"n_estimators": 30, "max_depth": 3, "learning_rate": 0.1},
}
DEPENDENCE = ("L3", "R2")
# Draws and trees of the registered search; the study's are the defaults of StudyRun.search.
SEARCHED = {"rf": (3, 10), "gb": (2, 5), "lasso": (3, 0), "svm": (2, 0)}
GAP = 1e-4                # of the optimality conditions, per standard deviation of a feature


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


class StudyRun:
    """One run of entry B over the raw tables. The caller holds it; what it prepares
    lies in the shared folder and what it fits in its own fields.

    ``resample``: SMOTE to ``smote_ratio`` and under-sampling to ``under_ratio`` on
    the training part. ``fit_on="train"`` imputes from training rows alone; the
    study imputes over all rows. ``inf_policy="null"`` treats infinite ratios as
    missing before imputation; ``"raise"`` refuses them.
    """

    def __init__(self, inputs: StudyInputs, resample: bool = True, params: dict[str, dict] | None = None,
                 smote_ratio: float = 0.1, under_ratio: float = 0.5, test_size: float = 0.2, k_folds: int = 5,
                 fit_on: str = "all", inf_policy: str = "null", seed: int = SEED) -> None:
        if fit_on not in ("all", "train") or inf_policy not in ("null", "raise"):
            raise ValueError("fit_on is 'all' or 'train', inf_policy 'null' or 'raise'")
        self.inputs, self.resample, self.seed = inputs, resample, seed
        self.params = {**{n: {} for n in md.MODEL_NAMES}, **(params or {})}
        self.smote_ratio, self.under_ratio, self.test_size, self.k_folds = smote_ratio, under_ratio, test_size, k_folds
        self.fit_on, self.inf_policy = fit_on, inf_policy
        self._fitted: dict[str, md.FittedModel] = {}
        self._folds: dict[str, md.OfFold] = {}

    @cached_property
    def base(self) -> DataFrame:
        """Panel rows with a key, infinite ratios handled, and their split."""
        spark = SparkSession.active()
        with temporary(spark):
            return self._split_panel(flows.labelled_panel(self.inputs))

    def _split_panel(self, panel: DataFrame) -> DataFrame:
        def finite(c: str):
            endless = F.abs(F.col(c)) == float("inf")
            if self.inf_policy == "raise":
                return F.when(endless, F.raise_error(F.lit(f"infinite {c}")).cast("double")).otherwise(F.col(c))
            return F.when(~endless, F.col(c))

        rows = panel.select(
            (F.col("gvkey") * 100000 + F.datediff("datadate", F.lit("1900-01-01"))).alias(KEY), *ROW_KEYS,
            F.col("gsector").cast("double").alias("gsector_raw"), "gsector",
            *[finite(c).alias(c) for c in RAW_FEATURES])
        return materialize(prep.stratified_split(rows, ["gvkey", "datadate"], "default", self.test_size, seed=self.seed),
                           "base", keep=True)

    @cached_property
    def imputed(self) -> DataFrame:
        filled = [*RAW_FEATURES, "gsector_raw"]
        base = self.base
        donors = base.where(F.col("split") == "train") if self.fit_on == "train" else None
        with temporary(base.sparkSession):
            return materialize(prep.knn_impute(base, KEY, filled, k=5, donors=donors), "imputed", keep=True)

    @cached_property
    def levels(self) -> list:
        return prep.observed_levels(self.imputed, "gsector")

    @property
    def features(self) -> list[str]:
        return [*RAW_FEATURES, *[f"gs_{v}" for v in self.levels[1:]]]

    @cached_property
    def _hot(self) -> DataFrame:
        return prep.one_hot(self.imputed, "gsector", self.levels, prefix="gs")

    @cached_property
    def train(self) -> DataFrame:
        """(key, features, label, fold) of the training rows, resampled if asked for. Kept in
        memory as far as it fits; the rest is read from its table again, not from a copy on disk."""
        with temporary(self.imputed.sparkSession):
            folded = self._folded()
        return md.assemble(md.sized(folded, len(self.features)), self.features).select(
            KEY, "features", "label", "fold").persist(StorageLevel.MEMORY_ONLY)

    def _folded(self) -> DataFrame:
        rows = self._hot.where(F.col("split") == "train").select(KEY, *self.features, "default")
        if self.resample:
            made = rs.smote(rows, KEY, self.features, "default", self.smote_ratio, 5, 1, self.seed)
            rows = materialize(rows.unionByName(made.drop("synthetic")), "smote")
            rows = rs.undersample(rows, [KEY], "default", self.under_ratio, minority=1, seed=42)
        rows = rows.select(KEY, *self.features, F.col("default").cast("double").alias("label"))
        folded = prep.stratified_folds(rows, [KEY], "label", self.k_folds, seed=self.seed)
        return materialize(folded, "train", keep=True)

    @cached_property
    def test(self) -> DataFrame:
        rows = self._hot.where(F.col("split") == "test").withColumn("label", F.col("default").cast("double"))
        return md.assemble(materialize(rows, "test"), self.features)

    def close(self) -> None:
        """Release what the run keeps in memory."""
        if "train" in self.__dict__:
            self.train.unpersist()

    def model(self, name: str) -> md.FittedModel:
        if name not in self._fitted:
            self._fitted[name] = md.fit(self.train, name, self.params[name], self.seed, of_fold=self._of_fold(name))
        return self._fitted[name]

    def _of_fold(self, name: str) -> md.OfFold:
        """Models without one fold each: cross-validation and Platt scaling share them."""
        if name not in self._folds:
            self._folds[name] = md.fold_models(self.train, name, self.params[name], self.seed)
        return self._folds[name]

    def search(self, name: str, trials: int = md.TRIALS, parallelism: int = 32, max_trees: int = md.MAX_TREES):
        """The study's search; the best model and its parameters become the run's (ML10 ML11)."""
        model, best, found = md.search(self.train, name, trials, self.seed, parallelism, max_trees, self.k_folds)
        self._fitted[name], self.params[name] = model, best
        self._folds.pop(name, None)
        return best, found

    def search_table(self, name: str, trials: int = md.TRIALS, parallelism: int = 32,
                     max_trees: int = md.MAX_TREES) -> DataFrame:
        """Every draw of the search with its F-beta on every fold (ML9 ML10)."""
        draws = md.sample_params(name, trials, self.seed, max_trees)
        return md.search_table(self.train, name, draws, self.seed, parallelism, self.k_folds)

    def linear_attribution(self, name: str) -> DataFrame:
        """Attribution of ``lr`` or ``lasso`` on the test rows against the training rows (ML15)."""
        return at.linear_attribution(self.model(name).model, self.test, KEY, self.features, self.train)

    def logit(self) -> md.Logit:
        return md.Logit(self.train, self.features)

    def test_metrics(self) -> DataFrame:
        """Held-out accuracy, precision, recall, F-beta per model (ML12 ML13 AG11 AG12)."""
        preds = None
        for name in md.MODEL_NAMES:
            s = self.model(name).score(self.test).select(
                F.lit(name).alias("model"), F.col("label").cast("int").alias("label"), "pred")
            preds = s if preds is None else preds.unionByName(s)
        return classification_metrics(preds, ["model"], "label", "pred")

    def cv_metrics(self) -> DataFrame:
        """Fold-mean validation metrics of the run's parameters (ML8)."""
        out = None
        for name in md.MODEL_NAMES:
            m = md.cv_metrics(self.train, name, self.params[name], self.k_folds, seed=self.seed, of_fold=self._of_fold(name))
            out = m if out is None else out.unionByName(m)
        return out

    def scored(self, sink: str | None = None) -> DataFrame:
        """Test rows with keys and each model's (pred, pd), long form (JN9 ML12). ``sink``
        also writes the wide table (IO2)."""
        out = None
        for name in md.MODEL_NAMES:
            s = self.model(name).score(self.test).select(
                *ROW_KEYS, F.col("gsector_raw").cast("int").alias("gsector"), F.lit(name).alias("model"), "pred", "pd")
            out = s if out is None else out.unionByName(s)
        if sink:
            io.write_table(wide_scores(out), sink)
        return out

    def attribution(self) -> DataFrame:
        """Per-row TreeSHAP attribution of the gradient-boosted model on the test rows (ML15)."""
        return at.gbt_attribution(self.model("gb").model, self.test, KEY, self.features)


def wide_scores(long: DataFrame) -> DataFrame:
    """One row per firm-year with ``pred_<m>`` and ``pd_<m>``: what entry C prices."""
    keys = [*ROW_KEYS, "gsector"]
    wide = long.groupBy(*keys).pivot("model", md.MODEL_NAMES).agg(F.first("pred").alias("pred"), F.first("pd").alias("pd"))
    return wide.select(*keys, *[F.col(f"{m}_{c}").alias(f"{c}_{m}") for m in md.MODEL_NAMES for c in ("pred", "pd")])


# Runs of the registered queries, by session; a session that is gone takes its runs with it.
_RUNS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def run_of(spark: SparkSession, sf: str, resample: bool = True) -> StudyRun:
    runs = _RUNS.setdefault(spark, {})
    if (sf, resample) not in runs:
        runs[sf, resample] = StudyRun(tb.DriverInputs(spark, sf), resample, PARAMS)
    return runs[sf, resample]


def release(spark: SparkSession) -> None:
    """Forget the runs of a session and free their memory."""
    for run in _RUNS.pop(spark, {}).values():
        run.close()


def _both(name: str):
    """Register a query on the resampled training set and, as ``<name>_raw``, on the plain one."""
    def deco(fn):
        query(name)(lambda spark, sf: fn(run_of(spark, sf)))
        query(f"{name}_raw")(lambda spark, sf: fn(run_of(spark, sf, resample=False)))
        return fn
    return deco


@_both("logit_table")
def q_logit_table(run):
    return run.logit().table()


@_both("logit_summary")
def q_logit_summary(run):
    return run.logit().summary()


@_both("test_metrics")
def q_test_metrics(run):
    return run.test_metrics()


@_both("cv_metrics")
def q_cv_metrics(run):
    return run.cv_metrics()


@query("scored_panel")
def q_scored_panel(spark, sf):
    return run_of(spark, sf).scored()


@query("scored_capital")
def q_scored_capital(spark, sf):
    """Regulatory capital per model, priced on the models' own scores (entry B into entry C)."""
    run = run_of(spark, sf)
    scores = materialize(wide_scores(run.scored()), "scores")
    return cap.capital_table(flows.capital_long(run.inputs, scores, tb.QUOTE_ORDER))


@query("importance")
def q_importance(spark, sf):
    run = run_of(spark, sf)
    return md.importances(run.model("gb"), run.features, top=10)


@query("attribution")
def q_attribution(spark, sf):
    return run_of(spark, sf).attribution()


@query("attribution_ranking")
def q_attribution_ranking(spark, sf):
    """Features ranked by mean |SHAP value| over the test rows, top 10 (ML15 summary, ST5)."""
    return at.mean_abs_ranking(run_of(spark, sf).attribution(), top=10)


@query("attribution_dependence")
def q_attribution_dependence(spark, sf):
    """Value against attribution of two chosen ratios."""
    return at.dependence(run_of(spark, sf).attribution(), DEPENDENCE)


@query("attribution_breakdown")
def q_attribution_breakdown(spark, sf):
    """All attributions of two rows: the test rows with the highest and lowest default probability."""
    run = run_of(spark, sf)
    attr = run.attribution()
    pd_ = at.probabilities(attr, KEY)
    ends = pd_.orderBy(F.desc("pd"), KEY).limit(1).unionByName(pd_.orderBy("pd", KEY).limit(1))
    return at.breakdown(attr, KEY, ends)


@query("attribution_probability")
def q_attribution_probability(spark, sf):
    """Expected and estimated default probability of every test row."""
    return at.probabilities(run_of(spark, sf).attribution(), KEY)


@query("search_table")
def q_search_table(spark, sf):
    """A few draws of every family that is searched, each on every fold (ML9 ML10 ML11)."""
    run, out = run_of(spark, sf), None
    run.train.count()       # made once, before all of them ask for it

    def of(name: str) -> DataFrame:
        trials, trees = SEARCHED[name]
        return run.search_table(name, trials, max_trees=trees).withColumn("model", F.lit(name))

    # all families at the same time: the solvers mostly wait for short jobs, the trees do not
    with ThreadPool(len(SEARCHED)) as pool:
        for t in pool.map(of, SEARCHED, chunksize=1):
            out = t if out is None else out.unionByName(t)
    return out


@query("linear_attribution")
def q_linear_attribution(spark, sf):
    run = run_of(spark, sf)
    return run.linear_attribution("lr").withColumn("model", F.lit("lr")).unionByName(
        run.linear_attribution("lasso").withColumn("model", F.lit("lasso")))


def optimality(run: StudyRun) -> DataFrame:
    """(model, term, coef, gap) of the linear models at the study's iterations."""
    out = None
    for name in ("lr", "lasso"):
        t = md.optimality(run.model(name), run.train, run.params[name]).select(F.lit(name).alias("model"), "*")
        out = t if out is None else out.unionByName(t)
    return out
