"""End-to-end flows of the study, composed from operators.

* Entry A (``labelled_panel``): raw financials, macro series, delistings, links
  and ratings -> labelled, winsorized firm-year panel.
* Entry B (``riskloom.plans.modeling``): panel -> models -> scores.
* Entry C (``capital_long``): scores + loans -> capital and loss tables.

Every function takes the raw tables (``StudyInputs``: files read by
``io.read_study``, or the test tables of ``testbed``) and returns a lazy
DataFrame. What several steps read is written once to the shared folder.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import capital as cap
from ..operators import labels as lab
from ..operators import linkage as lk
from ..operators import panel as pn
from ..operators import stats as st
from ..session import materialize
from ..sources import io
from ..sources.schemas import RATIOS, StudyInputs

AS_OF = dt.date(2024, 12, 31)
THRESH = 23
MACRO_COL = "gdp_growth"
DROP_AFTER_CORR = ["P2"]
EVENT_KINDS = {"rating_date": "rating", "delist_date": "delist"}


def lagged_financials(inputs: StudyInputs) -> DataFrame:
    """Cleaned financials with gap-guarded lags (PR1 PR4 PR5 PR10 WN1 WN2)."""
    return pn.add_lags(pn.clean_financials(inputs.financials))


def predictors(inputs: StudyInputs) -> DataFrame:
    """Keys, the 19 ratios and sector (SC11)."""
    return pn.add_ratios(lagged_financials(inputs))


def macro_predictors(inputs: StudyInputs) -> DataFrame:
    return pn.join_macro(predictors(inputs), inputs.gdp)


def screened_predictors(inputs: StudyInputs) -> DataFrame:
    """Sector present, at most one missing cell (PR14 PR15)."""
    return pn.keep_thresh(pn.drop_missing(macro_predictors(inputs), ["gsector"]), THRESH)


def extended_links(inputs: StudyInputs) -> DataFrame:
    return lk.extend_links(inputs.link, as_of=AS_OF)


def resolved_delistings(inputs: StudyInputs) -> DataFrame:
    """Default delistings with their firm (PR6 JN5). The extended links are read by
    both branches of the resolution, so they are written once."""
    return lk.resolve_links(lk.default_delistings(inputs.delist), materialize(extended_links(inputs), "links"))


def unresolved_delistings(inputs: StudyInputs) -> DataFrame:
    """How many default delistings have no firm, and why."""
    return lk.unresolved_events(lk.default_delistings(inputs.delist), materialize(extended_links(inputs), "links"))


def rating_events(inputs: StudyInputs) -> DataFrame:
    return lk.rating_defaults(inputs.rating)


def default_events(inputs: StudyInputs) -> DataFrame:
    """(gvkey, event_date, kind) of rating defaults and default delistings."""
    r = rating_events(inputs).select("gvkey", F.col("datadate").alias("event_date"), F.lit("rating").alias("kind"))
    d = resolved_delistings(inputs).select("gvkey", F.col("DLSTDT").alias("event_date"), F.lit("delist").alias("kind"))
    return r.unionByName(d)


def firm_years(inputs: StudyInputs) -> DataFrame:
    return pn.clean_financials(inputs.financials).select("gvkey", "datadate", "fyear", "gsector")


def event_panel(inputs: StudyInputs, panel: DataFrame | None = None) -> DataFrame:
    """Panel with rating/delisting dates in the year after each fiscal year end,
    the default label and the earlier default date (JN6 SC7 PR13 SC8)."""
    base = panel if panel is not None else firm_years(inputs)
    return lab.label_defaults(lk.attach_event_windows(base, default_events(inputs), EVENT_KINDS))


def unwinsorized_panel(inputs: StudyInputs) -> DataFrame:
    """The labelled panel with all 19 ratios as computed. Reads each raw table at most
    twice and the panel itself once."""
    firms = lk.linked_firms(inputs.delist, inputs.link, inputs.rating)
    labelled = event_panel(inputs, lk.restrict_to_firms(screened_predictors(inputs), firms))
    return lab.drop_sectors(lab.keep_first_default(labelled).drop("rating_date", "delist_date"))


def labelled_panel(inputs: StudyInputs, sink: str | None = None) -> DataFrame:
    """Entry A: the study's panel, winsorized, without P2. The bounds need the whole
    panel first, so it is written once and read back. ``sink`` also writes the result (IO2)."""
    kept = materialize(unwinsorized_panel(inputs), "panel")
    out = st.winsorize(kept, RATIOS).drop(*DROP_AFTER_CORR)
    if sink:
        io.write_table(out, sink)
    return out


# --------------------------------------------------------------------------- entry C

def facility_loans(inputs: StudyInputs) -> DataFrame:
    """Loans with their firm through the two-key facility map (JN2 PR1 PR4)."""
    j = lk.two_key_join(inputs.loan, inputs.dealscan_link,
                        ["FacilityID", "BorrowerCompanyID"], ["facid", "bcoid"], drop_left_keys=False)
    number = dict(inputs.loan.dtypes)["FacilityStartDate"] in ("int", "bigint")
    to_date = pn.yyyymmdd_number_to_date if number else pn.yyyymmdd_to_date
    return j.drop("facid", "bcoid").withColumn("FacilityStartDate", to_date("FacilityStartDate"))


def facility_rates(inputs: StudyInputs, order: tuple[str, ...] = ("MinBps", "MaxBps", "BaseRate")) -> DataFrame:
    return cap.facility_rates(inputs.interest, order=order)


def scored_loans(inputs: StudyInputs, scores: DataFrame,
                 order: tuple[str, ...] = ("MinBps", "MaxBps", "BaseRate")) -> DataFrame:
    """As-of matched, rated loans with LGD, one row per loan (JN8 JN3 PR14 JN7).
    ``scores`` has one row per firm-year with ``pred_<m>`` and ``pd_<m>`` columns."""
    matched = lk.asof_match(facility_loans(inputs), scores)
    rated = cap.attach_rates(matched, facility_rates(inputs, order).select("FacilityID", "rate"))
    return cap.attach_lgd(rated)


def capital_long(inputs: StudyInputs, scores: DataFrame,
                 order: tuple[str, ...] = ("MinBps", "MaxBps", "BaseRate")) -> DataFrame:
    """One row per (loan, model) with capital (CP2 CP1)."""
    return cap.add_capital(cap.scores_long(scored_loans(inputs, scores, order)))
