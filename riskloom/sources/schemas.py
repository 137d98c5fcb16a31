"""Declared schemas of the study's input files (no inference, never positional)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T

D, L, I, S = T.DoubleType(), T.LongType(), T.IntegerType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


FIN_MEASURES = ["ni", "ceq", "rect", "at", "sale", "emp", "wcap", "act", "ibc", "dp",
                "dltt", "dlc", "ch", "oancf", "ivncf", "fincf", "re", "ebitda",
                "pstkc", "csho", "lt", "che"]

FINANCIALS = _struct(
    ("gvkey", L), ("datadate", I), ("fyear", I), ("gsector", I),
    *[(m, D) for m in FIN_MEASURES],
    ("indfmt", S), ("consol", S), ("popsrc", S), ("datafmt", S), ("tic", S),
    ("curcd", S), ("fyr", I), ("costat", S),
)
FIN_DROPPED = ["indfmt", "consol", "popsrc", "datafmt", "tic", "curcd", "fyr", "costat"]

GDP = _struct(("year", I), ("gdp_growth", D))
DELIST = _struct(("PERMNO", L), ("DLSTDT", I), ("DLSTCD", I))
RATING = _struct(("gvkey", L), ("datadate", S), ("splticrm", S))
LINK = _struct(("gvkey", L), ("LPERMNO", L), ("LINKDT", I), ("LINKENDDT", S))
DEALSCAN_LINK = _struct(("facid", L), ("bcoid", L), ("gvkey", L))
LOAN = _struct(("FacilityID", L), ("BorrowerCompanyID", L), ("FacilityStartDate", I),
               ("FacilityAmt", D), ("Currency", S), ("ExchangeRate", D),
               ("Maturity", D), ("LoanType", S))
INTEREST = _struct(("FacilityID", L), ("BaseRate", S), ("MinBps", D), ("MaxBps", D))

RATIOS = ["L1", "L2", "L3", "L4", "L5", "L6", "P1", "P2", "P3", "E1", "E2", "E3",
          "R1", "R2", "G1", "G2", "G3", "G4", "S"]

INPUTS = {
    "financials": FINANCIALS, "gdp": GDP, "delist": DELIST, "rating": RATING,
    "link": LINK, "dealscan_link": DEALSCAN_LINK, "loan": LOAN, "interest": INTEREST,
}


@dataclass
class StudyInputs:
    """The eight raw tables of the study, in the schemas above."""

    financials: DataFrame
    gdp: DataFrame
    delist: DataFrame
    rating: DataFrame
    link: DataFrame
    dealscan_link: DataFrame
    loan: DataFrame
    interest: DataFrame
