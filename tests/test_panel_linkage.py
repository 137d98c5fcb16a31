import datetime as dt
import tempfile

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from riskloom.operators import labels as lab
from riskloom.operators import linkage as lk
from riskloom.operators import panel as pn

D = dt.date


def _fin(spark, rows):
    return spark.createDataFrame(rows, "gvkey long, datadate int, fyear int, emp double, rect double, "
                                       "at double, sale double, ni double, ceq double, dltt double")


def test_lag_gap_guard(spark):
    # first year; consecutive; gap of two years; a middle year removed by emp > 0
    rows = [(1, 20000630, 2000, 5.0, 1.0, 10.0, 5.0, 1.0, 2.0, 0.0),
            (1, 20010630, 2001, 5.0, 2.0, 20.0, 6.0, 1.0, 2.0, 1.0),
            (1, 20030630, 2003, 5.0, 3.0, 30.0, 7.0, 1.0, 2.0, 1.0),
            (2, 20000630, 2000, 5.0, 1.0, 10.0, 5.0, 1.0, 2.0, 1.0),
            (2, 20010630, 2001, 0.0, 1.0, 11.0, 5.0, 1.0, 2.0, 1.0),
            (2, 20020630, 2002, 5.0, 1.0, 12.0, 5.0, 1.0, 2.0, 1.0)]
    out = pn.add_lags(pn.clean_financials(_fin(spark, rows)))
    got = {(r.gvkey, r.fyear): (r.lag_at, r.dltt) for r in out.collect()}
    assert got[(1, 2000)] == (None, 1.0)         # first year; dltt 0 -> 1
    assert got[(1, 2001)] == (10.0, 1.0)
    assert got[(1, 2003)][0] is None             # two-year gap
    assert (2, 2001) not in got                  # emp = 0 removed ...
    assert got[(2, 2002)][0] is None             # ... which opens a gap


def test_thresh_counts_inf_as_present(spark):
    df = spark.createDataFrame([(1.0, None, None), (float("inf"), 1.0, None), (1.0, 1.0, 1.0)],
                               "a double, b double, c double")
    sweep = pn.thresh_sweep(df, [1, 2, 3]).first()
    assert (sweep.thresh_1, sweep.thresh_2, sweep.thresh_3, sweep.complete) == (3, 2, 1, 1)
    assert pn.keep_thresh(df, 2).count() == 2


def test_link_resolution_branches(spark):
    link = spark.createDataFrame([
        (100, 1, 20000101, "20011231"),            # PERMNO 1: single candidate, dates ignored
        (200, 2, 20000101, "20020101"),            # PERMNO 2: several, one valid
        (201, 2, 20020101, "E"),
        (300, 3, 20000101, "20010101"),            # PERMNO 3: several, none valid for the event
        (301, 3, 20050101, "20060101"),
    ], "gvkey long, LPERMNO long, LINKDT int, LINKENDDT string")
    ext = lk.extend_links(link, as_of=D(2024, 12, 31))
    ends = {r.gvkey: r.LINKENDDT for r in ext.collect()}
    assert ends[201] == D(2024, 12, 31) and ends[200] == D(2002, 1, 1) and ends[301] == D(2024, 12, 31)
    ev = spark.createDataFrame([(1, D(1990, 1, 1), 100), (2, D(2003, 6, 1), 100), (2, D(2003, 6, 1), 100),
                                (3, D(2002, 6, 1), 100), (4, D(2003, 1, 1), 100)],
                               "PERMNO long, DLSTDT date, DLSTCD int")
    res = sorted((r.PERMNO, r.gvkey) for r in lk.resolve_links(ev, ext).collect())
    assert res == [(1, 100), (2, 201), (2, 201)]   # duplicates kept; none-valid and unlinked dropped
    why = {r.reason: r.n_events for r in lk.unresolved_events(ev.unionByName(ev.where("PERMNO = 4")), ext).collect()}
    assert why == {lk.NO_LINK: 2, lk.NONE_VALID: 1}
    seen = Observation()
    observed = lk.resolve_links(ev, ext, dropped=seen)
    assert sorted((r.PERMNO, r.gvkey) for r in observed.collect()) == res
    assert seen.get == {"resolved": 3, "no_link": 1, "none_valid": 1}
    assert lk.unresolved_events(ev.limit(0), ext).count() == 0


def test_event_window_bounds(spark):
    panel = spark.createDataFrame([(1, D(2000, 2, 29)), (2, D(2001, 6, 30))], "gvkey long, datadate date")
    ev = spark.createDataFrame([(1, D(2000, 2, 29)), (1, D(2001, 2, 28)), (1, D(2001, 2, 27)),
                                (2, D(2002, 6, 30)), (2, D(2001, 7, 1))], "gvkey long, event_date date")
    ev = ev.withColumn("kind", F.lit("x")).unionByName(
        ev.where("gvkey = 1").withColumn("event_date", F.date_sub("event_date", 30)).withColumn("kind", F.lit("y")))
    out = lk.attach_event_windows(panel, ev, {"d": "x", "e": "y"})
    got = {r.gvkey: (r.d, r.e) for r in out.collect()}
    assert got[1] == (D(2001, 2, 27), D(2001, 1, 29))  # on datadate and on +1y (Feb-28) excluded
    assert got[2] == (D(2001, 7, 1), None)
    assert out.count() == 2 and out.columns == ["gvkey", "datadate", "d", "e"]


def test_malformed_dates_raise_unless_allowed(spark):
    df = spark.createDataFrame([("20000131",), (None,), ("2000131x",)], "d string")
    assert [r.x for r in df.select(pn.yyyymmdd_to_date("d", strict=False).alias("x")).collect()] == [D(2000, 1, 31), None, None]
    fine = spark.createDataFrame([("20000131",), (None,)], "d string")
    assert [r.x for r in fine.select(pn.yyyymmdd_to_date("d").alias("x")).collect()] == [D(2000, 1, 31), None]
    with pytest.raises(Exception, match="not a date"):
        df.select(pn.yyyymmdd_to_date("d").alias("x")).collect()


def test_first_default_and_sector_filter(spark):
    df = spark.createDataFrame([(1, D(2000, 1, 1), 2000, 1, 10), (1, D(2001, 1, 1), 2001, 1, 10),
                                (1, D(2002, 1, 1), 2002, 0, 40), (2, D(2000, 1, 1), 2000, 0, None)],
                               "gvkey long, datadate date, fyear int, default int, gsector int")
    kept = lab.keep_first_default(df)
    assert sorted((r.gvkey, r.fyear) for r in kept.collect()) == [(1, 2000), (1, 2002), (2, 2000)]
    assert sorted(r.gvkey for r in lab.drop_sectors(kept).collect()) == [1, 2]


def test_asof_picks_most_recent(spark):
    panel = spark.createDataFrame([(1, D(2000, 3, 31), 2000), (1, D(2000, 12, 31), 2001)],
                                  "gvkey long, datadate date, fyear int")
    loans = spark.createDataFrame([(1, D(2001, 2, 1), 5.0), (1, D(2001, 2, 1), 5.0), (1, D(2000, 3, 31), 1.0),
                                   (2, D(2001, 1, 1), 1.0)], "gvkey long, FacilityStartDate date, amt double")
    got = sorted((r.amt, r.fyear) for r in lk.asof_match(loans, panel).collect())
    assert got == [(5.0, 2001), (5.0, 2001)]       # duplicates kept, start on a bound unmatched
    plan = lk.asof_match(loans, panel)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_asof_reads_the_loans_once(spark):
    path = tempfile.mkdtemp(prefix="riskloom-asof-") + "/loans"
    spark.createDataFrame([(1, 20010201, 5.0), (1, 20020101, 7.0), (1, None, 1.0), (None, 20010201, 2.0),
                           (2, 20000331, 3.0), (2, 20010331, 4.0)], "gvkey long, d int, amt double").write.parquet(path)
    loans = spark.read.parquet(path).select("gvkey", pn.yyyymmdd_to_date("d").alias("FacilityStartDate"), "amt")
    panel = spark.createDataFrame(
        [(1, D(2000, 12, 31), 2000, None), (1, D(2001, 1, 15), 2000, 0.5), (1, D(2001, 1, 15), 2001, None),
         (1, D(2001, 2, 1), 2002, 0.1), (1, None, 2003, 0.1), (None, D(2001, 1, 1), 2001, 0.2),
         (2, D(2000, 3, 31), 2000, 0.3)], "gvkey long, datadate date, fyear int, pd double")
    out = lk.asof_match(loans, panel)
    assert out.columns == ["gvkey", "FacilityStartDate", "amt", "datadate", "fyear", "pd"]
    # the greatest row of a date; no match on either bound, without start or without firm
    assert sorted((r.amt, r.fyear, r.pd) for r in out.collect()) == [(5.0, 2001, None), (7.0, 2002, 0.1)]
    plan = lk.asof_match(loans, panel)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("/loans]") == 1


def test_integer_dates_as_their_text(spark):
    n = spark.createDataFrame([(v,) for v in (20000101, 20000229, 20010229, 20001231, 20001301, 20000100, 20000431,
                                              9990101, 120000101, 0, None)], "n int")
    got = n.select(pn.yyyymmdd_number_to_date("n", strict=False).alias("a"),
                   pn.yyyymmdd_to_date("n", strict=False).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]
    assert [r.a for r in got][:4] == [D(2000, 1, 1), D(2000, 2, 29), None, D(2000, 12, 31)]
    with pytest.raises(Exception, match="not a date"):
        n.select(pn.yyyymmdd_number_to_date("n").alias("a")).collect()
