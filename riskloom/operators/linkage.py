"""Identifier linking and date-window joins (JN2-JN6, JN8, WN5, WN6, PR6, PR8, PR11).

Range joins always carry an equi key (firm id). On top of it each range join
adds a **year bucket** to the key: an event at ``t`` can only fall in the
window ``(d, d + 1 year)`` when ``year(t)`` is ``year(d)`` or ``year(d) + 1``,
so the window side is exploded to those two buckets. A firm with a third of
all rows is then spread over many (firm, year) join keys, and the rows
compared inside one key are bounded by two years of data, never all pairs
of the firm.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.numeric import within_year_after
from .panel import parse_date, yyyymmdd_to_date

# Delisting codes that count as default besides every code below 500.
DEFAULT_DELIST_CODES = (560, 572, 574)
DEFAULT_DELIST_BELOW = 500
# Open-ended link marker and the date it stood for in the study.
OPEN_END_MARK = "E"
OPEN_END_DATE = dt.date(2022, 3, 16)


def default_delistings(delist: DataFrame, below: int = DEFAULT_DELIST_BELOW,
                       codes: Sequence[int] = DEFAULT_DELIST_CODES) -> DataFrame:
    """Delistings that mean default: ``code < below or code in codes`` (PR6, PR4)."""
    c = F.col("DLSTCD")
    return (delist.where((c < below) | c.isin(*codes))
            .withColumn("DLSTDT", yyyymmdd_to_date("DLSTDT")))


def rating_defaults(rating: DataFrame, grade: str = "D", date_fmt: str = "yyyy/MM/dd",
                    order: Sequence[str] = ("datadate",)) -> DataFrame:
    """First rating of ``grade`` per firm (PR8 + WN3), dated.

    "First" is the earliest rating date (the study used file order). One row
    per firm via ``min_by`` on a tie-free struct: a partial aggregate, so a
    firm with many ratings is pre-combined before the shuffle.
    """
    d = rating.where(F.col("splticrm") == grade).withColumn(
        "datadate", parse_date("datadate", date_fmt))
    key = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in d.columns if c not in order])
    first = F.min_by(F.struct(*[F.col(c) for c in d.columns]), key)
    return d.groupBy("gvkey").agg(first.alias("r")).select("r.*")


def linked_firms(delist: DataFrame, link: DataFrame, rating: DataFrame) -> DataFrame:
    """Union of firms reachable from any delisting through the link, and rated firms (JN4, ST3)."""
    permnos = delist.select(F.col("PERMNO").alias("LPERMNO")).distinct()
    via_link = link.join(permnos, "LPERMNO", "left_semi").select("gvkey")
    return via_link.union(rating.select("gvkey")).distinct()


def restrict_to_firms(panel: DataFrame, firms: DataFrame, key: str = "gvkey") -> DataFrame:
    """Semi-join of the panel on a key set (JN4)."""
    return panel.join(firms.select(F.col(key)), key, "left_semi")


def extend_links(link: DataFrame, as_of: dt.date, open_end: dt.date = OPEN_END_DATE,
                 mark: str = OPEN_END_MARK) -> DataFrame:
    """Parse link dates, open ends become ``open_end``, and every PERMNO's latest
    end (all ties) is extended to ``as_of`` (PR4 PR11 WN5). Adds ``n_cand`` (WN6).

    The max and the count are one grouped aggregate (pre-combined per map task)
    joined back on ``LPERMNO``, so an identifier with very many links is not
    windowed in a single task.
    """
    end = F.when(F.col("LINKENDDT").cast("string") == mark, F.lit(open_end)).otherwise(
        yyyymmdd_to_date("LINKENDDT"))
    out = (link.withColumn("LINKDT", yyyymmdd_to_date("LINKDT"))
           .withColumn("LINKENDDT", end))
    per_id = out.groupBy("LPERMNO").agg(F.max("LINKENDDT").alias("_max_end"),
                                        F.count(F.lit(1)).alias("n_cand"))
    return (out.join(per_id, "LPERMNO", "inner")
            .withColumn("LINKENDDT", F.when(F.col("LINKENDDT") == F.col("_max_end"), F.lit(as_of))
                        .otherwise(F.col("LINKENDDT")))
            .drop("_max_end"))


# Why an event has no firm.
NO_LINK, NONE_VALID = "no link", "several, none valid"


def _choices(asked: DataFrame, links: DataFrame) -> DataFrame:
    """(_id, _at, gvkey) of the distinct (_id, _at) that a link resolves."""
    lk = links.select(F.col("LPERMNO").alias("_id"), "gvkey", "LINKDT", "LINKENDDT", "n_cand")
    single = asked.join(lk.where(F.col("n_cand") == 1), "_id").select("_id", "_at", "gvkey")
    several = (lk.where(F.col("n_cand") > 1)
               .withColumn("_yr", F.explode(F.sequence(F.year("LINKDT"), F.year("LINKENDDT")))))
    valid = (asked.withColumn("_yr", F.year("_at")).join(several, ["_id", "_yr"])
             .where((F.col("LINKDT") < F.col("_at")) & (F.col("LINKENDDT") > F.col("_at")))
             .groupBy("_id", "_at").agg(F.min_by("gvkey", F.struct("LINKDT", "gvkey")).alias("gvkey")))
    return single.unionByName(valid)


def resolve_links(events: DataFrame, links: DataFrame, id_col: str = "PERMNO",
                  date_col: str = "DLSTDT", dropped: Observation | None = None) -> DataFrame:
    """Attach ``gvkey`` to each event row (JN5).

    One candidate link: take it, dates ignored. Several: the first (by
    ``LINKDT, gvkey``) with ``LINKDT < date < LINKENDDT``. None, or several and
    none valid: the event is dropped. ``links`` must come from
    :func:`extend_links` (it carries ``n_cand``).

    The choice depends on the identifier and the date alone, so it is made per
    distinct pair with a keyed aggregate and joined back; repeated events keep
    their multiplicity and need no row ids.

    ``dropped`` observes the join on its way: after an action on the result it holds
    the numbers of events ``resolved``, ``no_link`` and ``none_valid``.
    """
    asked = events.select(F.col(id_col).alias("_id"), F.col(date_col).alias("_at")).distinct()
    chosen = _choices(asked, links)
    same = (F.col(id_col) == F.col("_id")) & F.col(date_col).eqNullSafe(F.col("_at"))
    if dropped is None:
        return events.join(chosen, same).select(*events.columns, "gvkey")
    out = _with_reason(events, links, chosen, id_col, date_col)
    count = lambda of: F.count(F.when(of, 1))
    out = out.observe(dropped, count(F.col("_reason").isNull()).alias("resolved"),
                      count(F.col("_reason") == NO_LINK).alias("no_link"),
                      count(F.col("_reason") == NONE_VALID).alias("none_valid"))
    return out.where(F.col("_reason").isNull()).select(*events.columns, "gvkey")


def _with_reason(events: DataFrame, links: DataFrame, chosen: DataFrame, id_col: str, date_col: str) -> DataFrame:
    """All events with ``gvkey`` and, where no link resolves them, ``_reason``."""
    found = chosen.withColumn("_found", F.lit(True))
    linked = links.select(F.col("LPERMNO").alias("_linked")).distinct()
    out = (events.join(found, (F.col(id_col) == F.col("_id")) & F.col(date_col).eqNullSafe(F.col("_at")), "left")
           .join(linked, F.col(id_col) == F.col("_linked"), "left"))
    reason = F.when(F.col("_found"), F.lit(None)).when(F.col("_linked").isNull(), NO_LINK).otherwise(NONE_VALID)
    return out.withColumn("_reason", reason)


def unresolved_events(events: DataFrame, links: DataFrame, id_col: str = "PERMNO",
                      date_col: str = "DLSTDT") -> DataFrame:
    """(reason, n_events) of the events that :func:`resolve_links` drops."""
    asked = events.select(F.col(id_col).alias("_id"), F.col(date_col).alias("_at")).distinct()
    out = _with_reason(events, links, _choices(asked, links), id_col, date_col)
    return (out.where(F.col("_reason").isNotNull()).groupBy(F.col("_reason").alias("reason"))
            .agg(F.count(F.lit(1)).alias("n_events")))


def attach_event_windows(panel: DataFrame, events: DataFrame, kinds: dict[str, str], key: str = "gvkey",
                         date: str = "datadate", event_date: str = "event_date", kind: str = "kind") -> DataFrame:
    """Panel with, per kind of event, the latest date in ``(date, date + 1 year)`` or NULL (JN6 + SC7).

    ``kinds`` maps an output column to the value of ``events[kind]``. All kinds
    take part in one join. An event at ``t`` can only fall in the window of a row
    dated in ``year(t)`` or the year before, so the events of a firm are gathered
    per such year as sets of distinct dates: at most two years of days, however
    many events there are. The panel then meets at most one row of them, is not
    multiplied, and is read once.
    """
    e = events.select(F.col(key).alias("_k"), F.col(event_date).alias("_ev"), F.col(kind).alias("_kind"))
    e = e.withColumn("_yr", F.explode(F.array(F.year("_ev") - 1, F.year("_ev"))))
    dates = e.groupBy("_k", "_yr").agg(*[
        F.collect_set(F.when(F.col("_kind") == value, F.col("_ev"))).alias(f"_dates_{col}")
        for col, value in kinds.items()])
    met = panel.join(dates, (F.col(key) == F.col("_k")) & (F.year(date) == F.col("_yr")), "left")

    def latest(col: str):
        return F.array_max(F.filter(F.col(f"_dates_{col}"), lambda t: within_year_after(F.col(date), t)))

    return met.select(*panel.columns, *[latest(c).alias(c) for c in kinds])


def two_key_join(left: DataFrame, right: DataFrame, left_keys: Sequence[str],
                 right_keys: Sequence[str], drop_left_keys: bool = True) -> DataFrame:
    """Inner equi-join on differently named key pairs, left keys dropped (JN2 + PR1)."""
    cond = [left[lk] == right[rk] for lk, rk in zip(left_keys, right_keys)]
    out = left.join(right, cond, "inner")
    if drop_left_keys:
        out = out.drop(*[left[k] for k in left_keys])
    return out


def asof_match(loans: DataFrame, panel: DataFrame, key: str = "gvkey",
               start: str = "FacilityStartDate", date: str = "datadate",
               payload: Sequence[str] | None = None) -> DataFrame:
    """Each loan gets the panel row of the same firm with ``date < start < date + 1y``;
    among several the most recent ``date``; unmatched loans are dropped (JN8).

    A loan can only match a panel row dated in the year it starts or the year before, so
    the panel rows of a firm are gathered per such year, one per date: at most two years
    of days. A loan then meets at most one row of them and takes the latest within the
    year, so the loans are read once. Of several panel rows with one (firm, date) the
    greatest payload wins.
    """
    payload = list(payload) if payload else [c for c in panel.columns if c != key]
    rows = (panel.groupBy(F.col(key).alias("_pk"), F.col(date).alias("_date"))
            .agg(F.max(F.struct(*[F.col(c) for c in payload])).alias("_p")))
    years = (rows.withColumn("_yr", F.explode(F.array(F.year("_date"), F.year("_date") + 1)))
             .groupBy("_pk", "_yr").agg(F.collect_list(F.struct("_date", "_p")).alias("_rows")))
    # a loan without start matches no row. Were it dropped by the join key, Spark would test the
    # start, often an expression, ahead of the joins that bring the loans' firms, and compute it twice
    year = F.coalesce(F.year(start), F.lit(-1))
    met = loans.join(years, (F.col(key) == F.col("_pk")) & (year == F.col("_yr")))
    latest = F.array_max(F.filter("_rows", lambda r: within_year_after(r["_date"], F.col(start))))
    out = met.withColumn("_p", latest["_p"]).where(F.col("_p").isNotNull())
    return out.select(*loans.columns,
                      *[F.col("_p")[c].alias(c) for c in payload if c not in loans.columns])
