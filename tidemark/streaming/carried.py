"""The views as steps over carried tables (see :mod:`.steps`).

Inputs are ``flows`` (the projection) and ``sessions``, both with ``eventtime``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import (MICROS, bucket_partials, bucketed_over, micros, range_frame,
                                two_level_over)
from ..functions.prefix import prefix_aggregate
from ..functions.scalars import time_of_day
from ..operators import joins, windows
from .steps import Slice, View

MINUTE = MICROS["minute"]


def _us(col: str = "eventtime") -> Column:
    return F.unix_micros(F.col(col))


def row_frames(s: Slice, name: str, keys: list[str], aggs: dict, preceding: int, lo: int, hi: int,
               shape=lambda df: df) -> DataFrame:
    """Rows of ``name`` in ``[lo, hi)`` with the aggregates of ``[t - preceding, t]``.
    The frame is cut into 60 buckets: a closed bucket is reduced once to one row per
    key and carried; a step reads those, the rows of the buckets at hand and those
    of the buckets one frame width before."""
    b = preceding // 60
    first, closed, up = lo // b * b, hi // b * b, -(-hi // b) * b
    panes = f"{name}_panes_{preceding}"

    def partials(since: int, before: int) -> DataFrame:
        return bucket_partials(shape(s.rows(name, since, before)), keys, "eventtime", aggs, b)
    if closed > first:
        s.keep(panes, partials(first, closed), F.col("_b") * b, preceding + b)
    whole = s.rows(panes, first - preceding, closed) if s.known(panes) else None
    each = partials(closed, hi) if whole is None else whole.unionByName(partials(closed, hi))
    out = two_level_over(shape(s.rows(name, first, hi)), shape(s.rows(name, first - preceding, up - preceding)),
                         each, keys, "eventtime", aggs, preceding, b)
    return out.where(_us() >= lo)


def offset_frames(s: Slice, name: str, keys: list[str], preceding: int, lo: int, hi: int,
                  unit: int = MINUTE) -> DataFrame:
    """Rows of ``name`` in ``[lo, hi)`` with the aggregates of the whole minutes from
    ``preceding`` before theirs up to the one before; minutes are carried as one row
    per key, so state grows with them and not with rows."""
    first, closed = lo // unit * unit, hi // unit * unit
    panes = f"{name}_minutes"
    if closed > first or not s.known(panes):
        part = bucket_partials(s.rows(name, first, closed), keys, "eventtime", windows.OCTET_STATS, unit)
        s.keep(panes, part, F.col("_b") * unit, preceding + unit)
    return bucketed_over(s.rows(name, lo, hi), s.rows(panes, first - preceding, closed), keys, "eventtime",
                         windows.OCTET_STATS, preceding, unit, unit)


def agg_view(minutes: int = 60) -> View:
    p = minutes * MINUTE

    def step(s: Slice) -> DataFrame:
        out = row_frames(s, "flows", ["sessionid"], windows.OCTET_STATS, p, s.lo, s.hi)
        return out.select("sessionid", "octets", "eventtime", *windows.STAT_COLUMNS)
    return View(step, {"flows": p + p // 60})


def bollinger_view(minutes: int = 60, width: float = 2.0, digits: int | None = None) -> View:
    p = minutes * MINUTE

    def step(s: Slice) -> DataFrame:
        out = row_frames(s, "flows", ["sessionid"], windows.BAND_STATS, p, s.lo, s.hi, windows.band_values)
        return windows.bands(out, width, digits)
    return View(step, {"flows": p + p // 60})


def count_total(minutes: int = 60) -> View:
    """The non-NULL statistics of the rows of each step; their sum is the batch check."""
    from ..operators import meters
    view = agg_view(minutes)
    return View(lambda s: meters.count_total(view.step(s)).select(
        F.timestamp_micros(F.lit(s.hi)).alias("eventtime"), "count_total"), view.reach)


def _joined(s: Slice, lag: int, reach: int, forward: bool) -> tuple[DataFrame, int, int]:
    """Joined rows that are final, and their times: a forward join knows a flow's
    session rows only when the watermark is ``lag`` past it."""
    if forward:
        lo, hi = s.lo - lag, s.hi if s.last else s.hi - lag
        out = joins.join_view_forward(s.rows("flows", lo, hi), s.rows("sessions", lo, hi + lag), lag // MINUTE)
        return out, lo, hi
    out = joins.join_view_backward(s.fresh("flows"), s.rows("sessions", s.lo - lag, s.hi), lag // MINUTE)
    return out, s.lo, s.hi


def join_view(minutes: int = 5, forward: bool = False) -> View:
    lag = minutes * MINUTE
    return View(lambda s: _joined(s, lag, 0, forward)[0], {"flows": lag if forward else 0, "sessions": lag})


def join_n_agg_view(minutes: int = 60, join_minutes: int = 5, forward: bool = False) -> View:
    """The joined rows are made once, carried, and framed per cell."""
    p, lag = minutes * MINUTE, join_minutes * MINUTE

    def step(s: Slice) -> DataFrame:
        joined, lo, hi = _joined(s, lag, 0, forward)
        s.keep("joined", joined, _us(), p + p // 60 + lag)
        out = row_frames(s, "joined", ["cellid"], windows.OCTET_STATS, p, lo, hi)
        return out.select("cellid", "octets", "eventtime", *windows.STAT_COLUMNS)
    return View(step, {"flows": lag if forward else 0, "sessions": lag})


def join_n_agg_view2(minutes: int = 60, join_minutes: int = 5) -> View:
    p, lag = minutes * MINUTE, join_minutes * MINUTE

    def step(s: Slice) -> DataFrame:
        joined, lo, hi = _joined(s, lag, 0, False)
        s.keep("joined", joined, _us(), MINUTE)
        out = offset_frames(s, "joined", ["cellid"], p, lo, hi)
        return out.select("cellid", "octets", "eventtime", *windows.STAT_COLUMNS)
    return View(step, {"sessions": lag})


def _agg_step_1(s: Slice, minutes: int) -> DataFrame:
    out = offset_frames(s, "flows", ["sessionid"], minutes * MINUTE, s.lo, s.hi)
    return out.select("sessionid", "eventtime", *windows.STAT_COLUMNS)


def flows_agg_step_1(minutes: int = 60) -> View:
    return View(lambda s: _agg_step_1(s, minutes), {"flows": MINUTE})


def flows_agg_step_2(minutes: int = 60, join_minutes: int = 5) -> View:
    """Offset frames per session, joined to its session rows of the minutes before."""
    lag = join_minutes * MINUTE
    return View(lambda s: joins.flows_agg_step_2(_agg_step_1(s, minutes), s.rows("sessions", s.lo - lag, s.hi), join_minutes),
                {"flows": MINUTE, "sessions": lag})


def session_join_view(timeout=MICROS["hour"]) -> View:
    """Each flow with its session's latest row; what is carried is the latest row of
    each session (of equal times the largest cell), not its rows."""
    t = micros(timeout)

    def step(s: Slice) -> DataFrame:
        rows = s.fresh("sessions").select("sessionid", "eventtime", "cellid").where("sessionid IS NOT NULL")
        before = s.table("latest")
        if before is not None:
            rows = rows.unionByName(before)
        top = rows.where(_us() >= s.hi - t).groupBy("sessionid").agg(F.max(F.struct("eventtime", "cellid")).alias("r"))
        s.replace("latest", top.select("sessionid", "r.eventtime", "r.cellid"))
        return joins.session_join_view(s.fresh("flows"), rows, t)
    return View(step)


def projection_view() -> View:
    return View(lambda s: s.fresh("flows"))


def t_sort() -> View:
    """Rows in event-time order, over all steps; files in name order ascend.  Ties go
    on by the other columns, so that a burst in one instant is dealt to many tasks."""
    def step(s: Slice) -> DataFrame:
        x = s.fresh("flows")
        return x.orderBy("eventtime", *[c for c in x.columns if c != "eventtime"])
    return View(step)


def testwindow_v2(minutes: int = 2) -> View:
    """The unkeyed minute frame over input ``rows``; a minute comes out when it closes."""
    p = minutes * MINUTE

    def step(s: Slice) -> DataFrame:
        lo, hi = s.floor(MINUTE)
        out = range_frame(s.rows("rows", lo - p, hi), [], "event_time", windows.TESTWINDOW_STATS, p, floor="minute")
        out = out.where(_us("event_time") >= lo)
        return out.select(time_of_day("event_time").alias("event_time"), "c1", time_of_day("_min_et").alias("min_et"),
                          time_of_day("_max_et").alias("max_et"), "min_c1", "max_c1", "cnt")
    return View(step, {"rows": p + MINUTE})


def running_rate(arrival: str = "arrival", eventtime: str = "eventtime", digits: int | None = None) -> View:
    """Rows of each second of arrival, all rows so far, and the average of the seconds
    so far: a prefix over the new seconds, from the two numbers carried."""
    second = MICROS["second"]

    def step(s: Slice) -> DataFrame:
        lo, hi = s.floor(second)
        per = s.rows("rows", lo, hi).groupBy(F.date_trunc("second", arrival).alias("rowtime")).agg(
            F.count(F.lit(1)).alias("rps"), F.min(eventtime).alias("rowtime_low"), F.max(eventtime).alias("rowtime_high"))
        s.keep("seconds", per, _us("rowtime"), 0)
        per, before = s.rows("seconds", lo, hi), s.table("totals")
        total, n = before.first() if before is not None else (0, 0)
        s.replace("totals", per.agg((F.coalesce(F.sum("rps"), F.lit(0)) + F.lit(total)).alias("total"),
                                    (F.count("*") + F.lit(n)).alias("n")))
        run = prefix_aggregate(per, "rowtime", {"_sum": ("sum", "rps"), "_k": ("count", "*")}, per_second=True)
        cumulative = F.col("_sum") + F.lit(total)
        avg = cumulative / (F.col("_k") + F.lit(n))
        return run.select("rowtime", "rps", cumulative.alias("cumulative_rows"), "rowtime_low", "rowtime_high",
                          (avg if digits is None else F.round(avg, digits)).alias("avg_rps"))
    return View(step, {"rows": second})
