"""Sliding-window views: per-session and per-cell frame statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import MICROS, range_frame
from ..functions.scalars import time_of_day

# the four statistics every agg view computes, under their upstream names
OCTET_STATS = {
    "minOctets": ("min", "octets"),
    "maxOctets": ("max", "octets"),
    "sumOctets": ("sum", "octets"),
    "countOctets": ("count", "octets"),
}
STAT_COLUMNS = list(OCTET_STATS)

AGG_VIEW_WIDTHS = {"agg_view": 60, "agg_view_60m": 60, "agg_view_20m": 20,
                   "agg_view_10m": 10, "agg_view_5m": 5, "agg_view_2m": 2, "agg_view_1m": 1}


def agg_view(projection: DataFrame, minutes: int = 60, **plan) -> DataFrame:
    """min/max/sum/count of ``octets`` per session over the preceding ``minutes``
    of event time, current row and its peers included.  The two-level plan is
    linear in the rows, also for a hot session."""
    plan.setdefault("strategy", "two_level")
    out = range_frame(projection, ["sessionid"], "eventtime", OCTET_STATS,
                      minutes * MICROS["minute"], **plan)
    return out.select("sessionid", "octets", "eventtime", *STAT_COLUMNS)


def join_n_agg_view(joined: DataFrame, minutes: int = 60, **plan) -> DataFrame:
    """The same statistics per cell over a join view's rows.

    A cell's frame holds every flow of every session in it for an hour, so
    the frames are dense: the two-level plan is the default here.  The join is
    evaluated once (``once``)."""
    plan.setdefault("strategy", "two_level")
    plan.setdefault("once", True)
    out = range_frame(joined, ["cellid"], "eventtime", OCTET_STATS,
                      minutes * MICROS["minute"], **plan)
    return out.select("cellid", "octets", "eventtime", *STAT_COLUMNS)


def join_n_agg_view2(joined: DataFrame, **plan) -> DataFrame:
    """Per cell, ordered by the minute of each row, over the 60 minutes before
    the row's minute and excluding it; an empty frame gives NULL min/max/sum
    and a count of 0.  The join is evaluated once."""
    plan.setdefault("once", True)
    out = range_frame(joined, ["cellid"], "eventtime", OCTET_STATS, 60 * MICROS["minute"],
                      MICROS["minute"], floor="minute", **plan)
    return out.select("cellid", "octets", "eventtime", *STAT_COLUMNS)


def flows_agg_step_1(ingested: DataFrame, **plan) -> DataFrame:
    """Sharded catalog: per session, minute-ordered offset frame (60..1 minute
    preceding); the row's own octets are not projected."""
    out = range_frame(ingested, ["sessionid"], "rowtime", OCTET_STATS,
                      60 * MICROS["minute"], MICROS["minute"], floor="minute", **plan)
    return out.select("sessionid", F.col("rowtime").alias("eventtime"), *STAT_COLUMNS)


def bollinger_view(projection: DataFrame, minutes: int = 60, width: float = 2.0,
                   digits: int | None = None, **plan) -> DataFrame:
    """Bollinger bands of ``octets`` per session: mean +- ``width`` population
    standard deviations over the preceding ``minutes``.  The deviation comes
    from the exact (decimal) count, sum and sum of squares, which merge, so
    the linear two-level plan holds and nothing cancels."""
    plan.setdefault("strategy", "two_level")
    out = range_frame(band_values(projection), ["sessionid"], "eventtime", BAND_STATS,
                      minutes * MICROS["minute"], **plan)
    return bands(out, width, digits)


BAND_STATS = {"_n": ("count", "octets"), "_s": ("sum", "_v"), "_ss": ("sum", "_vv")}


def band_values(projection: DataFrame) -> DataFrame:
    """Rows with the exact value and its square, which the bands are summed from."""
    exact = F.col("octets").cast("decimal(19,0)")
    return projection.select("sessionid", "octets", "eventtime", exact.alias("_v"),
                             (exact * exact).cast("decimal(38,0)").alias("_vv"))


def bands(out: DataFrame, width: float, digits: int | None) -> DataFrame:
    """The bands of rows that hold their frame's count ``_n``, sum ``_s`` and
    sum of squares ``_ss``."""
    n, total = F.col("_n").cast("decimal(19,0)"), F.col("_s").cast("decimal(38,0)")
    # n * sum of squares - sum^2, exact
    spread = (n * F.col("_ss") - total.cast("decimal(30,0)") * total.cast("decimal(30,0)")).cast("double")
    mean = F.col("_s").cast("double") / F.col("_n")
    sd = F.sqrt(spread) / F.col("_n")
    upper, lower = mean + F.lit(width) * sd, mean - F.lit(width) * sd
    if digits is not None:
        upper, lower = F.round(upper, digits), F.round(lower, digits)
    return out.select("sessionid", "octets", "eventtime", upper.alias("upper_bb"),
                      lower.alias("lower_bb"))


TESTWINDOW_STATS = {
    "_min_et": ("min", "event_time"),
    "_max_et": ("max", "event_time"),
    "min_c1": ("min", "c1"),
    "max_c1": ("max", "c1"),
    "cnt": ("count", "*"),
}


def testwindow_v2(testwindow: DataFrame, minutes: int = 2, **plan) -> DataFrame:
    """No partition; ordered by each row's minute, frame from ``minutes`` before
    that minute to the current minute (peers included): min/max time (as time
    of day), min/max ``c1`` (binary order), COUNT(*)."""
    out = range_frame(testwindow, [], "event_time", TESTWINDOW_STATS,
                      minutes * MICROS["minute"], floor="minute", **plan)
    return out.select(time_of_day("event_time").alias("event_time"), "c1",
                      time_of_day("_min_et").alias("min_et"),
                      time_of_day("_max_et").alias("max_et"), "min_c1", "max_c1", "cnt")
