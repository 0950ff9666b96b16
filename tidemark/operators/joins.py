"""Event-time joins of flows with sessions (equi on ``sessionid``).

``interval_join`` keeps pairs whose times lie within a bound of each other.
A plain equi join on the key compares every pair of a key, so a hot session
costs its rows squared; here the left time is cut into buckets of the bound's
width and each right row is copied to the (at most three) buckets its bound
reaches, so the join key is ``(key, bucket)`` and only near pairs are compared.

``latest_join`` is an as-of join with a timeout: each flow takes the latest
session row of its key at or before it, if that row is at most ``timeout``
old.  It needs no pairs at all: both inputs are unioned and, in (time,
sessions first, cell) order, the last session row seen is carried to each
flow (an incremental ``last(..., ignorenulls)``), per ``(key, time chunk)``
with a one-timeout look-back, so a hot key is split by time too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import MICROS, lookback_chunks, micros
from ..functions.scalars import floor_div

ONE_HOUR = MICROS["hour"]


def interval_join(left: DataFrame, right: DataFrame, key: str, left_time: str,
                  right_time: str, lower, upper, *, bucket=None,
                  right_cols: list[str] | None = None) -> DataFrame:
    """Inner join on ``key`` where ``left_time`` lies in
    ``[right_time + lower, right_time + upper]`` (both ends inclusive).

    ``right_cols`` are the right-side columns to keep (besides none of its key
    and time); names must not clash with the left side."""
    lo, hi = micros(lower), micros(upper)
    right_cols = right_cols or [c for c in right.columns if c not in (key, right_time)]
    l, r = interval_sides(left, right, key, left_time, right_time, lo, hi, right_cols, bucket)
    return interval_pairs(l, r, key, lo, hi, left.columns, right_cols)


def interval_sides(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, lower, upper,
                   right_cols: list[str], bucket=None) -> tuple[DataFrame, DataFrame]:
    """Both sides with the columns that an interval join is dealt by: the key and a
    time bucket ``_b``; right rows are copied to the buckets their bound reaches."""
    lo, hi = micros(lower), micros(upper)
    if lo > hi:
        raise ValueError("lower bound above upper bound")
    b = micros(bucket) if bucket else max(hi - lo, MICROS["second"])
    l = left.withColumn("_lus", F.unix_micros(F.col(left_time))).withColumn("_b", floor_div(F.col("_lus"), b))
    r = right.select(F.col(key).alias("_rkey"), F.unix_micros(F.col(right_time)).alias("_rus"), *right_cols)
    first, last = floor_div(F.col("_rus") + lo, b), floor_div(F.col("_rus") + hi, b)
    return l, r.withColumn("_b", F.explode(F.sequence(first, last)))


def interval_pairs(l: DataFrame, r: DataFrame, key: str, lower, upper, left_cols: list[str],
                   right_cols: list[str]) -> DataFrame:
    """The pairs of two :func:`interval_sides`."""
    cond = ((l[key] == r["_rkey"]) & (l["_b"] == r["_b"])
            & (l["_lus"] >= r["_rus"] + micros(lower)) & (l["_lus"] <= r["_rus"] + micros(upper)))
    return l.join(r, cond, "inner").select(*[l[c] for c in left_cols], *[r[c] for c in right_cols])


JOIN_COLUMNS = ["sessionid", "eventtime", "cellid", "octets", "packets"]


def join_view_forward(projection: DataFrame, sessions: DataFrame, minutes: int = 5,
                      **kw) -> DataFrame:
    """Each flow paired with every session row of its key at or after it by at
    most ``minutes``: ``f.t BETWEEN s.t - minutes AND s.t``."""
    j = interval_join(projection, sessions, "sessionid", "eventtime", "eventtime",
                      -minutes * MICROS["minute"], 0, right_cols=["cellid"], **kw)
    return j.select(*JOIN_COLUMNS)


def join_view_backward(projection: DataFrame, sessions: DataFrame, minutes: int = 5,
                       **kw) -> DataFrame:
    """Each flow paired with every session row of its key in the ``minutes``
    before it: ``s.t BETWEEN f.t - minutes AND f.t``."""
    j = interval_join(projection, sessions, "sessionid", "eventtime", "eventtime",
                      0, minutes * MICROS["minute"], right_cols=["cellid"], **kw)
    return j.select(*JOIN_COLUMNS)


def latest_join(flows: DataFrame, sessions: DataFrame, key: str = "sessionid",
                time: str = "eventtime", value: str = "cellid", timeout=ONE_HOUR,
                chunk=None) -> DataFrame:
    """Flows joined to the latest session row of their key at or before them,
    unless that row is more than ``timeout`` older (inclusive).  Equal session
    times: the largest ``value`` wins."""
    t = micros(timeout)
    c = micros(chunk) if chunk else max(4 * t, MICROS["day"])
    fcols = flows.columns
    # as in any equi join, a NULL key matches nothing
    flows, sessions = flows.filter(F.col(key).isNotNull()), sessions.filter(F.col(key).isNotNull())
    # flows stay in their own chunk; session rows are also copied into the
    # following chunks one timeout can reach
    f = flows.select(*fcols, F.lit(None).cast(sessions.schema[value].dataType).alias("_val"),
                     F.lit(True).alias("_is_flow"),
                     F.unix_micros(F.col(time)).alias("_us"))
    f = f.withColumn("_chunk", floor_div(F.col("_us"), c)).withColumn("_own", F.lit(True))
    s_extra = [F.lit(None).cast(flows.schema[x].dataType).alias(x)
               for x in fcols if x not in (key, time)]
    s = sessions.select(F.col(key), F.col(time), *s_extra,
                        F.col(value).alias("_val"),
                        F.lit(False).alias("_is_flow"),
                        F.unix_micros(F.col(time)).alias("_us"))
    s = lookback_chunks(s, F.col("_us"), t, c)
    cols = [*fcols, "_val", "_is_flow", "_us", "_chunk", "_own"]
    x = f.select(*cols).unionByName(s.select(*cols))
    # in (time, sessions before flows, cell) order the last session row at or
    # before a flow is the latest one, the largest cell among equal times
    w = (Window.partitionBy(key, "_chunk").orderBy("_us", "_is_flow", "_val")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    latest = F.last(F.when(~F.col("_is_flow"), F.struct(F.col("_us").alias("t"),
                                                         F.col("_val").alias("v"))),
                    ignorenulls=True).over(w)
    y = x.withColumn("_latest", latest).filter(F.col("_is_flow") & F.col("_own"))
    y = y.filter(F.col("_latest").isNotNull() & (F.col("_us") - F.col("_latest.t") <= t))
    return y.select(*fcols, F.col("_latest.v").alias(value))


def session_join_view(projection: DataFrame, sessions: DataFrame, timeout=ONE_HOUR,
                      **kw) -> DataFrame:
    """Each flow with the cell of its session's latest row within ``timeout``."""
    j = latest_join(projection, sessions, timeout=timeout, **kw)
    return j.select("sessionid", "eventtime", "cellid", "octets", "packets")


def flows_agg_step_2(agg: DataFrame, sessions: DataFrame, minutes: int = 5,
                     session: bool = False) -> DataFrame:
    """Offset-frame statistics per session joined to the session rows of the
    preceding ``minutes`` (or, with ``session=True``, to the latest session row
    within an hour)."""
    stats = ["minOctets", "maxOctets", "sumOctets", "countOctets"]
    s = sessions.select("sessionid", "eventtime", "cellid")
    if session:
        j = latest_join(agg, s)
    else:
        j = interval_join(agg, s, "sessionid", "eventtime", "eventtime", 0,
                          minutes * MICROS["minute"], right_cols=["cellid"])
    return j.select("sessionid", "eventtime", "cellid", *stats)
