"""Streaming forms of the views (Structured Streaming, append mode).

Spark rejects ``OVER (...)`` on a stream, so a RANGE frame is written as what
it is: an interval self-join of the stream on the key followed by an
aggregation per current row.  Both are native stateful operators: the join
keeps each side's rows until the watermark passes the frame, and the
aggregation emits a row once its frame can no longer change.  The same holds
for the interval joins and the latest-row join.

The views run as steps over carried tables (:mod:`.steps`), whose cost does not grow
with the rows of a frame; the forms here are streaming DataFrames that other
operators of the same query can go on from.

Identical rows are counted, not given ids: an id drawn at random would
change when a lost task is run again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import MICROS, micros
from ..functions.scalars import floor_div

DEFAULT_DELAY = "30 seconds"      # the reorder bound of the upstream pipelines


def _interval(us: int) -> F.Column:
    return F.expr(f"INTERVAL '{us}' MICROSECOND") if us % 1_000_000 else \
        F.expr(f"INTERVAL '{us // 1_000_000}' SECOND")


def as_rowtime(df: DataFrame, col: str = "eventtime", delay: str = DEFAULT_DELAY
               ) -> DataFrame:
    """Declare ``col`` the event time of the stream, late by at most ``delay``
    (kept as it is when an upstream operator already carries one: chained
    stateful operators inherit the watermark)."""
    field = df.schema[col]
    if "spark.watermarkDelayMs" in field.metadata:
        return df
    if isinstance(field.dataType, T.TimestampNTZType):
        # watermarks need TIMESTAMP; zone-less input is read as session-zone time
        df = df.withColumn(col, F.col(col).cast("timestamp"))
    return df.withWatermark(col, delay)


def late_row_count(query) -> int:
    """Rows a streaming query's stateful operators dropped as late (behind the
    watermark), summed over its recorded progress."""
    total = 0
    for p in query.recentProgress:
        for op in p.get("stateOperators", []):
            total += int(op.get("numRowsDroppedByWatermark", 0))
    return total


def _us(col: str) -> F.Column:
    return F.unix_micros(F.col(col))


def stream_interval_join(left: DataFrame, right: DataFrame, key: str, time: str, lower,
                         upper, right_cols: list[str], delay: str = DEFAULT_DELAY,
                         bucket=None) -> DataFrame:
    """Stream-stream inner join: ``left.time BETWEEN right.time + lower AND
    right.time + upper`` on ``key``; both sides watermarked by ``delay``.

    The join key carries a time bucket (as wide as the bound), and right rows
    are copied to the two buckets the bound reaches, so a hot key is split by
    time and its rows meet only near ones."""
    lo, hi = micros(lower), micros(upper)
    b = micros(bucket) if bucket else max(hi - lo, MICROS["second"])
    l = as_rowtime(left, time, delay).withColumn("_b", floor_div(_us(time), b))
    r = as_rowtime(right.select(F.col(key).alias("_rkey"), F.col(time).alias("_rtime"),
                                *right_cols), "_rtime", delay)
    r = r.withColumn("_rb", F.explode(F.sequence(floor_div(_us("_rtime") + lo, b),
                                                 floor_div(_us("_rtime") + hi, b))))
    cond = ((F.col(key) == F.col("_rkey")) & (F.col("_b") == F.col("_rb"))
            & (F.col(time) >= F.col("_rtime") + _interval(lo) if lo >= 0 else
               F.col(time) >= F.col("_rtime") - _interval(-lo))
            & (F.col(time) <= F.col("_rtime") + _interval(hi) if hi >= 0 else
               F.col(time) <= F.col("_rtime") - _interval(-hi)))
    return l.join(r, cond, "inner").drop("_rkey", "_b", "_rb")


def join_view_forward(projection: DataFrame, sessions: DataFrame, minutes: int = 5,
                      delay: str = DEFAULT_DELAY) -> DataFrame:
    j = stream_interval_join(projection, sessions, "sessionid", "eventtime",
                             -minutes * MICROS["minute"], 0, ["cellid"], delay)
    return j.select("sessionid", "eventtime", "cellid", "octets", "packets")


def join_view_backward(projection: DataFrame, sessions: DataFrame, minutes: int = 5,
                       delay: str = DEFAULT_DELAY) -> DataFrame:
    j = stream_interval_join(projection, sessions, "sessionid", "eventtime", 0,
                             minutes * MICROS["minute"], ["cellid"], delay)
    return j.select("sessionid", "eventtime", "cellid", "octets", "packets")


#: name -> (aggregate, the frame value's expression, whether repeated rows repeat it)
STATS = {"minOctets": (F.min, None, False), "maxOctets": (F.max, None, False),
         "sumOctets": (F.sum, None, True), "countOctets": (F.count, None, True)}


def _frame_join(df: DataFrame, key: str, time: str, value: str, reach: int, delay: str,
                member, stats: dict) -> DataFrame:
    """Every row with the aggregates of its frame: an interval self-join on
    (key, time bucket), then an aggregation per distinct row.

    ``member`` is the frame's condition on the times; a row equal to the current
    one is always paired too.  ``m`` equal rows therefore count each other
    ``m * m`` times, which gives their number without an id per row (an id
    would not survive a recomputed task), and each frame is counted ``m`` times."""
    cur = as_rowtime(df.select(key, time, value), time, delay) \
        .withColumn("_b", floor_div(_us(time), reach))
    frame = as_rowtime(df.select(F.col(key).alias("_fk"), F.col(time).alias("_ft"),
                                 F.col(value).alias("_fv")), "_ft", delay)
    frame = frame.withColumn("_fb", F.explode(F.sequence(
        floor_div(_us("_ft"), reach), floor_div(_us("_ft") + reach, reach))))
    same = (F.col("_ft") == F.col(time)) & F.col("_fv").eqNullSafe(F.col(value))
    # the plain range on the two times lets the join evict its state
    cond = (F.col(key).eqNullSafe(F.col("_fk")) & (F.col("_b") == F.col("_fb"))
            & (F.col("_ft") >= F.col(time) - _interval(reach)) & (F.col("_ft") <= F.col(time))
            & (member | same))
    g = cur.join(frame, cond, "inner").groupBy(time, key, value).agg(
        F.count(F.when(same, F.lit(1))).alias("_mm"),
        *[f(F.when(member, F.col("_fv") if e is None else e)).alias(n)
          for n, (f, e, _) in stats.items()])
    m = F.sqrt(F.col("_mm")).cast("bigint")
    g = g.select(key, value, time, m.alias("_m"), *stats)
    out = g.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_m"))))
    return out.select(key, value, time, *[
        F.expr(f"{n} div _m").alias(n) if scaled else F.col(n)
        for n, (_, _, scaled) in stats.items()])


def stream_over(df: DataFrame, key: str, time: str = "eventtime", value: str = "octets",
                preceding=60 * MICROS["minute"], delay: str = DEFAULT_DELAY,
                stats: dict | None = None) -> DataFrame:
    """``min/max/sum/count(value) OVER (PARTITION BY key ORDER BY time RANGE
    BETWEEN preceding PRECEDING AND CURRENT ROW)`` on a stream."""
    p = micros(preceding)
    member = (F.col("_ft") >= F.col(time) - _interval(p)) & (F.col("_ft") <= F.col(time))
    return _frame_join(df, key, time, value, p, delay, member, stats or STATS)


def stream_offset_over(df: DataFrame, key: str, time: str = "eventtime",
                       value: str = "octets", preceding=60 * MICROS["minute"],
                       unit: str = "minute", delay: str = DEFAULT_DELAY) -> DataFrame:
    """Offset frame on a stream: ordered by ``date_trunc(unit, time)``, from
    ``preceding`` before the row's bucket up to (not including) that bucket.
    Rows whose frame is empty stay (count 0, NULL stats)."""
    p, u = micros(preceding), MICROS[unit]
    lb = F.date_trunc(unit, F.col(time))
    member = (F.col("_ft") >= lb - _interval(p)) & (F.col("_ft") < lb)
    return _frame_join(df, key, time, value, p + u, delay, member, STATS)


def bollinger_view(projection: DataFrame, minutes: int = 60, width: float = 2.0,
                   digits: int | None = None, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Bollinger bands on a stream, from the exact count, sum and sum of
    squares of each frame (the bands do not change when all three are counted
    several times)."""
    from ..operators.windows import bands
    exact = F.col("_fv").cast("decimal(19,0)")
    stats = {"_n": (F.count, None, False), "_s": (F.sum, exact, False),
             "_ss": (F.sum, (exact * exact).cast("decimal(38,0)"), False)}
    out = stream_over(projection, "sessionid", preceding=minutes * MICROS["minute"],
                      delay=delay, stats=stats)
    return bands(out, width, digits)


def count_total(agg: DataFrame, time: str = "eventtime", width: str = "1 minute",
                stats=tuple(STATS)) -> DataFrame:
    """The non-NULL counts of the statistics columns per ``width`` of event
    time; their sum over a bounded run is the batch ``count_total``."""
    total = None
    for c in stats:
        total = F.count(c) if total is None else total + F.count(c)
    out = agg.groupBy(F.window(time, width)).agg(total.alias("count_total"))
    return out.select(F.col("window.start").alias(time), "count_total")


def flows_agg_step_1(ingested: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    """Per session, the 60..1-minute offset frame on the minute of each row."""
    out = stream_offset_over(ingested.withColumnRenamed("rowtime", "_rowtime")
                             .select("sessionid", F.col("_rowtime").alias("eventtime"),
                                     "octets"), "sessionid", delay=delay)
    return out.select("sessionid", "eventtime", *STATS)


def join_n_agg_view2(joined: DataFrame, delay: str = DEFAULT_DELAY) -> DataFrame:
    out = stream_offset_over(joined, "cellid", delay=delay)
    return out.select("cellid", "octets", "eventtime", *STATS)


def agg_view(projection: DataFrame, minutes: int = 60, delay: str = DEFAULT_DELAY
             ) -> DataFrame:
    return stream_over(projection, "sessionid", preceding=minutes * MICROS["minute"],
                       delay=delay)


def join_n_agg_view(joined: DataFrame, minutes: int = 60, delay: str = DEFAULT_DELAY
                    ) -> DataFrame:
    out = stream_over(joined, "cellid", preceding=minutes * MICROS["minute"], delay=delay)
    return out.select("cellid", "octets", "eventtime", *STATS)


def t_sort(df: DataFrame, time: str = "eventtime", bound: str = DEFAULT_DELAY) -> DataFrame:
    """Bounded reorder ahead of a stateful operator: the watermark, by which
    that operator waits for and drops rows (held rows would reach it behind its
    own watermark).  The view ``t_sort`` of :mod:`.carried` is the reorder that
    ends a query."""
    return df.withWatermark(time, bound)


def throughput_meter(df: DataFrame, eventtime: str = "eventtime", delay: str = "0 seconds",
                     start=None) -> DataFrame:
    """Rows per 1-second window of processing time (``current_timestamp()`` is
    fixed per micro-batch in Spark, so a batch's rows share one second) and
    the latest event time seen in it; with ``start`` (the test's start time)
    also the elapsed seconds less the start-up allowance, as in batch."""
    from ..functions.scalars import elapsed_seconds
    from ..operators.meters import STARTUP_ALLOWANCE_SECONDS
    x = df.withColumn("_arrival", F.current_timestamp()).withWatermark("_arrival", delay)
    g = x.groupBy(F.window("_arrival", "1 second")).agg(
        F.count(F.lit(1)).alias("recs_per_sec"), F.max(eventtime).alias("max_event_time"))
    out = g.select(F.col("window.start").alias("clocktime"), "recs_per_sec", "max_event_time")
    if start is not None:
        out = out.withColumn("testsecs", elapsed_seconds(
            "clocktime", F.lit(start).cast("timestamp"), STARTUP_ALLOWANCE_SECONDS))
    return out


def stream_rate(df: DataFrame, eventtime: str = "eventtime", arrival: str | None = None,
                delay: str = "0 seconds") -> DataFrame:
    """Per arrival second: rows, lowest and highest event time (the stateful
    half of the per-second meters).  ``arrival`` defaults to processing time
    (``current_timestamp()``, fixed per micro-batch).  Running columns are
    added when the sink table is read, see :func:`finish_rate`."""
    col = arrival or "_arrival"
    x = df if arrival else df.withColumn("_arrival", F.current_timestamp())
    x = as_rowtime(x, col, delay)
    g = x.groupBy(F.window(col, "1 second")).agg(
        F.count(F.lit(1)).alias("rps"), F.min(eventtime).alias("rowtime_low"),
        F.max(eventtime).alias("rowtime_high"))
    return g.select(F.col("window.start").alias("rowtime"), "rps", "rowtime_low",
                    "rowtime_high")


def finish_rate(per_second: DataFrame, digits: int | None = None) -> DataFrame:
    """Cumulative rows and the running average of per-second rates over a
    stream's per-second table (a batch step: append mode cannot carry a
    global running sum)."""
    from ..functions.prefix import prefix_aggregate
    run = prefix_aggregate(per_second, "rowtime", {"cumulative_rows": ("sum", "rps"),
                                                   "_n": ("count", "*")})
    avg = F.col("cumulative_rows") / F.col("_n")
    if digits is not None:
        avg = F.round(avg, digits)
    return run.select("rowtime", "rps", "cumulative_rows", "rowtime_low", "rowtime_high",
                      avg.alias("avg_rps"))


def flows_agg_step_2(agg: DataFrame, sessions: DataFrame, minutes: int = 5,
                     delay: str = DEFAULT_DELAY) -> DataFrame:
    """Sharded catalog, second job: offset-frame statistics per session joined
    to that session's rows of the preceding ``minutes`` (both streams)."""
    j = stream_interval_join(agg, sessions, "sessionid", "eventtime", 0,
                             minutes * MICROS["minute"], ["cellid"], delay)
    return j.select("sessionid", "eventtime", "cellid", "minOctets", "maxOctets",
                    "sumOctets", "countOctets")
