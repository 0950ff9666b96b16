"""Throughput meters: per-second rates of a view's output.

A meter groups a view's rows by the wall-clock second they arrived in.  In
batch the arrival time is a column of the rows (the records' load time); in
a stream it is captured when rows are read (``current_timestamp()`` is fixed
per micro-batch in Spark, so it cannot time rows inside one).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import prefix_aggregate
from ..functions.scalars import elapsed_seconds, elapsed_seconds_ms

# seconds of start-up excluded from the elapsed-time column of the
# per-second meter (fixed value of the upstream harness)
STARTUP_ALLOWANCE_SECONDS = 6


def data_rate(df: DataFrame, arrival: str = "arrival", rowtime: str = "eventtime",
              start=None) -> DataFrame:
    """Rows per arrival second: rps, cumulative rows, the lowest and highest
    event time seen in that second, and seconds since the start.  Seconds with
    no rows do not appear (``RPS > 0``)."""
    per = (df.groupBy(F.date_trunc("second", arrival).alias("rowtime"))
             .agg(F.count(F.lit(1)).alias("rps"),
                  F.min(rowtime).alias("rowtime_low"),
                  F.max(rowtime).alias("rowtime_high")))
    per = per.filter(F.col("rps") > 0)
    # in time order the running minimum is the first second: no second pass for it
    cum = prefix_aggregate(per, "rowtime", {"cumulative_rows": ("sum", "rps"),
                                            "_start": ("min", "rowtime")}, per_second=True)
    s = F.col("_start") if start is None else F.lit(start).cast("timestamp")
    return cum.select("rowtime", "rps", "cumulative_rows", "rowtime_low", "rowtime_high",
                      elapsed_seconds_ms("rowtime", s).alias("testsecs"))


def count_total(agg: DataFrame, stats=("minOctets", "maxOctets", "sumOctets", "countOctets")
                ) -> DataFrame:
    """Sum of the non-NULL counts of the statistics columns: a cheap check that
    two runs produced the same frames."""
    total = None
    for c in stats:
        e = F.count(c)
        total = e if total is None else total + e
    return agg.agg(total.alias("count_total"))


def throughput_meter(df: DataFrame, arrival: str = "arrival", eventtime: str = "eventtime",
                     start=None, stats: list[str] | None = None) -> DataFrame:
    """Per 1-second tumbling window of arrival time: clock time, rows, the
    latest event time, seconds since start less the start-up allowance, and
    (``stats``) the non-NULL statistics count of an aggregate view."""
    aggs = [F.count(F.lit(1)).alias("recs_per_sec"), F.max(eventtime).alias("max_event_time")]
    if stats:
        total = None
        for c in stats:
            total = F.count(c) if total is None else total + F.count(c)
        aggs.append(total.alias("count_total"))
    per = df.groupBy(F.window(arrival, "1 second")).agg(*aggs, F.min(arrival).alias("_first"))
    per = per.select(F.col("window.start").alias("clocktime"), *[a for a in per.columns
                                                                   if a != "window"])
    if start is None:
        per = prefix_aggregate(per, "clocktime", {"_start": ("min", "_first")}, per_second=True)
        s = F.col("_start")
    else:
        s = F.lit(start).cast("timestamp")
    return per.withColumn("testsecs", elapsed_seconds(
        "clocktime", s, STARTUP_ALLOWANCE_SECONDS)).drop("_first", "_start")


def running_avg_rps(df: DataFrame, arrival: str = "arrival", digits: int | None = None
                    ) -> DataFrame:
    """Rows per second of arrival, and the average of those per-second counts
    over all seconds so far (seconds without rows do not count)."""
    per = df.groupBy(F.date_trunc("second", arrival).alias("second")).agg(
        F.count(F.lit(1)).alias("rps"))
    run = prefix_aggregate(per, "second", {"_sum": ("sum", "rps"), "_n": ("count", "*")},
                           per_second=True)
    avg = F.col("_sum") / F.col("_n")
    if digits is not None:
        avg = F.round(avg, digits)
    return run.select("second", "rps", avg.alias("avg_rps"))
