"""Arrival-order lateness: the bounded reorder ("T-sort") of a stream.

A row is late when its event time is more than ``bound`` behind the newest
event time of the rows that arrived before it.  Batch: the running maximum is
a distributed prefix maximum in arrival order.  Stream: a watermark of
``bound`` on the event time does the same job per micro-batch (a weaker rule:
Spark advances the watermark between batches, so it never drops a row the
batch rule keeps).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.frames import MICROS, micros
from ..functions.prefix import prefix_aggregate

REORDER_BOUND = 30 * MICROS["second"]


def mark_late(df: DataFrame, eventtime: str = "eventtime", arrival: str = "arrival",
              tiebreak: list[str] | None = None, bound=REORDER_BOUND,
              chunk=MICROS["minute"]) -> DataFrame:
    """Add ``late`` (boolean) and ``newest_before`` (the running maximum event
    time of earlier arrivals) to each row."""
    b = micros(bound)
    x = prefix_aggregate(df, arrival, {"newest_before": ("max", eventtime)},
                         tiebreak=tiebreak, include_current=False, chunk=chunk)
    late = F.coalesce(F.unix_micros(eventtime) < F.unix_micros("newest_before") - F.lit(b),
                      F.lit(False))
    return x.withColumn("late", late)


def late_rows(df: DataFrame, **kw) -> DataFrame:
    """The rows a bounded reorder drops."""
    return mark_late(df, **kw).filter("late").drop("late")


def t_sort(df: DataFrame, eventtime: str = "eventtime", stream: bool = False,
           bound=REORDER_BOUND, sort: bool = True, **kw) -> DataFrame:
    """Rows in event-time order, late rows dropped.

    On a stream this is the watermark: downstream event-time operators restore
    order and drop what falls behind it."""
    if stream:
        return df.withWatermark(eventtime, f"{micros(bound) // MICROS['second']} seconds")
    kept = mark_late(df, eventtime=eventtime, bound=bound, **kw).filter(~F.col("late"))
    kept = kept.drop("late", "newest_before")
    return kept.orderBy(eventtime) if sort else kept


def sample_trace(lines: DataFrame, per_kind: int, kind: str = "kind", line: str = "line") -> DataFrame:
    """A bounded trace of failed or late rows: per ``kind`` the number of rows, and
    ``per_kind`` distinct lines with how often each occurs, those of the smallest
    hashes.  That is the same sample however the rows are partitioned, and samples
    of parts merge into the sample of the whole: equal lines are counted before the
    shuffle, and a task keeps no more than ``per_kind`` of a kind."""
    distinct = lines.groupBy(kind, line).agg(F.count("*").alias("times"))
    place = F.row_number().over(Window.partitionBy(kind).orderBy(F.md5(F.col(line).cast("binary")), line))
    kept = distinct.withColumn("place", place).where(F.col("place") <= per_kind)
    totals = lines.groupBy(F.col(kind).alias("_kind")).agg(F.count("*").alias("rows"))
    return kept.join(totals, F.col(kind).eqNullSafe(F.col("_kind"))).select(kind, "rows", "place", line, "times")
