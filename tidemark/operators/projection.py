"""Parsing and projection views over the raw records.

Each function maps a DataFrame to a DataFrame and works unchanged on a
streaming DataFrame.  Cascaded views collapse into one projection under
Catalyst, and the CSV scan reads only the columns a view uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import (normalise_eventtime, normalise_eventtime_text, sum_all,
                                 to_bigint)
from ..sources.schemas import OCTETS, PACKETS, TONNAGE


def parse_view(flows: DataFrame) -> DataFrame:
    """All 72 columns of the flows records."""
    return flows.select("*")


def flows_step_1(flows: DataFrame, strict: bool = True, keep: tuple = ()) -> DataFrame:
    """sessionid, normalised event-time text and the eight tonnage columns as
    BIGINT (``keep``: further columns to carry along)."""
    return flows.select(
        *keep,
        F.col("sessionid"),
        normalise_eventtime_text("eventtime").alias("eventtime"),
        *[to_bigint(c, strict).alias(c) for c in TONNAGE],
    )


def flows_step_2(step1: DataFrame, strict: bool = True, keep: tuple = ()) -> DataFrame:
    """Event time as TIMESTAMP and the summed ``octets`` / ``packets``."""
    ts = F.col("eventtime").cast("timestamp") if strict else F.try_to_timestamp("eventtime")
    return step1.select(
        *keep,
        F.col("sessionid"),
        ts.alias("eventtime"),
        sum_all(OCTETS).alias("octets"),
        sum_all(PACKETS).alias("packets"),
    )


def projection_view(flows: DataFrame, strict: bool = True, floor: str | None = None,
                    keep: tuple = ()) -> DataFrame:
    """sessionid, eventtime, octets, packets of each flow record.

    ``floor='minute'`` gives the minute-truncated event-time variant; ``keep``
    carries further record columns (e.g. the load time) in front."""
    out = flows_step_2(flows_step_1(flows, strict, keep), strict, keep)
    if floor:
        out = out.withColumn("eventtime", F.date_trunc(floor, "eventtime"))
    return out


def sessions_step_1(sessions: DataFrame, strict: bool = True) -> DataFrame:
    return sessions.select(
        F.col("sessionid"),
        normalise_eventtime("eventtime", strict).alias("eventtime"),
        F.col("ecgieci"),
    )


def sessions_step_2(sessions: DataFrame, strict: bool = True, floor: str | None = None
                    ) -> DataFrame:
    """sessionid, eventtime, cellid of each session record."""
    s = sessions_step_1(sessions, strict)
    ts = F.date_trunc(floor, "eventtime") if floor else F.col("eventtime")
    return s.select("sessionid", ts.alias("eventtime"), F.col("ecgieci").alias("cellid"))


def flows_ingestion(flows: DataFrame, strict: bool = True) -> DataFrame:
    """Fused ingestion of the sharded catalog: normalised event-time text, an
    INT-typed ``sessionid`` and the two sums, plus the TIMESTAMP it promotes."""
    text = normalise_eventtime_text("eventtime")
    return flows.select(
        text.cast("timestamp").alias("rowtime"),
        text.alias("eventtime"),
        F.col("sessionid").cast("int").alias("sessionid"),
        sum_all([to_bigint(c, strict) for c in OCTETS]).alias("octets"),
        sum_all([to_bigint(c, strict) for c in PACKETS]).alias("packets"),
    )


def sessions_ingestion(sessions: DataFrame) -> DataFrame:
    """Sessions ingestion of the sharded catalog."""
    text = normalise_eventtime_text("eventtime")
    return sessions.select(
        text.cast("timestamp").alias("rowtime"),
        F.col("sessionid").cast("int").alias("sessionid"),
        text.alias("eventtime"),
        F.col("ecgieci").alias("cellid"),
    )


def testwindow_v1(testwindow: DataFrame) -> DataFrame:
    """event_time, its minute floor, c1."""
    return testwindow.select("event_time",
                             F.date_trunc("minute", "event_time").alias("event_time_mins"),
                             "c1")
