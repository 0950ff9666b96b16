"""The named views over the driver tables: one function per query.

Every query reads the ``events`` table of a scale-factor directory, derives
the flows and sessions records from it with Spark (see
:mod:`tidemark.sources.tables`), parses them with the CSV parser and runs the
view.  Output TIMESTAMP columns are returned as TIMESTAMP_NTZ (wall clock in
UTC) so they compare equal to zone-less times elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import MICROS
from ..functions.scalars import normalise_eventtime
from ..operators import joins, late, meters, projection, shard, windows
from ..operators.late import sample_trace
from ..session import prepare
from ..sources import csv
from ..sources.tables import (CELL_BASE, compressed_micros, flows_from_events,
                              sessions_from_events, table)

Query = Callable[[SparkSession, str], DataFrame]


def to_ntz(df: DataFrame) -> DataFrame:
    cols = [F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if isinstance(f.dataType, T.TimestampType) else F.col(f.name)
            for f in df.schema.fields]
    return df.select(*cols)


class Inputs:
    """The base relations of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        prepare(spark)
        self.spark, self.sf_dir = spark, sf_dir

    def flows(self, parse: bool = False) -> DataFrame:
        """Flows records as string columns.  ``parse`` sends them through text
        and the CSV parser first (the parse view measures that); the other
        views start from the string columns, because Catalyst copies inferred
        not-null filters below a ``from_csv`` projection and would parse
        every line once per filter."""
        return flows_from_events(self.spark, self.sf_dir, parse=parse)

    def sessions(self) -> DataFrame:
        return sessions_from_events(self.spark, self.sf_dir, parse=False)

    def projection(self) -> DataFrame:
        return projection.projection_view(self.flows())

    def projection_arrival(self) -> DataFrame:
        """projection_view plus the record's load time as ``arrival`` and its
        flow id (the arrival tie-break)."""
        f = self.flows().withColumn("arrival", F.col("load_ts").cast("timestamp")) \
                        .withColumn("flowid", F.col("flowid").cast("bigint"))
        return projection.projection_view(f, keep=("arrival", "flowid"))

    def sessions2(self) -> DataFrame:
        return projection.sessions_step_2(self.sessions())

    def ingested_flows(self) -> DataFrame:
        return projection.flows_ingestion(self.flows())

    def ingested_sessions(self) -> DataFrame:
        return projection.sessions_ingestion(self.sessions())

    def testwindow(self) -> DataFrame:
        """Two-column (time, 4-character text) relation over all events."""
        ev = table(self.spark, self.sf_dir, "events")
        return ev.select(F.timestamp_micros(compressed_micros(F.col("ts"))).alias("event_time"),
                         F.substring("event_type", 1, 4).alias("c1"))


REGISTRY: dict[str, Callable[[Inputs], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def query(name: str) -> Query:
    fn = REGISTRY[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return to_ntz(fn(Inputs(spark, sf_dir)))
    run.__name__ = name
    run.__doc__ = fn.__doc__
    return run


def queries() -> dict[str, Query]:
    return {name: query(name) for name in REGISTRY}


# -- sources and projections ----------------------------------------------

@register("parse_view")
def _parse_view(i: Inputs):
    """All 72 parsed columns of every flow record."""
    return projection.parse_view(i.flows(parse=True))


@register("flows_step_1")
def _flows_step_1(i: Inputs):
    return projection.flows_step_1(i.flows())


@register("projection_view")
def _projection_view(i: Inputs):
    return i.projection()


@register("flows_minutes")
def _flows_minutes(i: Inputs):
    """The minute-truncated variant of the normalised event time."""
    return i.flows().select("sessionid", normalise_eventtime("eventtime", floor="minute")
                            .alias("eventtime"))


@register("merged_pumps")
def _merged_pumps(i: Inputs):
    """Two ingestion pumps over disjoint halves of the sessions, into one stream."""
    f = i.ingested_flows()
    return shard.merge_streams(*[shard.shard(f, 2, k) for k in range(2)])


#: the event time of a typed source has a fraction (of any length); lines without one are rejected
TYPED_FLOW = "sessionid int, eventtime timestamp, uplinkoctets bigint"
TYPED_TIME = "yyyy-MM-dd HH:mm:ss.SSS"


def _typed_flows(i: Inputs) -> tuple[DataFrame, DataFrame]:
    schema = T.StructType.fromDDL(TYPED_FLOW)
    lines = i.flows().select(F.concat_ws(",", *schema.names).alias("value"))
    return csv.split_rejected(csv.parse_lines(lines, schema, rejected=True,
                                              timestamp_format=TYPED_TIME))


@register("typed_flows")
def _typed_good(i: Inputs):
    """Flow lines that a typed source takes."""
    return _typed_flows(i)[0]


@register("rejected_rows")
def _rejected_rows(i: Inputs):
    """Flow lines that a typed source rejects, as text."""
    return _typed_flows(i)[1].select(F.col(csv.CORRUPT).alias("line"))


@register("rejected_trace")
def _rejected_trace(i: Inputs):
    """For each reason that lines were rejected for: how many, and five of them."""
    bad = _typed_flows(i)[1].select(F.col(csv.CORRUPT).alias("line"))
    kind = csv.reject_reason("line", T.StructType.fromDDL(TYPED_FLOW), timestamp_format=TYPED_TIME)
    return sample_trace(bad.withColumn("kind", kind), 5)


@register("sessions_step_2")
def _sessions_step_2(i: Inputs):
    return i.sessions2()


@register("flows_ingestion")
def _flows_ingestion(i: Inputs):
    return i.ingested_flows()


@register("sessions_ingestion")
def _sessions_ingestion(i: Inputs):
    return i.ingested_sessions()


@register("testwindow_v1")
def _testwindow_v1(i: Inputs):
    return projection.testwindow_v1(i.testwindow())


# -- sliding windows --------------------------------------------------------

def _agg(minutes):
    def fn(i: Inputs):
        return windows.agg_view(i.projection(), minutes)
    return fn


for _name, _minutes in windows.AGG_VIEW_WIDTHS.items():
    register(_name)(_agg(_minutes))


@register("bollinger_view")
def _bollinger(i: Inputs):
    return windows.bollinger_view(i.projection(), digits=4)


@register("testwindow_v2")
def _testwindow_v2(i: Inputs):
    return windows.testwindow_v2(i.testwindow())


@register("count_total")
def _count_total(i: Inputs):
    return meters.count_total(windows.agg_view(i.projection(), 60))


# -- joins ------------------------------------------------------------------

@register("join_view_forward")
def _join_forward(i: Inputs):
    return joins.join_view_forward(i.projection(), i.sessions2())


@register("join_view_backward")
def _join_backward(i: Inputs):
    return joins.join_view_backward(i.projection(), i.sessions2())


@register("session_join_view")
def _session_join(i: Inputs):
    return joins.session_join_view(i.projection(), i.sessions2())


@register("join_n_agg_view_forward")
def _join_n_agg_forward(i: Inputs):
    return windows.join_n_agg_view(joins.join_view_forward(i.projection(), i.sessions2()))


@register("join_n_agg_view_backward")
def _join_n_agg_backward(i: Inputs):
    return windows.join_n_agg_view(joins.join_view_backward(i.projection(), i.sessions2()))


@register("join_n_agg_null_cells")
def _join_n_agg_null_cells(i: Inputs):
    """The per-cell statistics with one cell unknown: NULL cells share frames."""
    j = joins.join_view_backward(i.projection(), i.sessions2())
    unknown = F.nullif(F.col("cellid"), F.lit(str(CELL_BASE)))
    return windows.join_n_agg_view(j.withColumn("cellid", unknown))


@register("join_n_agg_view2")
def _join_n_agg_view2(i: Inputs):
    return windows.join_n_agg_view2(joins.join_view_backward(i.projection(), i.sessions2()))


# -- sharded catalog ----------------------------------------------------------

def _ingested_sessions_for_join(i: Inputs) -> DataFrame:
    s = i.ingested_sessions()
    return s.select("sessionid", F.col("rowtime").alias("eventtime"), "cellid")


@register("flows_agg_step_1")
def _flows_agg_step_1(i: Inputs):
    return windows.flows_agg_step_1(i.ingested_flows())


@register("flows_agg_step_2")
def _flows_agg_step_2(i: Inputs):
    return joins.flows_agg_step_2(windows.flows_agg_step_1(i.ingested_flows()),
                                  _ingested_sessions_for_join(i))


@register("flows_agg_step_2_session")
def _flows_agg_step_2_session(i: Inputs):
    return joins.flows_agg_step_2(windows.flows_agg_step_1(i.ingested_flows()),
                                  _ingested_sessions_for_join(i), session=True)


@register("flows_agg_sharded")
def _flows_agg_sharded(i: Inputs):
    """Offset-frame statistics and session rows, both laid out in eight shards, joined
    shard by shard."""
    agg = windows.flows_agg_step_1(i.ingested_flows())
    out = shard.co_sharded_join(agg, _ingested_sessions_for_join(i), 8, 0, 5 * MICROS["minute"])
    return out.select("sessionid", "eventtime", "cellid", *windows.STAT_COLUMNS)


# -- late rows and meters -------------------------------------------------------

@register("late_rows")
def _late_rows(i: Inputs):
    p = i.projection_arrival()
    out = late.late_rows(p, tiebreak=["flowid"])
    return out.select("sessionid", "eventtime", "octets", "packets", "arrival",
                      "newest_before")


@register("t_sort")
def _t_sort(i: Inputs):
    p = i.projection_arrival()
    return late.t_sort(p, tiebreak=["flowid"], sort=False).select(
        "sessionid", "eventtime", "octets", "packets")


@register("data_rate")
def _data_rate(i: Inputs):
    return meters.data_rate(i.projection_arrival())


@register("throughput_meter")
def _throughput_meter(i: Inputs):
    return meters.throughput_meter(i.projection_arrival())


@register("running_avg_rps")
def _running_avg_rps(i: Inputs):
    return meters.running_avg_rps(i.projection_arrival(), digits=4)
