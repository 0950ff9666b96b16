"""The named views over flows and sessions record DataFrames (files, or any
other source), in batch and streaming form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, late, projection, windows
from ..streaming import carried, steps

View = Callable[[DataFrame, DataFrame], DataFrame]


def _proj(f: DataFrame) -> DataFrame:
    return projection.projection_view(f)


def _sess(s: DataFrame) -> DataFrame:
    return projection.sessions_step_2(s)


BATCH: dict[str, View] = {
    "parse_view": lambda f, s: projection.parse_view(f),
    "projection_view": lambda f, s: _proj(f),
    "sessions_step_2": lambda f, s: _sess(s),
    **{name: (lambda m: lambda f, s: windows.agg_view(_proj(f), m))(m)
       for name, m in windows.AGG_VIEW_WIDTHS.items()},
    "bollinger_view": lambda f, s: windows.bollinger_view(_proj(f)),
    "join_view_forward": lambda f, s: joins.join_view_forward(_proj(f), _sess(s)),
    "join_view": lambda f, s: joins.join_view_backward(_proj(f), _sess(s)),
    "session_join_view": lambda f, s: joins.session_join_view(_proj(f), _sess(s)),
    "join_n_agg_view": lambda f, s: windows.join_n_agg_view(
        joins.join_view_backward(_proj(f), _sess(s))),
    "join_n_agg_view_forward": lambda f, s: windows.join_n_agg_view(
        joins.join_view_forward(_proj(f), _sess(s))),
    "join_n_agg_view2": lambda f, s: windows.join_n_agg_view2(
        joins.join_view_backward(_proj(f), _sess(s))),
    "flows_agg_step_1": lambda f, s: windows.flows_agg_step_1(projection.flows_ingestion(f)),
    "flows_agg_step_2": lambda f, s: joins.flows_agg_step_2(
        windows.flows_agg_step_1(projection.flows_ingestion(f)),
        projection.sessions_ingestion(s).selectExpr("sessionid", "rowtime AS eventtime",
                                                    "cellid")),
    # arrival order: the record's load time
    "t_sort": lambda f, s: late.t_sort(projection.projection_view(
        f.withColumn("arrival", F.col("load_ts").cast("timestamp")), keep=("arrival",)),
        arrival="arrival", sort=True).drop("arrival", "newest_before"),
}

#: the streaming views, as steps over carried tables (inputs ``flows`` and ``sessions``)
STREAM: dict[str, steps.View] = {
    "projection_view": carried.projection_view(),
    "t_sort": carried.t_sort(),
    "bollinger_view": carried.bollinger_view(),
    **{name: carried.agg_view(m) for name, m in windows.AGG_VIEW_WIDTHS.items()},
    "count_total": carried.count_total(),
    "join_view_forward": carried.join_view(forward=True),
    "join_view": carried.join_view(),
    "session_join_view": carried.session_join_view(),
    "join_n_agg_view": carried.join_n_agg_view(),
    "join_n_agg_view_forward": carried.join_n_agg_view(forward=True),
    "join_n_agg_view2": carried.join_n_agg_view2(),
    "flows_agg_step_1": carried.flows_agg_step_1(),
    "flows_agg_step_2": carried.flows_agg_step_2(),
    "running_avg_rps": carried.running_rate(),
    "testwindow_v2": carried.testwindow_v2(),
}

#: views of both inputs
JOINS = {"join_view_forward", "join_view", "session_join_view", "join_n_agg_view", "join_n_agg_view_forward",
         "join_n_agg_view2", "flows_agg_step_2"}


def stream_inputs(view: str, flows: DataFrame, sessions: DataFrame | None) -> steps.Inputs:
    """The inputs of a streaming view over record streams."""
    if view == "running_avg_rps":  # the record's load time is its arrival
        x = flows.withColumn("arrival", F.col("load_ts").cast("timestamp"))
        return {"rows": (projection.projection_view(x, keep=("arrival",)), "arrival")}
    if view == "testwindow_v2":
        return {"rows": (_proj(flows).selectExpr("eventtime AS event_time", "sessionid AS c1"), "event_time")}
    out = {"flows": (_proj(flows), "eventtime")}
    if view in JOINS:
        out["sessions"] = (_sess(sessions), "eventtime")
    return out
