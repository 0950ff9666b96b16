"""Streams as steps over carried tables: equal to the batch views, exact under
restarts, late rows in the side output, silent inputs."""

import json
import os
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, late, meters, windows
from tidemark.streaming import carried, steps

T0 = 1_577_836_800
HOURS = 3


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """Flows and sessions of three hours: a hot session and cell, ties, repeated rows,
    NULL keys, cells and values; rows arrive up to 25 s out of order, in three files."""
    base = str(tmp_path_factory.mktemp("steps"))
    flows = spark.range(2400).selectExpr(
        "case when id % 17 = 0 then null when id % 3 = 0 then 'hot' else concat('k', id % 7) end sessionid",
        f"timestamp_micros({T0}000000L + (id div 2) * {HOURS * 3600 // 1200} * 1000000L + (id % 5) * 250000L) eventtime",
        "case when id % 11 = 0 then null else (id * 7919) % 1000 end octets", "id % 4 packets")
    flows = flows.unionByName(flows.where("octets % 5 = 0"))
    sessions = spark.range(500).selectExpr(
        "case when id % 19 = 0 then null when id % 2 = 0 then 'hot' else concat('k', id % 7) end sessionid",
        f"timestamp_seconds({T0} + (id div 3) * 3 * {HOURS * 3600 // 500}) eventtime",
        "case when id % 13 = 0 then null else concat('c', id % 3) end cellid")
    for name, df in (("flows", flows), ("sessions", sessions)):
        arrival = (F.unix_seconds("eventtime") + F.pmod(F.hash("eventtime", "sessionid"), F.lit(25)) - T0) / 3600
        for k in range(HOURS):
            part = df.where((arrival >= k) & (arrival < (k + 1 if k < HOURS - 1 else 99)))
            part.coalesce(1).write.mode("append").parquet(f"{base}/{name}")
            time.sleep(1.1)  # file sources take files by modification time
    return base


def stream(spark, path, files=1):
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)


def rows(df, cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def step_2(f, s):
    agg = windows.flows_agg_step_1(f.withColumnRenamed("eventtime", "rowtime"))
    return joins.flows_agg_step_2(agg, s)


BATCH = {
    "agg_view": (carried.agg_view(60), lambda f, s: windows.agg_view(f, 60)),
    "agg_view_1m": (carried.agg_view(1), lambda f, s: windows.agg_view(f, 1)),
    "bollinger": (carried.bollinger_view(20, digits=4), lambda f, s: windows.bollinger_view(f, 20, digits=4)),
    "join_forward": (carried.join_view(forward=True), joins.join_view_forward),
    "join_backward": (carried.join_view(), joins.join_view_backward),
    "cells_forward": (carried.join_n_agg_view(forward=True), lambda f, s: windows.join_n_agg_view(joins.join_view_forward(f, s))),
    "cells": (carried.join_n_agg_view(), lambda f, s: windows.join_n_agg_view(joins.join_view_backward(f, s))),
    "cells_offset": (carried.join_n_agg_view2(), lambda f, s: windows.join_n_agg_view2(joins.join_view_backward(f, s))),
    "step_1": (carried.flows_agg_step_1(), lambda f, s: windows.flows_agg_step_1(f.withColumnRenamed("eventtime", "rowtime"))),
    "step_2": (carried.flows_agg_step_2(), step_2),
    "latest": (carried.session_join_view(), joins.session_join_view),
}


@pytest.mark.parametrize("name", sorted(BATCH))
def test_steps_equal_batch(spark, inputs, name, tmp_path):
    view, batch = BATCH[name]
    f, s = (spark.read.parquet(f"{inputs}/{n}") for n in ("flows", "sessions"))
    want = batch(f, s)
    live = {"flows": (stream(spark, inputs + "/flows"), "eventtime")}
    if name not in ("agg_view", "agg_view_1m", "bollinger", "step_1"):
        live["sessions"] = (stream(spark, inputs + "/sessions"), "eventtime")
    got = steps.run(spark, view, live, str(tmp_path / "out"), str(tmp_path / "work"))
    assert rows(got, want.columns) == rows(want, want.columns)
    assert want.count() > 100
    assert len(os.listdir(tmp_path / "out")) >= HOURS


def test_carried_rows_are_let_go(spark, inputs, tmp_path):
    """A one-minute frame keeps no hour of rows, and small folders are merged."""
    f = spark.read.parquet(inputs + "/flows")
    for k in range(6):
        f.where(f"floor((unix_seconds(eventtime) - {T0}) / 1800) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    query, job = steps.start(spark, carried.agg_view(1), {"flows": (stream(spark, str(tmp_path / "in")), "eventtime")},
                             str(tmp_path / "out"), str(tmp_path / "work"))
    query.awaitTermination()
    assert all(len(live) <= 2 for live in job.state["live"].values())
    assert len([x for x in os.listdir(tmp_path / "work/input") if x.startswith("batch=")]) <= 3


def test_merged_logs_change_nothing(spark, inputs, tmp_path, monkeypatch):
    monkeypatch.setattr(steps, "MERGE", 1)
    f = spark.read.parquet(inputs + "/flows")
    got = steps.run(spark, carried.agg_view(60), {"flows": (stream(spark, inputs + "/flows"), "eventtime")},
                    str(tmp_path / "out"), str(tmp_path / "work"))
    want = windows.agg_view(f, 60)
    assert rows(got, want.columns) == rows(want, want.columns)
    assert [x for x in os.listdir(tmp_path / "work") if x.startswith("merged-")]


@pytest.mark.parametrize("fail_at", ["output", "record"])
def test_a_step_that_failed_is_run_again_once(spark, inputs, tmp_path, monkeypatch, fail_at):
    """The job dies after it wrote a step's output, before or after its commit record;
    started again, every row comes out once."""
    live = {n: (stream(spark, f"{inputs}/{n}"), "eventtime") for n in ("flows", "sessions")}
    out, work = str(tmp_path / "out"), str(tmp_path / "work")
    commit = steps.Steps._commit

    def dies(self):
        if self.state["batch"] == 1:
            if fail_at == "record":
                commit(self)
            raise RuntimeError("lost")
        commit(self)
    monkeypatch.setattr(steps.Steps, "_commit", dies)
    query, _ = steps.start(spark, carried.join_n_agg_view(), live, out, work)
    with pytest.raises(Exception, match="lost"):
        query.awaitTermination()
    monkeypatch.setattr(steps.Steps, "_commit", commit)
    got = steps.run(spark, carried.join_n_agg_view(), live, out, work)
    f, s = (spark.read.parquet(f"{inputs}/{n}") for n in ("flows", "sessions"))
    want = windows.join_n_agg_view(joins.join_view_backward(f, s))
    assert rows(got, want.columns) == rows(want, want.columns)
    # a finished run changes nothing when it is started again
    assert rows(steps.run(spark, carried.join_n_agg_view(), live, out, work), want.columns) == rows(want, want.columns)


def files(spark, path, lists):
    for k, times in enumerate(lists):
        spark.createDataFrame([(t and f"2020-01-01 {t}", k) for t in times.split()] or [(None, k)], "t string, k int") \
            .selectExpr("cast(t as timestamp) eventtime", "k").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def test_late_rows_go_to_the_side_output(spark, tmp_path):
    """Kept and late rows are the input; a late row is late by the batch rule too."""
    src = str(tmp_path / "in")
    files(spark, src, ["00:00:10 00:00:05", "00:01:00", "00:00:20 00:01:10 00:00:31", "", "00:00:30 00:03:00", "00:05:00"])
    out = str(tmp_path / "out")
    got = steps.run(spark, carried.projection_view(), {"flows": (stream(spark, src), "eventtime")}, out, str(tmp_path / "w"))
    side = steps.late(spark, out, "flows", got.schema)
    both = rows(got, ["eventtime", "k"]) + rows(side, ["eventtime", "k"])
    assert both == rows(spark.read.parquet(src), ["eventtime", "k"])
    # the mark is 00:30 when 00:20 comes and 00:40 when 00:30 comes; a row without a time is never in order
    assert sorted((str(r.eventtime)[-8:], r.k) for r in side.collect()) == [("00:00:20", 2), ("00:00:30", 4), ("None", 3)]
    batch = late.late_rows(spark.read.parquet(src).where("eventtime IS NOT NULL"), arrival="eventtime", tiebreak=["k"])
    assert batch.columns[:2] == ["eventtime", "k"]


def test_rows_come_in_order_over_all_steps(spark, tmp_path):
    import glob
    src = str(tmp_path / "in")
    files(spark, src, ["00:00:10 00:00:05", "00:00:20 00:00:12", "00:00:31 00:00:08", "00:01:30 00:01:25",
                       "00:01:01 00:00:25 00:01:10", "00:03:00", "00:03:01 00:00:40"])
    out = str(tmp_path / "out")
    steps.run(spark, carried.t_sort(), {"flows": (stream(spark, src), "eventtime")}, out, str(tmp_path / "w"))
    got = [r.eventtime.strftime("%M:%S") for f in sorted(glob.glob(out + "/batch=*/part-*.parquet"))
           for r in spark.read.parquet(f).collect()]
    assert got == ["00:05", "00:08", "00:10", "00:12", "00:20", "00:31", "01:01", "01:10", "01:25", "01:30", "03:00", "03:01"]
    late_ones = steps.late(spark, out, "flows", spark.read.parquet(src).schema).collect()
    assert sorted(r.eventtime.strftime("%M:%S") for r in late_ones) == ["00:25", "00:40"]


def test_a_burst_in_one_instant_is_sorted_by_many_tasks(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows of a test are few
    spark.range(40_000).selectExpr("timestamp'2020-01-01 00:00:00' eventtime", "hash(id) k").coalesce(1).write.parquet(str(tmp_path / "in"))
    steps.run(spark, carried.t_sort(), {"flows": (stream(spark, str(tmp_path / "in")), "eventtime")},
              str(tmp_path / "out"), str(tmp_path / "w"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy(F.input_file_name()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 30_000


def test_a_silent_input_holds_the_join_only_as_long_as_allowed(spark, inputs, tmp_path):
    """Sessions fall silent after the first hour: with ``idle`` the join goes on."""
    s = spark.read.parquet(inputs + "/sessions").where(f"unix_seconds(eventtime) < {T0 + 1800}")
    s.coalesce(1).write.parquet(str(tmp_path / "s"))
    held = {}
    for idle in (None, "10 minutes"):
        live = {"flows": (stream(spark, inputs + "/flows"), "eventtime"), "sessions": (stream(spark, str(tmp_path / "s")), "eventtime")}
        out = str(tmp_path / f"out-{idle}")
        query, job = steps.start(spark, carried.join_view(), live, out, str(tmp_path / f"w-{idle}"), idle=idle)
        query.awaitTermination()
        held[idle] = job.state["hi"] / 1e6 - T0
        job.finish()
        want = joins.join_view_backward(spark.read.parquet(inputs + "/flows"), s)
        assert rows(steps.output(spark, out), want.columns) == rows(want, want.columns)
    assert held[None] <= 1800 and held["10 minutes"] > HOURS * 3600 - 700


def test_running_rate_and_sum_check(spark, inputs, tmp_path):
    f = spark.read.parquet(inputs + "/flows")
    live = {"rows": (stream(spark, inputs + "/flows").withColumn("arrival", F.col("eventtime")), "arrival")}
    got = steps.run(spark, carried.running_rate(), live, str(tmp_path / "o1"), str(tmp_path / "w1"))
    arrived = f.withColumn("arrival", F.col("eventtime"))
    want = meters.data_rate(arrived).join(meters.running_avg_rps(arrived).withColumnRenamed("second", "rowtime"), ["rowtime", "rps"])
    cols = ["rowtime", "rps", "cumulative_rows", "rowtime_low", "rowtime_high", "avg_rps"]
    assert rows(got, cols) == rows(want, cols) and want.count() > 1000
    got = steps.run(spark, carried.count_total(5), {"flows": (stream(spark, inputs + "/flows"), "eventtime")},
                    str(tmp_path / "o2"), str(tmp_path / "w2"))
    assert got.agg(F.sum("count_total")).first()[0] == meters.count_total(windows.agg_view(f, 5)).first()[0]


def test_minute_windows_of_all_rows(spark, inputs, tmp_path):
    f = spark.read.parquet(inputs + "/flows").selectExpr("eventtime event_time", "sessionid c1")
    got = steps.run(spark, carried.testwindow_v2(),
                    {"rows": (stream(spark, inputs + "/flows").selectExpr("eventtime event_time", "sessionid c1"), "event_time")},
                    str(tmp_path / "out"), str(tmp_path / "w"))
    want = windows.testwindow_v2(f)
    assert rows(got, want.columns) == rows(want, want.columns)


def test_no_python_rows_and_no_single_task_for_a_hot_cell(spark, tmp_path):
    """60,000 joined rows of one cell in ten minutes: the step's plan has no Python
    operator, and its windows are dealt by cell and bucket."""
    f = spark.range(60_000).selectExpr("'s' || id % 50 sessionid", f"timestamp_micros({T0}000000L + id * 10000L) eventtime",
                                       "id % 1000 octets", "id packets")
    f.coalesce(1).write.parquet(str(tmp_path / "in"))
    plans = []
    view = carried.agg_view(60)

    def watched(s):
        out = carried.row_frames(s, "flows", ["cellid"], windows.OCTET_STATS, 3600 * 10**6, s.lo, s.hi,
                                 lambda df: df.withColumn("cellid", F.lit("hot")))
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out
    got = steps.run(spark, steps.View(watched, view.reach), {"flows": (stream(spark, str(tmp_path / "in")), "eventtime")},
                    str(tmp_path / "out"), str(tmp_path / "w"))
    assert got.agg(F.max("countOctets")).first()[0] == 60_000 and got.count() == 60_000
    assert all("Python" not in p and "Pandas" not in p for p in plans)
    assert all("hashpartitioning(cellid" in p and ", _b" in p for p in plans)


def test_empty_input(spark, tmp_path):
    spark.createDataFrame([], "sessionid string, eventtime timestamp, octets long, packets long").write.parquet(str(tmp_path / "in"))
    got = steps.run(spark, carried.agg_view(5), {"flows": (stream(spark, str(tmp_path / "in")), "eventtime")},
                    str(tmp_path / "out"), str(tmp_path / "w"))
    assert got.count() == 0 and got.columns[:2] == ["sessionid", "octets"]
    assert json.loads(open(sorted((tmp_path / "w/commits").glob("*.json"))[-1]).read())["last"]
