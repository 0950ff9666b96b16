"""Stream = batch: each streaming view, run to the end of its input with the
tail flush, returns exactly the rows of its batch twin."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import joins, projection, windows
from tidemark.sources import csv
from tidemark.sources.schemas import FLOWS_COLUMNS, SESSIONS_COLUMNS, TONNAGE
from tidemark.sources.sinks import write_rotated
from tidemark.sources.tables import flow_records, session_records, table
from tidemark.streaming import bounded, carried, ops, steps

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("stream"))
    ev = table(spark, SF, "events")
    # several files per source, in event-time order, so the stream runs in
    # several micro-batches and no row is behind the watermark
    write_rotated(flow_records(ev).orderBy("eventtime").coalesce(1), base + "/flows", 200)
    write_rotated(session_records(ev).orderBy("eventtime").coalesce(1), base + "/sessions",
                  200)
    return base


def _rows(df, cols):
    return Counter(tuple(r) for r in df.select(*cols).collect())


def _flush(base):
    return {
        base + "/flows": bounded.default_flush(FLOWS_COLUMNS, numeric=tuple(TONNAGE)),
        base + "/sessions": bounded.sentinel_line(
            SESSIONS_COLUMNS, {"sessionid": bounded.SENTINEL_KEY,
                               "eventtime": bounded.SENTINEL_TIME,
                               "ecgieci": bounded.SENTINEL_KEY}),
    }


def _copy(spark, base, name):
    """Each test gets its own ordered inputs (the flush appends to them)."""
    dst = base + "-" + name
    ev = table(spark, SF, "events")
    write_rotated(flow_records(ev).orderBy("eventtime").coalesce(1), dst + "/flows", 200)
    write_rotated(session_records(ev).orderBy("eventtime").coalesce(1), dst + "/sessions",
                  200)
    return dst


def _stream_inputs(spark, d):
    f = projection.projection_view(csv.read_flows(spark, d + "/flows", stream=True,
                                                  max_files_per_trigger=1))
    s = projection.sessions_step_2(csv.read_sessions(spark, d + "/sessions", stream=True,
                                                     max_files_per_trigger=1))
    return f, s


def _batch_inputs(spark, base):
    f = projection.projection_view(csv.read_flows(spark, base + "/flows"))
    s = projection.sessions_step_2(csv.read_sessions(spark, base + "/sessions"))
    return f, s


@pytest.mark.parametrize("name", ["agg_view_5m", "join_view_forward", "join_view_backward",
                                  "join_n_agg_view", "offset_frame", "join_n_agg_view2"])
def test_stream_equals_batch(spark, dirs, name, tmp_path):
    d = _copy(spark, dirs, name)
    bf, bs = _batch_inputs(spark, dirs)

    def build():
        f, s = _stream_inputs(spark, d)
        if name == "agg_view_5m":
            return ops.agg_view(f, 5)
        if name == "join_view_forward":
            return ops.join_view_forward(f, s)
        if name == "join_view_backward":
            return ops.join_view_backward(f, s)
        if name == "offset_frame":
            return ops.stream_offset_over(f, "sessionid")
        if name == "join_n_agg_view2":
            return ops.join_n_agg_view2(ops.join_view_backward(f, s))
        return ops.join_n_agg_view(ops.join_view_backward(f, s))

    if name.startswith("agg_view_5m"):
        batch = windows.agg_view(bf, 5)
    elif name == "join_view_forward":
        batch = joins.join_view_forward(bf, bs)
    elif name == "join_view_backward":
        batch = joins.join_view_backward(bf, bs)
    elif name == "offset_frame":
        batch = windows.range_frame(bf, ["sessionid"], "eventtime", windows.OCTET_STATS,
                                    3600 * 10**6, 60 * 10**6, floor="minute").select(
            "sessionid", "octets", "eventtime", *windows.STAT_COLUMNS)
    elif name == "join_n_agg_view2":
        batch = windows.join_n_agg_view2(joins.join_view_backward(bf, bs))
    else:
        batch = windows.join_n_agg_view(joins.join_view_backward(bf, bs))
    got = bounded.run_bounded(spark, build, _flush(d), out=str(tmp_path / "out"),
                              checkpoint=str(tmp_path / "ckpt"))
    cols = batch.columns
    assert _rows(got, cols) == _rows(batch, cols)
    assert batch.count() > 0


def test_late_rows_stream_keeps_what_batch_keeps(spark, tmp_path):
    """Arrival order with up to 49 s of delay against a 30 s bound: the
    stream's watermark advances per micro-batch, so it never drops a row the
    batch reorder keeps (it may keep some the batch drops)."""
    from tidemark.operators import late

    d = str(tmp_path / "in")
    ev = table(spark, SF, "events")
    write_rotated(flow_records(ev).orderBy("load_ts", F.col("flowid").cast("int")).coalesce(1),
                  d, 100)

    def build():
        f = projection.projection_view(csv.read_flows(spark, d, stream=True,
                                                      max_files_per_trigger=1))
        return ops.agg_view(ops.t_sort(f), 5)

    got = bounded.run_bounded(spark, build, {d: bounded.default_flush(
        FLOWS_COLUMNS, numeric=tuple(TONNAGE))}, out=str(tmp_path / "out"),
        checkpoint=str(tmp_path / "ckpt"))
    src = csv.read_flows(spark, d).filter(F.col("sessionid") != bounded.SENTINEL_KEY)
    p = projection.projection_view(src.withColumn("arrival", F.col("load_ts").cast("timestamp"))
                                   .withColumn("flowid", F.col("flowid").cast("bigint")),
                                   keep=("arrival", "flowid"))
    kept = late.t_sort(p, tiebreak=["flowid"], sort=False)
    cols = ["sessionid", "eventtime", "octets"]
    stream_rows = _rows(got, cols)
    batch_rows = _rows(kept, cols)
    assert not (batch_rows - stream_rows)
    assert late.late_rows(p, tiebreak=["flowid"]).count() > 0


def test_late_row_metric_and_ntz_rowtime(spark, tmp_path):
    """Rows behind the watermark are counted by the query's metrics, and an
    NTZ event-time column is accepted as row time."""
    d = str(tmp_path / "in")
    rows = ["k,2022-01-01 00:10:00", "k,2022-01-01 00:20:00"]
    late = ["k,2022-01-01 00:00:00", "k,2022-01-01 00:19:00"]
    import os
    os.makedirs(d)
    with open(d + "/a.csv", "w") as fh:
        fh.write("\n".join(rows) + "\n")
    src = (spark.readStream.schema("k string, t timestamp_ntz").option("maxFilesPerTrigger", 1)
           .csv(d))
    agg = ops.as_rowtime(src, "t", "5 minutes").groupBy("k", F.window("t", "1 minute")).count()
    q = (agg.writeStream.format("memory").queryName("late_t").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    with open(d + "/b.csv", "w") as fh:      # 20 and 1 minutes behind the newest row
        fh.write("\n".join(late) + "\n")
    q.processAllAvailable()
    q.stop()
    assert ops.late_row_count(q) == 1        # 00:00 is behind 00:15; 00:19 is not


def _twice(df, every=3):
    """Some rows several times: repeated rows are rows of their own."""
    again = df.filter(F.col("octets") % every == 0)
    return df.unionByName(again).unionByName(again)


@pytest.mark.parametrize("name", ["repeated", "bollinger", "count_total"])
def test_native_frames_equal_batch(spark, dirs, name, tmp_path):
    """Repeated rows, Bollinger bands and the sum check as streams."""
    bf, _ = _batch_inputs(spark, dirs)

    def build():
        f, _ = _stream_inputs(spark, dirs)
        if name == "bollinger":
            return ops.bollinger_view(f, digits=4)
        if name == "count_total":
            return ops.count_total(ops.agg_view(f, 5))
        return ops.agg_view(_twice(f), 5)

    drop = F.year("eventtime") >= 2200
    got = bounded.run_bounded(spark, build, {dirs + "/flows": _flush(dirs)[dirs + "/flows"]},
                              out=str(tmp_path / "out"), checkpoint=str(tmp_path / "ckpt"), drop=drop)
    if name == "count_total":
        from tidemark.operators import meters
        assert got.agg(F.sum("count_total")).first()[0] == meters.count_total(windows.agg_view(bf, 5)).first()[0]
        return
    want = windows.bollinger_view(bf, digits=4) if name == "bollinger" else windows.agg_view(_twice(bf), 5)
    assert _rows(got, want.columns) == _rows(want, want.columns)
    assert want.count() > 0


def test_session_join_stream_with_hot_session_ties_and_nulls(spark, tmp_path):
    """A hot session over many hours, session rows of equal times, numeric
    cells, NULL keys, cells and values: the stream equals the batch."""
    import time
    flows = spark.range(3000).selectExpr(
        "case when id % 7 = 0 then null when id % 3 < 2 then 'hot' else concat('k', id % 5) end sessionid",
        "timestamp_seconds(1577836800 + id * 11) eventtime",
        "case when id % 11 = 0 then null else 9007199254740993 + id end octets", "id % 4 packets")
    sessions = spark.range(200).selectExpr(
        "case when id % 9 = 0 then null when id % 2 = 0 then 'hot' else concat('k', id % 5) end sessionid",
        "timestamp_seconds(1577836800 + (id div 3) * 3 * 150) eventtime",
        "case when id % 13 = 0 then null else cast(id * 7 % 100 as int) end cellid")
    for k in range(4):  # four files a source
        lo, hi = 1577836800 + k * 9000, 1577836800 + (k + 1) * 9000
        part = f"unix_seconds(eventtime) >= {lo} and unix_seconds(eventtime) < {hi}"
        flows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "f"))
        sessions.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "s"))
        time.sleep(1.1)
    read = spark.readStream.option("maxFilesPerTrigger", 1)
    got = steps.run(spark, carried.session_join_view(), {
        "flows": (read.schema(flows.schema).parquet(str(tmp_path / "f")), "eventtime"),
        "sessions": (read.schema(sessions.schema).parquet(str(tmp_path / "s")), "eventtime")},
        str(tmp_path / "o"), str(tmp_path / "w"))
    assert dict(got.dtypes)["cellid"] == "int"
    want = joins.session_join_view(flows, sessions)
    assert _rows(got, want.columns) == _rows(want, want.columns)
    assert want.where("sessionid = 'hot'").count() > 500


def test_testwindow_v2_stream_equals_batch(spark, tmp_path):
    import time
    ev = table(spark, SF, "events").selectExpr(
        "cast(ts as timestamp) event_time", "substring(event_type, 1, 4) c1")
    ev = ev.withColumn("event_time", F.timestamp_seconds(F.lit(1577836800) + F.unix_seconds("event_time") % 3000))
    ev = ev.unionByName(ev.limit(50)).orderBy("event_time")
    n = 3000
    for k in range(3):
        ev.where(f"(unix_seconds(event_time) - 1577836800) div {n // 3} = {k}").coalesce(1) \
            .write.mode("append").parquet(str(tmp_path / "t"))
        time.sleep(1.1)
    src = spark.readStream.option("maxFilesPerTrigger", 1).schema(ev.schema).parquet(str(tmp_path / "t"))
    got = steps.run(spark, carried.testwindow_v2(), {"rows": (src, "event_time")}, str(tmp_path / "o"), str(tmp_path / "w"))
    want = windows.testwindow_v2(ev)
    assert _rows(got, want.columns) == _rows(want, want.columns)
    assert want.count() > 100
