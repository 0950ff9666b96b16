import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import normalise_eventtime, shard_of
from tidemark.operators import projection, shard
from tidemark.sources import csv, generator
from tidemark.sources.schemas import FLOWS_COLUMNS, SESSIONS_COLUMNS
from tidemark.sources.sinks import write_rotated
from tidemark.sources.tables import flow_records, session_records, table

SF = "/root/testdata/sf0.001"


def test_layouts():
    assert len(FLOWS_COLUMNS) == 72 and len(SESSIONS_COLUMNS) == 102
    f = [n for n, _ in FLOWS_COLUMNS]
    s = [n for n, _ in SESSIONS_COLUMNS]
    assert (f.index("eventtime"), f.index("sessionid"), f.index("uplinkoctets")) == (1, 6, 13)
    assert (s.index("sessionid"), s.index("eventtime"), s.index("uplinkoctets"),
            s.index("ecgieci")) == (1, 2, 42, 78)


def test_normalise_eventtime(spark):
    df = spark.createDataFrame([("2022-01-01 00:00:00.123",), ("2022-01-01 00:00:00.12",),
                                ("2022-01-01 00:00:00",)], "t string")
    got = [r[0] for r in df.select(normalise_eventtime("t").cast("string")).collect()]
    assert got == ["2022-01-01 00:00:00.123", "2022-01-01 00:00:00", "2022-01-01 00:00:00"]
    floor = df.select(normalise_eventtime("t", floor="minute").cast("string")).first()[0]
    assert floor == "2022-01-01 00:00:00"


def test_csv_round_trip_and_pattern(spark, tmpdir_path):
    ev = table(spark, SF, "events")
    write_rotated(flow_records(ev), tmpdir_path + "/flows", 100)
    write_rotated(session_records(ev), tmpdir_path + "/sessions", 100)
    f = csv.read_flows(spark, tmpdir_path + "/flows")
    s = csv.read_sessions(spark, tmpdir_path + "/sessions")
    assert len(f.columns) == 72 and len(s.columns) == 102
    assert f.count() == flow_records(ev).count()
    assert sorted(map(tuple, f.collect())) == sorted(map(tuple, flow_records(ev).collect()))
    # the upstream file-name regex, translated to a glob
    assert csv.regex_to_glob("flows_.*csv") == "flows_*csv"
    only = csv.read_flows(spark, tmpdir_path + "/flows", pattern="part-00000.*")
    assert 0 < only.count() <= f.count()
    # typed variant: INT session id
    t = csv.read_flows(spark, tmpdir_path + "/flows", typed=True)
    assert dict(t.dtypes)["sessionid"] == "int"
    # projection reads only the columns it needs from the file
    plan = projection.projection_view(f)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<eventtime:string,sessionid:string,uplinkoctets" in plan


def test_rejected_rows_and_strict_casts(spark, tmpdir_path):
    good = ",".join(["x"] * 72)
    short = "a,b,c"
    with open(os.path.join(tmpdir_path, "f.csv"), "w") as fh:
        fh.write(good + "\n" + short + "\n")
    df = csv.read_flows(spark, tmpdir_path, rejected=True).cache()
    ok, bad = csv.split_rejected(df)
    assert ok.count() == 1 and bad.count() == 1
    # 'x' is not a number: strict casts raise, lenient casts give NULL
    with pytest.raises(Exception):
        projection.projection_view(ok).collect()
    lenient = projection.projection_view(ok, strict=False).first()
    assert lenient.octets is None


def test_shard_identity_and_negative_ids(spark):
    df = spark.createDataFrame([(i,) for i in range(-7, 8)], "sessionid int")
    parts = [shard.shard(df, 3, k).count() for k in range(3)]
    assert sum(parts) == df.count()
    assert df.select(F.min(shard_of("sessionid", 3))).first()[0] == 0


def test_generator(spark):
    lens = generator.burst_lengths()
    assert lens.count(1) == 386 and max(lens) == 37 and lens.count(37) == 5
    assert abs(generator.MEAN_BURST - 3.985) < 1e-9
    s = generator.gen_sessions(spark, 4)
    assert s.count() == 4 * generator.DEFAULT_RATE
    per_sec = s.groupBy(F.substring("eventtime", 1, 19)).agg(F.countDistinct("sessionid"))
    assert {r[1] for r in per_sec.collect()} == {generator.DEFAULT_RATE}
    f1 = generator.gen_flows(spark, 3, partitions=2)
    f2 = generator.gen_flows(spark, 3, partitions=5)
    assert sorted(map(tuple, f1.collect())) == sorted(map(tuple, f2.collect()))
    bursts = f1.groupBy("eventtime").agg(F.countDistinct("sessionid").alias("n"))
    assert bursts.filter("n > 1").count() == 0      # one session per burst
    late = generator.gen_sessions(spark, 2, lateness_secs=60)
    assert late.filter(F.col("eventtime") < "2022-01-01 00:00:00").count() > 0


def test_generator_profile(spark):
    """Share of flow-carrying sessions (hash % 101 < 70) and the mean of the
    exponential lateness (lateness / 6)."""
    fs = generator.flow_sessions(spark).count()
    assert abs(fs / generator.DEFAULT_SESSIONS - 70 / 101) < 0.01
    late = generator.gen_sessions(spark, 20, lateness_secs=60)
    on_time = generator.gen_sessions(spark, 20)

    def mean_ms(df):
        return df.select(F.avg(F.unix_millis(F.col("eventtime").cast("timestamp")))).first()[0]
    # the same rows, each moved back by its lateness: compare mean event times
    assert abs((mean_ms(on_time) - mean_ms(late)) / 1000 - 60 / 6) < 1.0


def test_trace_of_rejected_lines_is_bounded_and_stable(spark):
    """A sample per reason, the same in any partitioning; repeated lines are counted."""
    from tidemark.operators.late import sample_trace
    lines = [f"{k},2020-01-01 00:00:00.{k % 7},{k}" for k in range(40)] + ["x1,2020-01-01 00:00:00.0,1"] * 3 + \
        [f"{k},never,1" for k in range(30)] + ["1,2", "1,2020-01-01 00:00:00.0,1,2", "3,2020-01-01 00:00:00.0,much"] * 2
    schema = T.StructType.fromDDL("sessionid int, eventtime timestamp, uplinkoctets bigint")
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    kind = csv.reject_reason("value", schema, timestamp_format="yyyy-MM-dd HH:mm:ss.S")
    bad = df.select(F.col("value").alias("line"), kind.alias("kind")).where("kind IS NOT NULL")
    runs = [sorted(map(tuple, sample_trace(bad.repartition(n), 4).collect())) for n in (1, 3, 8)]
    assert runs[0] == runs[1] == runs[2]
    assert {(r[0], r[1]) for r in runs[0]} == {("sessionid", 3), ("eventtime", 30), ("fields", 4), ("uplinkoctets", 2)}
    assert [r[4] for r in runs[0] if r[0] == "sessionid"] == [3]
    assert sum(r[0] == "eventtime" for r in runs[0]) == 4
