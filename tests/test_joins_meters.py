from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import joins, late, meters
from tidemark.plans.catalog import Inputs


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_forward_is_backward_mirrored(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    p, s = i.projection(), i.sessions2()

    def mirror(df):
        return df.withColumn("eventtime", F.timestamp_micros(-F.unix_micros("eventtime")
                                                             + F.lit(4_000_000_000_000_000)))
    fwd = joins.join_view_forward(p, s)
    back_mirrored = joins.join_view_backward(mirror(p), mirror(s))
    assert _rows(mirror(fwd)) == _rows(back_mirrored)
    assert fwd.count() > 0


def test_interval_join_bucket_width_does_not_matter(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    p, s = i.projection(), i.sessions2()
    a = joins.join_view_backward(p, s)
    b = joins.join_view_backward(p, s, bucket=7 * 10**6)
    assert _rows(a) == _rows(b)


def test_latest_join_ties_and_timeout(spark):
    f = spark.createDataFrame(
        [("a", "2022-01-01 01:00:00", 1, 1), ("a", "2022-01-01 02:00:00", 2, 1),
         ("a", "2022-01-01 03:00:01", 3, 1), ("b", "2022-01-01 00:00:00", 4, 1)],
        "sessionid string, eventtime string, octets bigint, packets bigint")
    s = spark.createDataFrame(
        [("a", "2022-01-01 01:00:00", "10001"), ("a", "2022-01-01 01:00:00", "10009"),
         ("a", "2022-01-01 02:00:00", "10002")],
        "sessionid string, eventtime string, cellid string")
    f = f.withColumn("eventtime", F.col("eventtime").cast("timestamp"))
    s = s.withColumn("eventtime", F.col("eventtime").cast("timestamp"))
    got = {r.octets: r.cellid for r in joins.session_join_view(f, s, chunk=3600 * 10**6)
           .collect()}
    # equal times: largest cell; a session row at the same time counts;
    # 1 h 0 min 1 s idle is past the timeout; no session at all: no row
    assert got == {1: "10009", 2: "10002"}


def test_late_rows_by_hand(spark):
    rows = [(1, "00:00:10", "00:00:10"), (2, "00:00:50", "00:00:51"),
            (3, "00:00:19", "00:00:52"), (4, "00:00:20", "00:00:53"),
            (5, "00:00:30", "00:00:54")]
    df = spark.createDataFrame(rows, "flowid long, eventtime string, arrival string")
    df = df.select("flowid", *[F.concat(F.lit("2022-01-01 "), c).cast("timestamp").alias(c)
                               for c in ("eventtime", "arrival")])
    got = sorted(r.flowid for r in late.late_rows(df, tiebreak=["flowid"]).collect())
    assert got == [3]          # 19 s is 31 s behind 50 s; 20 s is exactly 30 s: kept


def test_meters_by_hand(spark):
    rows = [("2022-01-01 00:00:00.100", "2022-01-01 10:00:00"),
            ("2022-01-01 00:00:00.900", "2022-01-01 10:00:01"),
            ("2022-01-01 00:00:02.000", "2022-01-01 10:00:02")]
    df = spark.createDataFrame(rows, "arrival string, eventtime string").select(
        *[F.col(c).cast("timestamp").alias(c) for c in ("arrival", "eventtime")])
    dr = [tuple(r) for r in meters.data_rate(df).orderBy("rowtime").select(
        "rps", "cumulative_rows", "testsecs").collect()]
    assert dr == [(2, 2, 0), (1, 3, 2)]
    avg = [r.avg_rps for r in meters.running_avg_rps(df).orderBy("second").collect()]
    assert avg == [2.0, 1.5]
    tm = [tuple(r) for r in meters.throughput_meter(df).orderBy("clocktime").select(
        "recs_per_sec", "testsecs").collect()]
    # start = first arrival, 00:00:00.100; TIMESTAMPDIFF truncates 1.9 s to 1
    assert tm == [(2, -6), (1, -5)]
