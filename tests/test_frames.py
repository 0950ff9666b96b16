"""Every frame plan equals Spark's own window; goldens for the window test."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.functions.frames import MICROS, range_frame
from tidemark.operators import windows
from tidemark.plans.catalog import Inputs
from tidemark.sources import csv

HERE = os.path.join(os.path.dirname(__file__), "fixtures")
STATS = windows.OCTET_STATS


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def proj(spark):
    return Inputs(spark, "/root/testdata/sf0.001").projection().cache()


@pytest.mark.parametrize("strategy,chunk", [("chunked", None), ("chunked", 7 * 60 * 10**6),
                                            ("two_level", None)])
@pytest.mark.parametrize("minutes", [1, 5, 60])
def test_row_frame_plans_equal_window(proj, strategy, chunk, minutes):
    base = range_frame(proj, ["sessionid"], "eventtime", STATS, minutes * MICROS["minute"],
                       strategy="window")
    kw = {"chunk": chunk} if chunk else {}
    got = range_frame(proj, ["sessionid"], "eventtime", STATS, minutes * MICROS["minute"],
                      strategy=strategy, **kw)
    assert _rows(got) == _rows(base)


@pytest.mark.parametrize("keys", [["sessionid"], []])
def test_offset_frame_bucketed_equals_window(proj, keys):
    args = (proj, keys, "eventtime", STATS, 60 * MICROS["minute"], MICROS["minute"])
    base = range_frame(*args, floor="minute", strategy="window")
    got = range_frame(*args, floor="minute", strategy="bucketed")
    assert _rows(got) == _rows(base)
    # an empty offset frame keeps its row, with count 0 and NULL statistics
    empty = got.filter("countOctets = 0").collect()
    assert empty and all(r.minOctets is None and r.sumOctets is None for r in empty)


@pytest.mark.parametrize("floor,strategies", [(None, ["two_level", "chunked"]), ("minute", ["bucketed"])])
@pytest.mark.parametrize("keys", [["sessionid"], []])
def test_null_keys_and_times_are_peers_in_every_plan(proj, floor, strategies, keys):
    """NULL keys share one partition, NULL times one peer group."""
    n = F.pmod(F.xxhash64("octets", "eventtime"), F.lit(10))
    df = proj.select(F.when(n > 2, F.col("sessionid")).alias("sessionid"),
                     F.when(n != 5, F.col("eventtime")).alias("eventtime"), "octets")
    assert df.where("sessionid IS NULL").count() > 50 and df.where("eventtime IS NULL").count() > 20
    args = (df, keys, "eventtime", STATS, 60 * MICROS["minute"], MICROS["minute"] if floor else 0)
    base = _rows(range_frame(*args, floor=floor, strategy="window"))
    for strategy in strategies:
        assert _rows(range_frame(*args, floor=floor, strategy=strategy)) == base


def test_bollinger_bands_of_one_hot_session_are_exact(spark):
    df = spark.range(20_000).selectExpr("'s' sessionid", "1000000000 + id % 7 octets",
                                        "timestamp_millis(1600000000000 + id * 180) eventtime")
    got = windows.bollinger_view(df).agg(F.max("upper_bb"), F.max("lower_bb")).first()
    w = range_frame(df, ["sessionid"], "eventtime", {"a": ("avg", "octets")}, MICROS["hour"], strategy="two_level")
    assert got[0] == pytest.approx(1e9 + 3 + 2 * 2, abs=1.1) and got[1] <= w.agg(F.max("a")).first()[0]


def test_frames_monotone_in_width(proj):
    counts = []
    for m in (1, 2, 5, 10, 20, 60):
        c = windows.agg_view(proj, m).agg(F.sum("countOctets")).first()[0]
        counts.append(c)
    assert counts == sorted(counts)
    assert _rows(windows.agg_view(proj, 60)) == _rows(windows.agg_view(proj, 60,
                                                                       strategy="window"))


def test_one_hot_key(spark, proj):
    """A third of the rows under one key: chunked and two-level plans split it
    by time and still equal the plain window."""
    hot = proj.withColumn("sessionid", F.when(F.pmod(F.hash("eventtime", "octets"), F.lit(3)) == 0,
                                              F.lit("HOT")).otherwise(F.col("sessionid")))
    base = windows.agg_view(hot, 60, strategy="window")
    for strategy in ("chunked", "two_level"):
        assert _rows(windows.agg_view(hot, 60, strategy=strategy, chunk=None)
                     if strategy == "chunked" else
                     windows.agg_view(hot, 60, strategy=strategy)) == _rows(base)


def test_bollinger_by_hand(spark):
    rows = [("s", "2022-01-01 00:00:00", 10), ("s", "2022-01-01 00:10:00", 20),
            ("s", "2022-01-01 00:10:00", 30), ("s", "2022-01-01 01:05:00", 40),
            ("t", "2022-01-01 00:00:00", 5)]
    df = spark.createDataFrame(rows, "sessionid string, eventtime string, octets bigint") \
        .withColumn("eventtime", F.col("eventtime").cast("timestamp"))
    got = {(r.sessionid, r.octets): (r.upper_bb, r.lower_bb)
           for r in windows.bollinger_view(df, digits=4).collect()}
    assert got[("s", 10)] == (10.0, 10.0)
    # peers: 10, 20, 30 -> mean 20, sd sqrt(200/3)
    sd = (200 / 3) ** 0.5
    assert got[("s", 20)] == (round(20 + 2 * sd, 4), round(20 - 2 * sd, 4))
    # 00:10 and 01:05 (00:00 is 65 minutes back): 20, 30, 40
    assert got[("s", 40)] == (round(30 + 2 * sd, 4), round(30 - 2 * sd, 4))
    assert got[("t", 5)] == (5.0, 5.0)


def test_testwindow_golden(spark):
    tw = csv.read_testwindow(spark, os.path.join(HERE, "testwindow.dat"))
    got = sorted(tuple(r) for r in windows.testwindow_v2(tw).collect())
    want = []
    for line in open(os.path.join(HERE, "testwindow.expected")).read().splitlines():
        et, c1, mn, mx, mnc, mxc, cnt = line.split(",")
        want.append((et + ".000", c1, mn + ".000", mx + ".000", mnc, mxc, int(cnt)))
    assert got == sorted(want)


def test_floor_div_and_frames_before_1970(spark):
    from tidemark.functions.scalars import floor_div
    vals = [-61, -60, -59, -1, 0, 1, 59, 60, 10**15 + 7]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    got = [r[0] for r in df.select(floor_div("v", 60)).collect()]
    assert got == [v // 60 for v in vals]
    rows = [("k", f"1969-12-31 23:{m:02d}:{s:02d}", m * 60 + s) for m in range(50, 60)
            for s in (0, 30)] + [("k", f"1970-01-01 00:{m:02d}:15", m) for m in range(10)]
    df = spark.createDataFrame(rows, "sessionid string, eventtime string, octets bigint") \
        .withColumn("eventtime", F.col("eventtime").cast("timestamp"))
    for minutes in (1, 5):
        base = windows.agg_view(df, minutes, strategy="window")
        for strategy in ("chunked", "two_level"):
            assert _rows(windows.agg_view(df, minutes, strategy=strategy)) == _rows(base)


def test_null_event_times_are_kept(spark):
    rows = [("k", "2022-01-01 00:00:00", 1), ("k", None, 2), ("k", None, 3),
            ("k", "2022-01-01 00:30:00", 4), ("j", None, 5)]
    df = spark.createDataFrame(rows, "sessionid string, eventtime string, octets bigint") \
        .withColumn("eventtime", F.col("eventtime").cast("timestamp"))
    base = windows.agg_view(df, 60, strategy="window")
    assert base.count() == 5
    for strategy in ("chunked", "two_level"):
        assert _rows(windows.agg_view(df, 60, strategy=strategy)) == _rows(base)
