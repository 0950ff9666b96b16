"""Plan shape and skew: the properties the scale design relies on."""

from collections import Counter

from pyspark.sql import functions as F

from tidemark.operators import joins, projection, shard, windows
from tidemark.plans.catalog import Inputs


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _hot(df):
    """Move a third of the rows to one session."""
    return df.withColumn("sessionid", F.when(F.pmod(F.hash("eventtime"), F.lit(3)) == 0,
                                             F.lit("00000000")).otherwise(F.col("sessionid")))


def _naive_backward(p, s):
    l, r = p.alias("l"), s.alias("r")
    cond = ((F.col("l.sessionid") == F.col("r.sessionid"))
            & (F.col("r.eventtime") >= F.col("l.eventtime") - F.expr("INTERVAL 5 MINUTES"))
            & (F.col("r.eventtime") <= F.col("l.eventtime")))
    return l.join(r, cond).select("l.sessionid", "l.eventtime", "r.cellid", "l.octets",
                                  "l.packets")


def test_interval_join_with_hot_session(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    p, s = _hot(i.projection()), _hot(i.sessions2())
    got = joins.join_view_backward(p, s)
    assert _rows(got) == _rows(_naive_backward(p, s))
    # the join key carries the time bucket, so a hot session is split by time
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(joins.join_view_backward(p, s))
        assert "SortMergeJoin [sessionid" in plan and "_b" in plan.split("SortMergeJoin")[1][:200]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_latest_join_with_hot_session(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    p, s = _hot(i.projection()), _hot(i.sessions2())
    small = joins.session_join_view(p, s, chunk=2 * 3600 * 10**6)   # many chunks
    large = joins.session_join_view(p, s)
    assert _rows(small) == _rows(large)
    assert small.count() > 0


def test_per_cell_two_level_with_hot_cell(spark):
    i = Inputs(spark, "/root/testdata/sf0.001")
    j = joins.join_view_backward(i.projection(), i.sessions2())
    j = j.withColumn("cellid", F.when(F.pmod(F.hash("octets"), F.lit(3)) == 0,
                                      F.lit("10000")).otherwise(F.col("cellid")))
    assert _rows(windows.join_n_agg_view(j)) == \
        _rows(windows.join_n_agg_view(j, strategy="window"))


def test_scan_pruning_and_pushdown(spark, tmpdir_path):
    from tidemark.sources import csv
    from tidemark.sources.sinks import write_rotated
    from tidemark.sources.tables import flow_records, table
    ev = table(spark, "/root/testdata/sf0.001", "events")
    write_rotated(flow_records(ev), tmpdir_path + "/flows", 1000)
    ing = projection.flows_ingestion(csv.read_flows(spark, tmpdir_path + "/flows"))
    ing.write.parquet(tmpdir_path + "/ingested")
    # a shard filter over the stored stream reaches the parquet scan
    stored = spark.read.parquet(tmpdir_path + "/ingested")
    plan = _plan(shard.shard(stored, 2, 1).select("sessionid", "octets"))
    assert "PushedFilters: [IsNotNull(sessionid)" in plan
    assert "ReadSchema: struct<sessionid:int,octets:bigint>" in plan
    # the CSV scan of a projection reads 10 of the 72 columns
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    try:
        plan = _plan(projection.projection_view(csv.read_flows(spark, tmpdir_path + "/flows")))
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    read = plan.split("ReadSchema: struct<")[1].split(">")[0]
    assert len(read.split(",")) == 10


def test_no_query_pairs_everything(spark):
    """No registered query plans a cartesian product or a nested-loop join."""
    import __spark_entry__ as E
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for name, q in E.queries().items():
            plan = _plan(q(spark, "/root/testdata/sf0.001"))
            assert "CartesianProduct" not in plan, name
            assert "NestedLoopJoin" not in plan, name
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_expensive_inputs_are_evaluated_once(spark):
    """The joins under the per-cell views run once (both parts read one exchange),
    the meters scan once."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        from tidemark.plans import catalog
        scans = {n: _plan(catalog.query(n)(spark, "/root/testdata/sf0.001")).count("FileScan")
                 for n in ("join_n_agg_view_backward", "join_n_agg_view2",
                           "throughput_meter", "data_rate", "running_avg_rps")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    # two sides of one join; one table
    assert scans == {"join_n_agg_view_backward": 2, "join_n_agg_view2": 2,
                     "throughput_meter": 1, "data_rate": 1, "running_avg_rps": 1}


def test_shards_join_without_exchange(spark):
    """The union over shards equals the join of sharded tables, for any number of
    shards; rows without a session are in no shard.  The join reads both tables in
    place, in as many tasks as there are shards."""
    from tidemark.functions.frames import MICROS
    i = Inputs(spark, "/root/testdata/sf0.001")
    f = i.ingested_flows()
    f = f.unionByName(f.limit(3).withColumn("sessionid", F.lit(None).cast("int")))
    s = i.ingested_sessions().select("sessionid", F.col("rowtime").alias("eventtime"), "cellid")

    def one(flows, sessions):
        return joins.flows_agg_step_2(windows.flows_agg_step_1(flows), sessions)
    for n in (2, 5):
        want = shard.sharded(one, [f, s], n)
        got = shard.co_sharded_join(windows.flows_agg_step_1(f), s, n, 0, 5 * MICROS["minute"])
        assert _rows(got.select(*want.columns)) == _rows(want)
        plan = _plan(got)
        assert "SortMergeJoin" in plan and "Exchange" not in plan and f"SelectedBucketsCount: {n} out of {n}" in plan
        assert got.rdd.getNumPartitions() == n
