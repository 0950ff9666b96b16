"""Pumps between jobs, merged streams and the streaming meter."""

import time

from pyspark.sql import functions as F

from tidemark.operators import projection, shard
from tidemark.sources import csv
from tidemark.sources.sinks import pump, write_rotated
from tidemark.sources.tables import flow_records, table
from tidemark.streaming import ops

SF = "/root/testdata/sf0.001"


def test_pump_and_merge(spark, tmpdir_path):
    ev = table(spark, SF, "events")
    rec = flow_records(ev)
    # two pumps from disjoint directories into one typed stream
    write_rotated(rec.filter("pmod(cast(flowid as int), 2) = 0"), tmpdir_path + "/in0", 100)
    write_rotated(rec.filter("pmod(cast(flowid as int), 2) = 1"), tmpdir_path + "/in1", 100)
    ing = [projection.flows_ingestion(csv.read_flows(spark, f"{tmpdir_path}/in{k}",
                                                     stream=True)) for k in (0, 1)]
    q = pump(shard.merge_streams(*ing), tmpdir_path + "/out", tmpdir_path + "/ckpt")
    q.awaitTermination()
    out = spark.read.parquet(tmpdir_path + "/out")
    assert out.count() == rec.count()                      # no row twice, none lost
    assert dict(out.dtypes)["sessionid"] == "int"
    # a restart over the same checkpoint writes nothing again
    q = pump(shard.merge_streams(*ing), tmpdir_path + "/out", tmpdir_path + "/ckpt")
    q.awaitTermination()
    assert spark.read.parquet(tmpdir_path + "/out").count() == rec.count()


def test_stream_throughput_meter(spark, tmpdir_path):
    ev = table(spark, SF, "events")
    write_rotated(flow_records(ev), tmpdir_path + "/in", 100)
    p = projection.projection_view(csv.read_flows(spark, tmpdir_path + "/in", stream=True))
    q = (ops.throughput_meter(p, start="2000-01-01 00:00:00").writeStream.format("memory")
         .queryName("meter_t")
         .outputMode("update").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("select sum(recs_per_sec), min(testsecs) from meter_t").first()
    assert got[0] == flow_records(ev).count()
    assert got[1] > 0


def test_stream_rate_equals_batch_meter(spark, tmpdir_path):
    """With the record load time as arrival, the streamed per-second table plus
    its read-time running columns equal the batch meters."""
    from tidemark.operators import meters
    from tidemark.streaming import bounded

    ev = table(spark, SF, "events")
    write_rotated(flow_records(ev).orderBy("load_ts").coalesce(1), tmpdir_path + "/in", 150)

    def with_arrival(df):
        return projection.projection_view(
            df.withColumn("arrival", F.col("load_ts").cast("timestamp")), keep=("arrival",))

    def build():
        f = with_arrival(csv.read_flows(spark, tmpdir_path + "/in", stream=True,
                                        max_files_per_trigger=1))
        return ops.stream_rate(f, arrival="arrival")

    from tidemark.sources.schemas import FLOWS_COLUMNS
    sentinel = bounded.sentinel_line(FLOWS_COLUMNS, {
        "load_ts": bounded.SENTINEL_TIME, "eventtime": bounded.SENTINEL_TIME,
        "sessionid": bounded.SENTINEL_KEY})
    per_second = bounded.run_bounded(spark, build, {tmpdir_path + "/in": sentinel},
                                     out=tmpdir_path + "/out", checkpoint=tmpdir_path + "/ckpt",
                                     drop=F.year("rowtime") >= 2200)
    got = ops.finish_rate(per_second)
    batch_in = with_arrival(csv.read_flows(spark, tmpdir_path + "/in")
                            .filter(F.col("sessionid") != bounded.SENTINEL_KEY))
    want = meters.data_rate(batch_in).join(
        meters.running_avg_rps(batch_in).withColumnRenamed("second", "rowtime"),
        ["rowtime", "rps"])
    cols = ["rowtime", "rps", "cumulative_rows", "rowtime_low", "rowtime_high", "avg_rps"]
    assert sorted(map(tuple, got.select(*cols).collect())) == \
        sorted(map(tuple, want.select(*cols).collect()))


def test_bounded_run_keeps_null_keys_and_its_source(spark, tmpdir_path):
    """NULL and INT keys survive the end-of-input flush, and the source folder
    holds the files it held."""
    import os

    from tidemark.sources.schemas import FLOWS_COLUMNS, TONNAGE
    from tidemark.streaming import bounded
    ev = table(spark, SF, "events").limit(40)
    lines = flow_records(ev)
    write_rotated(lines.withColumn("sessionid", F.when(F.col("flowid").cast("int") % 2 == 0, F.col("sessionid"))),
                  tmpdir_path + "/in", 100)
    before = sorted(os.listdir(tmpdir_path + "/in"))
    flush = {tmpdir_path + "/in": bounded.default_flush(FLOWS_COLUMNS, numeric=tuple(TONNAGE))}
    for typed in (False, True):
        def build(typed=typed):
            f = csv.read_flows(spark, tmpdir_path + "/in", stream=True, typed=typed)
            return f.select("sessionid", "eventtime")
        out = bounded.run_bounded(spark, build, flush)
        assert out.count() == lines.count()
        assert out.where("sessionid IS NULL").count() > 0
    assert sorted(os.listdir(tmpdir_path + "/in")) == before


def test_sharded_dataflow_stream_equals_batch(spark, tmpdir_path):
    """Ingestion pumps write the two named streams; a second streaming job
    reads them, computes the per-session offset frame and joins the session
    rows of the preceding five minutes - equal to the batch pipeline."""
    from collections import Counter

    from tidemark.operators import joins, windows
    from tidemark.sources.tables import session_records
    from tidemark.streaming import bounded

    ev = table(spark, SF, "events")
    write_rotated(flow_records(ev).orderBy("eventtime").coalesce(1), tmpdir_path + "/f", 150)
    write_rotated(session_records(ev).orderBy("eventtime").coalesce(1), tmpdir_path + "/s", 150)
    # job 1: pumps into typed named streams (parquet tables)
    fq = pump(projection.flows_ingestion(csv.read_flows(spark, tmpdir_path + "/f", stream=True)),
              tmpdir_path + "/flows_out", tmpdir_path + "/ck_f")
    sq = pump(projection.sessions_ingestion(csv.read_sessions(spark, tmpdir_path + "/s",
                                                              stream=True)),
              tmpdir_path + "/sessions_out", tmpdir_path + "/ck_s")
    fq.awaitTermination()
    sq.awaitTermination()
    f_schema = spark.read.parquet(tmpdir_path + "/flows_out").schema
    s_schema = spark.read.parquet(tmpdir_path + "/sessions_out").schema

    # job 2: offset frame per session over the flows stream -> a named stream;
    # job 3: that stream joined with the sessions stream.  Separate queries,
    # as the upstream pumps are: an append aggregation feeding a join in the
    # same query would emit its rows behind the join's watermark.
    # A stream written by a streaming sink is listed through its metadata log,
    # so the flush record of each named stream goes to a plain side folder
    # read as a second source.
    one = spark.createDataFrame([(bounded.SENTINEL_TIME,)], "t string").select(
        F.col("t").cast("timestamp").alias("t"))
    f_sentinel = one.select(F.col("t").alias("rowtime"),
                            F.lit(bounded.SENTINEL_TIME).alias("eventtime"),
                            F.lit(-1).alias("sessionid"), F.lit(0).cast("bigint").alias("octets"),
                            F.lit(0).cast("bigint").alias("packets")).select(*f_schema.names)
    s_sentinel = one.select(F.col("t").alias("rowtime"), F.lit(-1).alias("sessionid"),
                            F.lit(bounded.SENTINEL_TIME).alias("eventtime"),
                            F.lit(bounded.SENTINEL_KEY).alias("cellid")).select(*s_schema.names)

    def named(path, schema):
        return bounded.read_named_stream(spark, path, schema)

    def run_twice(build, out, ck, flush):
        for step in (0, 1):
            if step:
                flush()
            q = (build().writeStream.format("parquet").option("path", out)
                 .option("checkpointLocation", ck).trigger(availableNow=True).start())
            q.awaitTermination()

    agg_out = tmpdir_path + "/agg_named"
    run_twice(lambda: ops.flows_agg_step_1(named(tmpdir_path + "/flows_out", f_schema)),
              agg_out, tmpdir_path + "/ck_agg",
              lambda: bounded.flush_named_stream(f_sentinel, tmpdir_path + "/flows_out"))
    a_schema = spark.read.parquet(agg_out).schema

    def join_job():
        # the first job's sentinel row arrives in its output and closes this one
        agg = spark.readStream.schema(a_schema).parquet(agg_out)
        se = named(tmpdir_path + "/sessions_out", s_schema)
        return ops.flows_agg_step_2(agg, se.select("sessionid", F.col("rowtime")
                                                   .alias("eventtime"), "cellid"))

    out = tmpdir_path + "/agg_out"
    run_twice(join_job, out, tmpdir_path + "/ck_join",
              lambda: bounded.flush_named_stream(s_sentinel, tmpdir_path + "/sessions_out"))
    got = spark.read.parquet(out).filter(F.col("sessionid") != -1)

    bf = spark.read.parquet(tmpdir_path + "/flows_out").filter(F.col("sessionid") != -1)
    bs = spark.read.parquet(tmpdir_path + "/sessions_out").filter(F.col("sessionid") != -1)
    want = joins.flows_agg_step_2(windows.flows_agg_step_1(bf),
                                  bs.select("sessionid", F.col("rowtime").alias("eventtime"),
                                            "cellid"))
    cols = want.columns
    assert Counter(map(tuple, got.select(*cols).collect())) == \
        Counter(map(tuple, want.select(*cols).collect()))
    assert want.count() > 0


def test_two_pumps_fill_one_stream_and_one_is_restarted(spark, tmpdir_path, monkeypatch):
    """A pump dies between its rows and its record, and once more after the record but
    before its checkpoint: no row is there twice or lost, and a reader that follows
    the stream sees each row once."""
    import pytest

    from tidemark.streaming import named
    rec = flow_records(table(spark, SF, "events"))
    ing = {}
    for k in (0, 1):
        write_rotated(rec.filter(f"pmod(cast(flowid as int), 2) = {k}"), f"{tmpdir_path}/in{k}", 100)
        ing[k] = projection.flows_ingestion(csv.read_flows(spark, f"{tmpdir_path}/in{k}", stream=True, max_files_per_trigger=1))
    stream = named.NamedStream(spark, tmpdir_path + "/named", ing[0].schema)
    assert stream.read().count() == 0
    seen = []

    def follow():
        q = stream.forward(lambda rows, batch: seen.extend(r.octets for r in rows.select("octets").collect()), tmpdir_path + "/ck_read")
        q.awaitTermination()

    def pump(k):
        stream.pump(ing[k], f"pump{k}", f"{tmpdir_path}/ck{k}").awaitTermination()
    write = named.write_whole
    for after in (False, True):
        def dies(spark_, path, text, after=after):
            if "pump0" in path and path.endswith(f"{1 + after:012d}.json"):
                if after:
                    write(spark_, path, text)
                raise RuntimeError("lost")
            write(spark_, path, text)
        monkeypatch.setattr(named, "write_whole", dies)
        with pytest.raises(Exception, match="lost"):
            pump(0)
        follow()
    monkeypatch.setattr(named, "write_whole", write)
    pump(1)
    follow()
    pump(0)
    follow()
    want = sorted(r.octets for r in projection.flows_ingestion(rec).select("octets").collect())
    assert sorted(r.octets for r in stream.read().select("octets").collect()) == want
    assert sorted(seen) == want and dict(stream.read().dtypes)["sessionid"] == "int"
