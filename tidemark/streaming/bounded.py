"""Bounded runs of a streaming query: read everything, emit everything, stop.

Spark's event-time operators hold back whatever the watermark has not passed,
so after the last input file a stream leaves its tail in state (the frames
and joins of the last minutes).  A bounded run therefore appends, after the
real input is drained, one flush file per source holding a sentinel row with
a reserved key and an event time far beyond any frame, runs the query to
completion again, and removes the sentinel's own output.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..session import scratch_path
from ..sources.csv import side_folders

# valid as a text key and as an INT key
SENTINEL_KEY = "-2147483648"
# within the range pandas can hold (operators in Python see it too)
SENTINEL_TIME = "2200-01-01 00:00:00.000"


def sentinel_line(columns: list[tuple[str, int]], values: dict[str, str], sep: str = ","
                  ) -> str:
    """One delimited record with the given column values, empty elsewhere."""
    return sep.join(values.get(name, "") for name, _ in columns)


def default_flush(columns: list[tuple[str, int]], key: str = "sessionid",
                  time: str = "eventtime", numeric: tuple[str, ...] = ()) -> str:
    vals = {key: SENTINEL_KEY, time: SENTINEL_TIME}
    vals.update({c: "0" for c in numeric})
    return sentinel_line(columns, vals)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    """Append one text file holding ``text`` to a side folder, through
    Spark's committer (works on any cluster file system; the file appears
    whole, and the marker files it writes are hidden from file sources)."""
    (spark.createDataFrame([(text,)], "value string").coalesce(1)
     .write.mode("append").text(path))


def _run(stream: DataFrame, out: str, checkpoint: str) -> None:
    q: StreamingQuery = (stream.writeStream.format("parquet").outputMode("append")
                         .option("checkpointLocation", checkpoint).option("path", out)
                         .trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def run_bounded(spark: SparkSession, build: Callable[[], DataFrame], flush: dict[str, str],
                out: str | None = None, checkpoint: str | None = None,
                drop: Column | None = None) -> DataFrame:
    """Run ``build()`` (a streaming DataFrame over file sources) to the end of
    its input, flush, and return the complete output as a batch DataFrame.

    Sources that are a streaming sink's output (named streams) must be read
    with :func:`read_named_stream` and flushed with :func:`flush_named_stream`.

    ``flush`` maps each source directory to the sentinel record to append to
    it: it goes to a side folder that the readers of :mod:`tidemark.sources.csv`
    read along with the source, which itself is never written to.  ``drop``
    filters the sentinel's own output rows (default: rows whose ``sessionid``
    is the sentinel key; rows with a NULL key stay).  Output and checkpoint
    default to folders under the cluster's shared checkpoint directory."""
    run = scratch_path(spark, f"bounded-{uuid.uuid4().hex}")
    out = out or run + "/out"
    checkpoint = checkpoint or out.rstrip("/") + "-checkpoint"
    sides = {src: f"{run}/flush-{k}" for k, src in enumerate(flush)}
    for side in sides.values():
        spark.createDataFrame([], "value string").write.text(side)
    with side_folders(sides):
        _run(build(), out, checkpoint)
        for src, line in flush.items():
            _write_text(spark, sides[src], line)
        _run(build(), out, checkpoint)
    result = spark.read.parquet(out)
    if drop is None and "sessionid" in result.columns:
        drop = F.col("sessionid").cast("string").eqNullSafe(SENTINEL_KEY)
    if drop is None and "cellid" in result.columns:
        drop = F.col("cellid").cast("string").eqNullSafe(SENTINEL_KEY)
    return result.filter(~drop) if drop is not None else result


def flush_folder(path: str) -> str:
    """The side folder holding the flush record of a named stream."""
    return path.rstrip("/") + "_flush"


def read_named_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """A named stream (the output folder of a streaming file sink) plus its
    flush side folder.  Readers list a sink's folder through its metadata log,
    so a record written there by anything but that sink is never seen; the
    flush record of a bounded run goes to :func:`flush_folder` instead."""
    side = flush_folder(path)
    spark.createDataFrame([], schema).write.mode("append").parquet(side)
    return (spark.readStream.schema(schema).parquet(path)
            .unionByName(spark.readStream.schema(schema).parquet(side)))


def flush_named_stream(records: DataFrame, path: str) -> None:
    """Append sentinel records to a named stream's flush side folder."""
    records.write.mode("append").parquet(flush_folder(path))
