"""Sinks: delimited text output, rotated files, and pumps between jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def write_rotated(records: DataFrame, path: str, records_per_file: int = 1_000_000,
                  sep: str = ",", mode: str = "overwrite") -> None:
    """Positional delimited lines, no header, a new file every
    ``records_per_file`` records (per task)."""
    line = F.concat_ws(sep, *[F.coalesce(F.col(c).cast("string"), F.lit(""))
                              for c in records.columns])
    (records.select(line.alias("value")).write.mode(mode)
     .option("maxRecordsPerFile", records_per_file).text(path))


def write_csv(df: DataFrame, path: str, header: bool = True, mode: str = "overwrite") -> None:
    """A result as CSV rows with a header line."""
    df.write.mode(mode).option("header", str(header).lower()).csv(path)


def pump(df: DataFrame, path: str, checkpoint: str, *, fmt: str = "parquet",
         trigger: dict | None = None, query_name: str | None = None) -> StreamingQuery:
    """Continuously append a streaming DataFrame to a typed table at ``path``
    (a named stream between two jobs).  The checkpoint makes it restartable
    with exactly-once file output."""
    w = (df.writeStream.format(fmt).outputMode("append")
         .option("checkpointLocation", checkpoint).option("path", path))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def write_ordered_stream(df: DataFrame, path: str, checkpoint: str, order: str = "eventtime",
                         fmt: str = "parquet", trigger: dict | None = None) -> StreamingQuery:
    """Stream sink whose files hold each micro-batch's rows sorted by ``order``
    (the reorder a T-sort promises downstream readers).

    Each batch is written to its own ``batch=<id>`` folder in overwrite mode,
    so a batch re-run after a failure replaces its own output: exactly once."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # a range-partitioned sort: files in name order hold ascending times
        batch.orderBy(order).write.mode("overwrite").format(fmt).save(
            f"{path.rstrip('/')}/batch={batch_id:012d}")

    w = (df.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
         .trigger(**(trigger or {"availableNow": True})))
    return w.start()
