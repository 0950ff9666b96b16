"""Named streams: typed tables between jobs that several pumps can fill.

A streaming file sink's folder has one log and so one writer.  A named stream has a
commit record for each (writer, batch): a pump writes a batch into a folder of its
own and then its record, whole or not at all.  Readers take only what records name.
A pump that dies between the two writes the folder again when it comes back, and a
batch whose record exists is not written again, so no row is there twice or lost.
Pumps know nothing of each other; each needs a name of its own.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from .steps import exists, write_whole

RECORD = "writer string, batch long, rows string"


class NamedStream:
    """A named stream of ``schema`` in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        if not exists(spark, f"{self.path}/commits"):
            write_whole(spark, f"{self.path}/commits/_made", "")

    def _record(self, writer: str, batch: int) -> str:
        return f"{self.path}/commits/{writer}-{batch:012d}.json"

    def append(self, rows: DataFrame, writer: str, batch: int) -> None:
        """Add a batch of ``writer``, once; columns are taken by name and cast."""
        if exists(self.spark, self._record(writer, batch)):
            return
        folder = f"rows/writer={writer}/batch={batch:012d}"
        rows.select(*[rows[f.name].cast(f.dataType).alias(f.name) for f in self.schema]) \
            .write.mode("overwrite").parquet(f"{self.path}/{folder}")
        write_whole(self.spark, self._record(writer, batch),
                    json.dumps({"writer": writer, "batch": batch, "rows": folder}))

    def pump(self, df: DataFrame, writer: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Fill the stream from a streaming DataFrame, as ``writer``."""
        return (df.writeStream.foreachBatch(lambda rows, batch: self.append(rows, writer, batch))
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())

    def commits(self) -> DataFrame:
        return self.spark.read.schema(RECORD).option("pathGlobFilter", "*.json").json(f"{self.path}/commits")

    def commit_stream(self) -> DataFrame:
        """The commit records as they come: a stream to read batches by."""
        return self.spark.readStream.schema(RECORD).option("pathGlobFilter", "*.json").json(f"{self.path}/commits")

    def rows_of(self, commits: DataFrame) -> DataFrame:
        """The rows of some commit records (one for each micro-batch of a pump)."""
        folders = [f"{self.path}/{r.rows}" for r in commits.select("rows").collect()]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else \
            self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        """All rows committed so far."""
        return self.rows_of(self.commits())

    def forward(self, to, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
        """Call ``to(rows, batch)`` with the rows of each batch of new commits, once a batch
        unless it failed."""
        return (self.commit_stream().writeStream.foreachBatch(lambda c, batch: to(self.rows_of(c), batch))
                .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start())
