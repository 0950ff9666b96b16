"""Tables staged in the cluster's shared checkpoint folder.

Staging cuts lineage in a way that survives lost executors: the rows are
Parquet files in the folder that ``spark.checkpoint.dir`` names, never on a
machine's own disk.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

#: rows handed to Python at once, so that batches of long texts stay small
ARROW_ROWS = 256


_shipped: set[str] = set()


def _ship(spark: SparkSession) -> None:
    """Send this package to the executors, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="package-"), "package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings that bound the memory of Python tasks, and the package on the
    executors."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    _ship(spark)
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"{name}-{uuid.uuid4().hex}")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nested(df: DataFrame, *own, apart: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``own``, and all columns but ``apart`` inside ``_row``, so that
    no other name can clash with those that an operator adds."""
    return df.select(*own, F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in apart]).alias("_row"))


def row_columns(df: DataFrame, *without: str) -> list:
    """The columns that ``nested`` put inside ``_row``, but for some."""
    return [F.col(f"_row.`{c}`").alias(c) for c in df.columns if c not in without]


def unnested(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of ``nested(docs, "text", apart=("text",))`` with the columns of ``docs``."""
    rest = dict(zip([c for c in docs.columns if c != "text"], row_columns(docs, "text")))
    return judged.select(*[rest.get(c, F.col("text")) for c in docs.columns])


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
