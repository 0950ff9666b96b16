"""Delimited-text sources: flows, sessions and the two-column window test.

Every reader works in batch (``stream=False``) and Structured Streaming
(``stream=True``) with the same schema and options, so a streaming job and its
batch twin see identical rows.  Schemas are declared, never inferred.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .schemas import (TESTWINDOW_SCHEMA, flows_schema, sessions_schema,
                      with_corrupt_column)

CORRUPT = "_corrupt_record"


def regex_to_glob(pattern: str) -> str:
    """Translate the simple file-name regexes of the upstream catalogs
    (``flows_.*csv``, ``repro.*``) to the glob ``pathGlobFilter`` expects."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith(".*", i):
            out.append("*")
            i += 2
        elif pattern[i] == ".":
            out.append("?")
            i += 1
        elif pattern[i] == "\\" and i + 1 < len(pattern):
            out.append(pattern[i + 1])
            i += 2
        else:
            out.append(pattern[i])
            i += 1
    return "".join(out)


def csv_options(sep: str = ",", header: bool = False, quote: bool = False,
                encoding: str = "UTF-8", mode: str = "FAILFAST", corrupt: bool = False) -> dict:
    opts = {
        "sep": sep,
        "header": str(header).lower(),
        "encoding": encoding,
        "mode": mode,
        # timestamps are parsed by the views, not by the reader; an empty
        # field is NULL
        "enforceSchema": "true",
    }
    if not quote:
        opts["quote"] = ""          # quote character disabled
    if corrupt:
        opts["mode"] = "PERMISSIVE"
        opts["columnNameOfCorruptRecord"] = CORRUPT
    return opts


def _reader(spark: SparkSession, schema: T.StructType, stream: bool, pattern: str | None,
            max_files_per_trigger: int | None, opts: dict):
    r = spark.readStream if stream else spark.read
    r = r.schema(schema).options(**opts)
    if pattern:
        glob = pattern if not re.search(r"\.\*|\\", pattern) else regex_to_glob(pattern)
        r = r.option("pathGlobFilter", glob)
    if stream and max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r


#: while a bounded run builds its query: source folder -> folder of its flush record
_side_folders: dict[str, str] = {}


@contextmanager
def side_folders(sides: dict[str, str]):
    """Streams read inside also read the side folder of their source, so that
    nothing is written to the source itself."""
    _side_folders.update({k.rstrip("/"): v for k, v in sides.items()})
    try:
        yield
    finally:
        for k in sides:
            _side_folders.pop(k.rstrip("/"), None)


def _read(spark, schema, path, stream, pattern, max_files_per_trigger, sep, header, quote,
          rejected):
    if rejected:
        schema = with_corrupt_column(schema)
    opts = csv_options(sep=sep, header=header, quote=quote,
                       mode="PERMISSIVE" if rejected else "FAILFAST", corrupt=rejected)
    df = _reader(spark, schema, stream, pattern, max_files_per_trigger, opts).csv(path)
    side = _side_folders.get(path.rstrip("/")) if stream else None
    if side:
        df = df.unionByName(_reader(spark, schema, True, None, None, opts).csv(side))
    return df


def read_flows(spark: SparkSession, path: str, *, stream: bool = False,
               pattern: str | None = None, typed: bool = False, sep: str = ",",
               header: bool = False, quote: bool = False, rejected: bool = False,
               max_files_per_trigger: int | None = None) -> DataFrame:
    """The 72-column flows records under ``path`` (a file or a directory).

    ``pattern`` filters file names (a glob, or one of the simple regexes the
    upstream catalogs use); ``typed`` reads ``sessionid`` as INT; ``rejected``
    keeps malformed rows in a ``_corrupt_record`` column instead of failing."""
    return _read(spark, flows_schema(typed), path, stream, pattern, max_files_per_trigger,
                 sep, header, quote, rejected)


def read_sessions(spark: SparkSession, path: str, *, stream: bool = False,
                  pattern: str | None = None, typed: bool = False, sep: str = ",",
                  header: bool = False, quote: bool = False, rejected: bool = False,
                  max_files_per_trigger: int | None = None) -> DataFrame:
    """The 102-column sessions records; see :func:`read_flows`."""
    return _read(spark, sessions_schema(typed), path, stream, pattern, max_files_per_trigger,
                 sep, header, quote, rejected)


def read_testwindow(spark: SparkSession, path: str, *, stream: bool = False,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """``event_time TIMESTAMP(3), c1 VARCHAR(4)`` text; times truncated to ms."""
    opts = csv_options()
    opts["timestampFormat"] = "yyyy-MM-dd HH:mm:ss[.SSS]"
    df = _reader(spark, TESTWINDOW_SCHEMA, stream, None, max_files_per_trigger, opts).csv(path)
    return df.withColumn("event_time", F.date_trunc("millisecond", "event_time"))


def split_rejected(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows) of a reader called with ``rejected=True``.

    Rejected rows keep their raw text in ``_corrupt_record``; good rows lose the
    column.  (Spark requires the corrupt column to be selected with other
    columns, which both branches do.)"""
    good = df.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)
    bad = df.filter(F.col(CORRUPT).isNotNull())
    return good, bad


def parse_lines(lines: DataFrame, schema: T.StructType, sep: str = ",",
                column: str = "value", rejected: bool = False,
                timestamp_format: str | None = None) -> DataFrame:
    """Parse a column of delimited lines with the CSV reader's own parser
    (``from_csv``), positional, quote disabled.  Used when the records come
    from another DataFrame rather than from files.  ``rejected`` keeps malformed
    lines in ``_corrupt_record`` for :func:`split_rejected` instead of failing."""
    if rejected:
        schema = with_corrupt_column(schema)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    opts = {"sep": sep, "quote": "\u0000", "mode": "PERMISSIVE" if rejected else "FAILFAST"}
    if rejected:
        opts["columnNameOfCorruptRecord"] = CORRUPT
    if timestamp_format:
        opts["timestampFormat"] = timestamp_format
    parsed: Column = F.from_csv(F.col(column), ddl, opts)
    return lines.select(parsed.alias("r")).select("r.*")


def reject_reason(column: str, schema: T.StructType, sep: str = ",",
                  timestamp_format: str | None = None) -> Column:
    """Why a delimited line does not fit ``schema``: the number of its fields, or the
    first field that cannot be read as its type; NULL if it fits."""
    parts = F.split(F.col(column), re.escape(sep), -1)
    reason = F.when(F.size(parts) != len(schema), F.lit("fields"))
    for k, f in enumerate(schema):
        value = F.nullif(parts[k], F.lit(""))
        if isinstance(f.dataType, T.TimestampType):
            read = F.try_to_timestamp(value, F.lit(timestamp_format)) if timestamp_format else F.try_to_timestamp(value)
        elif isinstance(f.dataType, T.StringType):
            continue
        else:
            read = value.try_cast(f.dataType)
        reason = reason.when(value.isNotNull() & read.isNull(), F.lit(f.name))
    return reason
