"""WARC archives as a PySpark data source.

Writing: each task appends records to files of bounded size under the path;
a commit message names the files of finished tasks, and the driver lists them
in a manifest, so files of failed or repeated attempts are never read.
Records are gzip members of their own.  Reading: one partition per file (files
are bounded).  Header lines are parsed first; filters on record type, page and
digest are pushed down and judged on the headers, and the payload of a record
that is not wanted, or of any record when the column is not asked for, is
skipped and never decoded.

Files are opened through Arrow's file systems, so a path may be a local or
shared folder or any store that Arrow knows by URI.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    WriterCommitMessage,
)

from .staging import new_path, staged

FILE_BYTES = 256 << 20
READ_BYTES = 1 << 18
ROWS = 512
MANIFEST = "manifest.json"
SCHEMA = ("record_type string, page_id long, url string, refers_to long, payload_bytes long, "
          "payload_digest string, payload binary")
#: columns that stand in header lines, by header
HEADERS = {"WARC-Type": "record_type", "X-Page-Id": "page_id", "WARC-Target-URI": "url",
           "X-Refers-To-Page": "refers_to", "X-Payload-Length": "payload_bytes", "WARC-Payload-Digest": "payload_digest"}
LONGS = {"page_id", "refers_to", "payload_bytes"}


def open_fs(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _clean(value) -> str:
    """A header value on one line; percent signs and line breaks are escaped."""
    return str(value).replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _restore(value: str) -> str:
    return value.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def encode(row) -> bytes:
    """One record: header lines, an empty line, the payload, two line ends."""
    body = b"" if row["record_type"] == "revisit" else bytes(row["payload"] or b"")
    lines = ["WARC/1.1", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>"]
    for header, column in HEADERS.items():
        if row[column] is not None:
            lines.append(f"{header}: {_clean(row[column])}")
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}", "", ""]
    z = zlib.compressobj(4, wbits=31)
    return z.compress("\r\n".join(lines).encode() + body + b"\r\n\r\n") + z.flush()


@dataclass
class Written(WriterCommitMessage):
    files: list


class Writer(DataSourceWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool = False):
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, rows) -> Written:
        store, base = open_fs(self.path)
        store.create_dir(base, recursive=True)
        files, out, size = [], None, 0
        for row in rows:
            if out is None or size >= self.file_bytes:
                if out is not None:
                    out.close()
                files.append(f"{uuid.uuid4().hex}.warc.gz")
                out, size = store.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
            record = encode(row)
            out.write(record)
            size += len(record)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        store, base = open_fs(self.path)
        store.create_dir(base, recursive=True)
        names = {n for m in messages if m is not None for n in m.files}
        # files of earlier writes stay, unless they are overwritten
        if not self.overwrite and store.get_file_info(f"{base}/{MANIFEST}").type == fs.FileType.File:
            with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
                names.update(json.loads(f.read()))
        with store.open_output_stream(f"{base}/{MANIFEST}", compression=None) as f:
            f.write(json.dumps(sorted(names)).encode())

    def abort(self, messages) -> None:
        """Files without a manifest are never read."""


class Member:
    """A gzip member that is unpacked only as far as it is asked for."""

    def __init__(self, stream, held: bytes):
        self.stream, self.held, self.z, self.out = stream, held, zlib.decompressobj(wbits=31), b""

    def _more(self) -> bool:
        if self.z.eof:
            return False
        if not self.held:
            self.held = self.stream.read(READ_BYTES)
            if not self.held:
                raise EOFError("a WARC record is cut short")
        self.out += self.z.decompress(self.held, READ_BYTES)
        self.held = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def headers(self) -> dict[str, str]:
        while b"\r\n\r\n" not in self.out and self._more():
            pass
        head, _, self.out = self.out.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")[1:]
        return dict(x.split(": ", 1) for x in lines)

    def body(self, size: int) -> bytes:
        parts = [self.out]
        have = len(self.out)
        while have < size:
            self.out = b""
            if not self._more():
                break
            parts.append(self.out)
            have += len(self.out)
        whole = b"".join(parts)
        self.out = whole[size:]
        return whole[:size]

    def rest(self) -> bytes:
        """Skip to the end of the member; the bytes after it."""
        while True:
            self.out = b""
            if not self._more():
                return self.held


@dataclass
class FilePart(InputPartition):
    name: str


class Reader(DataSourceReader):
    def __init__(self, path: str, wanted: list[str]):
        self.path, self.wanted, self.tests = path, wanted, []

    def pushFilters(self, filters: list[Filter]):
        """Equality and membership tests on header columns are judged here."""
        columns = set(HEADERS.values())
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name in columns and isinstance(f, EqualTo):
                self.tests.append((name, (f.value,)))
            elif name in columns and isinstance(f, In):
                self.tests.append((name, tuple(f.value)))
            elif name in columns and isinstance(f, IsNotNull):
                self.tests.append((name, None))
            else:
                yield f

    def partitions(self) -> list[FilePart]:
        store, base = open_fs(self.path)
        with store.open_input_stream(f"{base}/{MANIFEST}", compression=None) as f:
            return [FilePart(n) for n in json.loads(f.read())] or [FilePart("")]

    def _passes(self, row: dict) -> bool:
        return all(row[c] is not None if values is None else row[c] in values for c, values in self.tests)

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        schema = pa.schema([(c, pa.binary() if c == "payload" else pa.int64() if c in LONGS else pa.string())
                            for c in self.wanted])
        store, base = open_fs(self.path)
        rows, size = [], 0
        with store.open_input_stream(f"{base}/{part.name}", compression=None) as f:
            held = f.read(READ_BYTES)
            while held:
                member = Member(f, held)
                head = member.headers()
                row = {c: head.get(h) for h, c in HEADERS.items()}
                row = {c: v if v is None else int(v) if c in LONGS else _restore(v) for c, v in row.items()}
                if self._passes(row):
                    if "payload" in self.wanted:
                        row["payload"] = member.body(int(head["Content-Length"]))
                        size += len(row["payload"])
                    rows.append(row)
                held = member.rest() or f.read(READ_BYTES)
                if len(rows) >= ROWS or size >= 8 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)
                    rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class WarcSource(DataSource):
    """``format("warc")``; options: path, file_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], schema.fieldNames())

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], int(self.options.get("file_bytes", FILE_BYTES)), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Records of the archives under ``path``; ``columns`` limits what is decoded."""
    register(spark)
    reader = spark.read.format("warc")
    if columns is not None:
        kinds = dict(c.split() for c in SCHEMA.split(", "))
        reader = reader.schema(", ".join(f"{c} {kinds[c]}" for c in columns))
    return reader.load(path)


def as_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """A record per page.  Of equal payloads of ``least_bytes`` or more the one
    with the smallest page id is the response, the others revisit it.

    Only digests that occur again are kept as the small side of the join, one
    row each; pages with equal digests on the large side are split by Spark's
    skew join.  Pages without an id, and later rows of the same id, are
    responses of their own when nothing smaller holds their payload.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"),
                        F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    again = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest") \
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    again = staged(again, "digests").withColumnRenamed("payload_digest", "again")
    # a page that is no revisit needs no look at the table of repeated digests beyond the join
    rows = rows.join(again, F.col("payload_digest") == F.col("again"), "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & (F.col("page_id") > F.col("first"))
    revisit = F.coalesce(revisit, F.lit(False))
    return rows.select(F.when(revisit, "revisit").otherwise("response").alias("record_type"), "page_id", "url",
                       F.when(revisit, F.col("first")).alias("refers_to"), "payload_bytes", "payload_digest",
                       F.when(~revisit, F.col("payload")).alias("payload"))


def write_warc(records: DataFrame, path: str) -> None:
    register(records.sparkSession)
    records.write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' records, read the archives back: one row per page.  A
    response's length and digest are computed from the payload that was read."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_warc(as_records(pages), path)
    back = read_warc(spark, path, ["record_type", "page_id", "url", "refers_to", "payload_bytes", "payload_digest", "payload"])
    is_response = F.col("record_type") == "response"
    return back.select(
        "page_id", F.when(is_response, F.octet_length("payload")).otherwise(F.col("payload_bytes")).cast("long").alias("payload_bytes"),
        F.when(is_response, F.sha2("payload", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", "refers_to", "url")


ORACLE = """
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM {pages}
), d AS (
  SELECT page_id, url, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest,
         min(page_id) OVER (PARTITION BY payload) AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > first THEN first END AS refers_to, url
FROM d
"""
