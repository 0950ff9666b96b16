"""Driver-provided parquet tables, and the flows/sessions records Spark derives
from them.

The ``events`` table stands in for the two telecom streams: click, purchase
and error events become flow records, signup and view events become session
records.  The table is sparse in time (hours between a user's events), so
time is compressed 60x and truncated to whole seconds, which also makes ties
on event time - the normal case for bursts of flows - occur.

Every derived column is a built-in expression of the event row, so any
partitioning of ``events`` yields the same records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import floor_div
from .csv import parse_lines
from .schemas import FLOWS_COLUMNS, OCTETS, PACKETS, SESSIONS_COLUMNS, flows_schema, sessions_schema

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# --- fixed values of the events -> records mapping ---
BASE_MICROS = 1_704_067_200_000_000      # 2024-01-01 00:00:00 UTC, start of events
TIME_COMPRESSION = 60
FLOW_TYPES = ("click", "purchase", "error")
SESSION_TYPES = ("signup", "view")
CELL_BASE = 10000
CELL_COUNT = 20
ARRIVAL_SPREAD_SECONDS = 50               # arrival delay = (event_id * 7919) % 50 s
ARRIVAL_MULTIPLIER = 7919
# --- end of fixed values ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def compressed_micros(ts: Column) -> Column:
    """Event time compressed 60x around the start of the table, whole seconds."""
    us = F.unix_micros(ts.cast("timestamp"))
    c = F.lit(BASE_MICROS) + floor_div(us - F.lit(BASE_MICROS), TIME_COMPRESSION)
    return floor_div(c, 1_000_000) * 1_000_000


def _eventtime_text(ct_us: Column, event_id: Column) -> Column:
    """Mostly 23-character text with milliseconds; every tenth row written with
    two fraction digits (22 characters) and every tenth without a fraction,
    so the normalisation rule is exercised."""
    base = F.date_format(F.timestamp_micros(ct_us), "yyyy-MM-dd HH:mm:ss")
    d = F.pmod(event_id, F.lit(10))
    return (F.when(d == 3, F.concat(base, F.lit(".00")))
            .when(d == 7, base)
            .otherwise(F.concat(base, F.lit(".000"))))


def _filler(width: int) -> Column:
    return F.lit(_filler_text(width))


def _tonnage(o: Column) -> dict[str, Column]:
    """Split the total octets ``o`` into the four octet columns (their sum is
    the total); packets are octets / 100 per column."""
    parts = {
        "uplinkoctets": floor_div(o, 3),
        "uplinkdropoctets": floor_div(o, 10),
        "downlinkdropoctets": floor_div(o, 20),
    }
    parts["downlinkoctets"] = o - parts["uplinkoctets"] - parts["uplinkdropoctets"] \
        - parts["downlinkdropoctets"]
    out = {}
    for oc, pc in zip(OCTETS, PACKETS):
        out[oc] = parts[oc]
        out[pc] = floor_div(parts[oc], 100)
    return {k: v.cast("string") for k, v in out.items()}


def _base(events: DataFrame, types: tuple) -> DataFrame:
    """The per-event values every record column is built from, computed once
    (a separate projection keeps Catalyst from inlining them into each use)."""
    ev = events.filter(F.col("event_type").isin(*types))
    return ev.select("event_id", "user_id",
                     compressed_micros(F.col("ts")).alias("_ct"),
                     F.round(F.col("value") * 100).cast("bigint").alias("_o"))


def _records(events: DataFrame, types: tuple, columns, special: dict) -> DataFrame:
    ev = _base(events, types)
    cols = []
    for name, width in columns:
        c = special.get(name, _filler(width))
        cols.append(c.alias(name))
    return ev.select(*cols)


def _filler_text(width: int) -> str:
    return ("abcdefghijklmnopqrstuvwxyz" * 2)[:max(1, width // 2)]


def _lines(events: DataFrame, types: tuple, columns, special: dict, sep: str = ","
           ) -> DataFrame:
    """The same records as delimited text, built with runs of constant filler
    columns merged into single literals (a short expression keeps the whole
    stage inside generated code)."""
    ev = _base(events, types)
    parts, run = [], []
    for name, width in columns:
        if name in special:
            if run:
                parts.append(F.lit(sep.join(run)))
                run = []
            parts.append(special[name])
        else:
            run.append(_filler_text(width))
    if run:
        parts.append(F.lit(sep.join(run)))
    return ev.select(F.concat_ws(sep, *parts).alias("value"))


def _common(prefix_load_ts_fmt: str) -> dict[str, Column]:
    ct = F.col("_ct")
    eid = F.col("event_id")
    arrival = ct + F.pmod(eid * ARRIVAL_MULTIPLIER, F.lit(ARRIVAL_SPREAD_SECONDS)) * 1_000_000
    d = {
        "load_ts": F.date_format(F.timestamp_micros(arrival), prefix_load_ts_fmt),
        "eventtime": _eventtime_text(ct, eid),
        "sessionid": F.lpad(F.col("user_id").cast("string"), 8, "0"),
    }
    d.update(_tonnage(F.col("_o")))
    return d


def _flow_special() -> dict[str, Column]:
    special = _common("yyyy-MM-dd HH:mm:ss.SSS")
    special["flowid"] = F.col("event_id").cast("string")
    return special


def _session_special() -> dict[str, Column]:
    special = _common("yyyy-MM-dd HH:mm:ss")
    special["ecgieci"] = (F.lit(CELL_BASE) + F.pmod(F.col("event_id"), F.lit(CELL_COUNT))
                          ).cast("string")
    return special


def flow_records(events: DataFrame) -> DataFrame:
    """72 string columns per flow event, in record order."""
    return _records(events, FLOW_TYPES, FLOWS_COLUMNS, _flow_special())


def session_records(events: DataFrame) -> DataFrame:
    """102 string columns per session event; ``ecgieci`` is the cell."""
    return _records(events, SESSION_TYPES, SESSIONS_COLUMNS, _session_special())


def flow_lines(events: DataFrame, sep: str = ",") -> DataFrame:
    return _lines(events, FLOW_TYPES, FLOWS_COLUMNS, _flow_special(), sep)


def session_lines(events: DataFrame, sep: str = ",") -> DataFrame:
    return _lines(events, SESSION_TYPES, SESSIONS_COLUMNS, _session_special(), sep)


def as_lines(records: DataFrame, sep: str = ",") -> DataFrame:
    """One delimited line per record (what the CSV files hold)."""
    return records.select(F.concat_ws(sep, *[F.coalesce(F.col(c), F.lit(""))
                                             for c in records.columns]).alias("value"))


def flows_from_events(spark: SparkSession, sf_dir: str, parse: bool = True) -> DataFrame:
    """Flows records of the ``events`` table.  With ``parse`` the records go
    through text and the CSV parser, as file input would."""
    ev = table(spark, sf_dir, "events")
    return parse_lines(flow_lines(ev), flows_schema()) if parse else flow_records(ev)


def sessions_from_events(spark: SparkSession, sf_dir: str, parse: bool = True) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return parse_lines(session_lines(ev), sessions_schema()) if parse else session_records(ev)
