"""Independent DuckDB formulations of every registered query.

These restate each view in plain SQL over the ``events`` view (with the same
events -> flows/sessions mapping), using window functions and joins the
direct way: RANGE frames on TIMESTAMP, the interval joins as BETWEEN joins,
the latest-row join as a ranked BETWEEN join.  The Spark plans share none of
that shape, so agreement is a real check.
"""

from __future__ import annotations

from ..operators.meters import STARTUP_ALLOWANCE_SECONDS
from ..operators.windows import AGG_VIEW_WIDTHS
from ..sources.schemas import FLOWS_COLUMNS
from ..sources.tables import (ARRIVAL_MULTIPLIER, ARRIVAL_SPREAD_SECONDS, BASE_MICROS,
                              CELL_BASE, CELL_COUNT, FLOW_TYPES, SESSION_TYPES,
                              TIME_COMPRESSION)


def _in(types) -> str:
    return "(" + ", ".join(f"'{t}'" for t in types) + ")"


BASE = f"""
ev AS (
  SELECT event_id, user_id, event_type, value,
         CAST(round(value * 100) AS BIGINT) AS o,
         ((({BASE_MICROS} + (epoch_us(ts) - {BASE_MICROS}) // {TIME_COMPRESSION})
           // 1000000) * 1000000) AS ct_us
  FROM events),
ev2 AS (
  SELECT *, ct_us + ((event_id * {ARRIVAL_MULTIPLIER}) % {ARRIVAL_SPREAD_SECONDS}) * 1000000
             AS arrival_us,
         strftime(make_timestamp(ct_us), '%Y-%m-%d %H:%M:%S') AS ts_text,
         lpad(CAST(user_id AS VARCHAR), 8, '0') AS sid,
         o // 3 AS up_o, o // 10 AS updrop_o, o // 20 AS downdrop_o,
         o - o // 3 - o // 10 - o // 20 AS down_o
  FROM ev),
flows AS (
  SELECT sid AS sessionid, make_timestamp(ct_us) AS eventtime, o AS octets,
         up_o // 100 + down_o // 100 + updrop_o // 100 + downdrop_o // 100 AS packets,
         make_timestamp(arrival_us) AS arrival, event_id AS flowid, user_id, ts_text, event_id,
         up_o, down_o, updrop_o, downdrop_o
  FROM ev2 WHERE event_type IN {_in(FLOW_TYPES)}),
sessions AS (
  SELECT sid AS sessionid, make_timestamp(ct_us) AS eventtime,
         CAST({CELL_BASE} + event_id % {CELL_COUNT} AS VARCHAR) AS cellid, user_id, ts_text,
         event_id
  FROM ev2 WHERE event_type IN {_in(SESSION_TYPES)}),
jf AS (
  SELECT f.sessionid, f.eventtime, s.cellid, f.octets, f.packets
  FROM flows f JOIN sessions s ON f.sessionid = s.sessionid
   AND f.eventtime BETWEEN s.eventtime - INTERVAL 5 MINUTE AND s.eventtime),
jb AS (
  SELECT f.sessionid, f.eventtime, s.cellid, f.octets, f.packets
  FROM flows f JOIN sessions s ON f.sessionid = s.sessionid
   AND s.eventtime BETWEEN f.eventtime - INTERVAL 5 MINUTE AND f.eventtime),
fi AS (
  SELECT make_timestamp(ct_us) AS rowtime,
         CASE WHEN event_id % 10 = 7 THEN ts_text ELSE ts_text || '.000' END AS eventtime,
         CAST(user_id AS INTEGER) AS sessionid, o AS octets,
         up_o // 100 + down_o // 100 + updrop_o // 100 + downdrop_o // 100 AS packets
  FROM ev2 WHERE event_type IN {_in(FLOW_TYPES)}),
si AS (
  SELECT make_timestamp(ct_us) AS rowtime, CAST(user_id AS INTEGER) AS sessionid,
         CASE WHEN event_id % 10 = 7 THEN ts_text ELSE ts_text || '.000' END AS eventtime,
         CAST({CELL_BASE} + event_id % {CELL_COUNT} AS VARCHAR) AS cellid
  FROM ev2 WHERE event_type IN {_in(SESSION_TYPES)}),
tw AS (
  SELECT make_timestamp(ct_us) AS event_time, substr(event_type, 1, 4) AS c1 FROM ev)
"""


def _with(body: str) -> str:
    return "WITH " + BASE.strip() + "\n" + body.strip()


STATS = """min(octets) OVER w AS minOctets, max(octets) OVER w AS maxOctets,
       CAST(sum(octets) OVER w AS BIGINT) AS sumOctets, count(octets) OVER w AS countOctets"""


def _frame(minutes: int) -> str:
    return f"RANGE BETWEEN INTERVAL {minutes} MINUTE PRECEDING AND CURRENT ROW"


OFFSET = "RANGE BETWEEN INTERVAL 60 MINUTE PRECEDING AND INTERVAL 1 MINUTE PRECEDING"


def _flow_text_columns() -> str:
    special = {
        "load_ts": "strftime(make_timestamp(arrival_us), '%Y-%m-%d %H:%M:%S') || '.000'",
        "eventtime": ("CASE event_id % 10 WHEN 3 THEN ts_text || '.00' WHEN 7 THEN ts_text "
                      "ELSE ts_text || '.000' END"),
        "sessionid": "sid",
        "flowid": "CAST(event_id AS VARCHAR)",
        "uplinkoctets": "CAST(up_o AS VARCHAR)",
        "downlinkoctets": "CAST(down_o AS VARCHAR)",
        "uplinkdropoctets": "CAST(updrop_o AS VARCHAR)",
        "downlinkdropoctets": "CAST(downdrop_o AS VARCHAR)",
        "uplinkpackets": "CAST(up_o // 100 AS VARCHAR)",
        "downlinkpackets": "CAST(down_o // 100 AS VARCHAR)",
        "uplinkdroppackets": "CAST(updrop_o // 100 AS VARCHAR)",
        "downlinkdroppackets": "CAST(downdrop_o // 100 AS VARCHAR)",
    }
    cols = []
    for name, width in FLOWS_COLUMNS:
        expr = special.get(name)
        if expr is None:
            expr = "'" + ("abcdefghijklmnopqrstuvwxyz" * 2)[:max(1, width // 2)] + "'"
        cols.append(f"{expr} AS {name}")
    return ",\n       ".join(cols)


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["parse_view"] = _with(f"""
SELECT {_flow_text_columns()}
FROM ev2 WHERE event_type IN {_in(FLOW_TYPES)}""")
    q["flows_step_1"] = _with("""
SELECT sessionid, CASE WHEN event_id % 10 = 7 THEN ts_text ELSE ts_text || '.000' END AS eventtime,
       up_o AS uplinkoctets, up_o // 100 AS uplinkpackets,
       down_o AS downlinkoctets, down_o // 100 AS downlinkpackets,
       updrop_o AS uplinkdropoctets, updrop_o // 100 AS uplinkdroppackets,
       downdrop_o AS downlinkdropoctets, downdrop_o // 100 AS downlinkdroppackets
FROM flows""")
    q["projection_view"] = _with("SELECT sessionid, eventtime, octets, packets FROM flows")
    q["flows_minutes"] = _with(
        "SELECT sessionid, date_trunc('minute', eventtime) AS eventtime FROM flows")
    q["merged_pumps"] = _with("""
SELECT * FROM fi WHERE sessionid % 2 = 0 UNION ALL SELECT * FROM fi WHERE sessionid % 2 = 1""")
    q["typed_flows"] = _with("""
SELECT CAST(user_id AS INTEGER) AS sessionid, eventtime, up_o AS uplinkoctets
FROM flows WHERE event_id % 10 <> 7""")
    q["rejected_rows"] = _with("""
SELECT sessionid || ',' || ts_text || ',' || up_o AS line
FROM flows WHERE event_id % 10 = 7""")
    bad = "(SELECT sessionid || ',' || ts_text || ',' || up_o AS line FROM flows WHERE event_id % 10 = 7)"
    q["rejected_trace"] = _with(f"""
SELECT 'eventtime' AS kind, rows, place, line, times FROM (
  SELECT line, count(*) AS times, row_number() OVER (ORDER BY md5(line), line)::INTEGER AS place
  FROM {bad} GROUP BY line), (SELECT count(*) AS rows FROM {bad})
WHERE place <= 5""")
    q["sessions_step_2"] = _with("SELECT sessionid, eventtime, cellid FROM sessions")
    q["flows_ingestion"] = _with("SELECT rowtime, eventtime, sessionid, octets, packets FROM fi")
    q["sessions_ingestion"] = _with("SELECT rowtime, sessionid, eventtime, cellid FROM si")
    q["testwindow_v1"] = _with(
        "SELECT event_time, date_trunc('minute', event_time) AS event_time_mins, c1 FROM tw")

    for name, minutes in AGG_VIEW_WIDTHS.items():
        q[name] = _with(f"""
SELECT sessionid, octets, eventtime,
       {STATS}
FROM flows WINDOW w AS (PARTITION BY sessionid ORDER BY eventtime {_frame(minutes)})""")
    q["bollinger_view"] = _with(f"""
SELECT sessionid, octets, eventtime,
       round(avg(octets) OVER w + 2 * stddev_pop(octets) OVER w, 4) AS upper_bb,
       round(avg(octets) OVER w - 2 * stddev_pop(octets) OVER w, 4) AS lower_bb
FROM flows WINDOW w AS (PARTITION BY sessionid ORDER BY eventtime {_frame(60)})""")
    q["testwindow_v2"] = _with("""
SELECT strftime(event_time, '%H:%M:%S.%g') AS event_time, c1,
       strftime(min(event_time) OVER w, '%H:%M:%S.%g') AS min_et,
       strftime(max(event_time) OVER w, '%H:%M:%S.%g') AS max_et,
       min(c1) OVER w AS min_c1, max(c1) OVER w AS max_c1, count(*) OVER w AS cnt
FROM tw WINDOW w AS (ORDER BY date_trunc('minute', event_time)
                     RANGE BETWEEN INTERVAL 2 MINUTE PRECEDING AND CURRENT ROW)""")
    q["count_total"] = _with(f"""
SELECT count(minOctets) + count(maxOctets) + count(sumOctets) + count(countOctets) AS count_total
FROM (SELECT {STATS}
      FROM flows WINDOW w AS (PARTITION BY sessionid ORDER BY eventtime {_frame(60)}))""")

    q["join_view_forward"] = _with("SELECT * FROM jf")
    q["join_view_backward"] = _with("SELECT * FROM jb")
    q["session_join_view"] = _with("""
SELECT sessionid, eventtime, cellid, octets, packets FROM (
  SELECT f.sessionid, f.eventtime, s.cellid, f.octets, f.packets,
         row_number() OVER (PARTITION BY f.event_id
                            ORDER BY s.eventtime DESC, s.cellid DESC) AS rn
  FROM flows f JOIN sessions s ON f.sessionid = s.sessionid
   AND s.eventtime BETWEEN f.eventtime - INTERVAL 1 HOUR AND f.eventtime)
WHERE rn = 1""")
    for name, src in (("join_n_agg_view_forward", "jf"), ("join_n_agg_view_backward", "jb")):
        q[name] = _with(f"""
SELECT cellid, octets, eventtime,
       {STATS}
FROM {src} WINDOW w AS (PARTITION BY cellid ORDER BY eventtime {_frame(60)})""")
    q["join_n_agg_null_cells"] = _with(f"""
SELECT nullif(cellid, '{CELL_BASE}') AS cellid, octets, eventtime,
       {STATS}
FROM jb WINDOW w AS (PARTITION BY nullif(cellid, '{CELL_BASE}') ORDER BY eventtime {_frame(60)})""")
    q["join_n_agg_view2"] = _with(f"""
SELECT cellid, octets, eventtime,
       {STATS}
FROM jb WINDOW w AS (PARTITION BY cellid ORDER BY date_trunc('minute', eventtime) {OFFSET})""")

    agg1 = f"""agg1 AS (
  SELECT sessionid, rowtime AS eventtime,
         {STATS}, row_number() OVER () AS rid
  FROM fi WINDOW w AS (PARTITION BY sessionid ORDER BY date_trunc('minute', rowtime) {OFFSET}))"""
    q["flows_agg_step_1"] = _with(f""", {agg1}
SELECT sessionid, eventtime, minOctets, maxOctets, sumOctets, countOctets FROM agg1""")
    step2 = _with(f""", {agg1}
SELECT a.sessionid, a.eventtime, s.cellid, a.minOctets, a.maxOctets, a.sumOctets, a.countOctets
FROM agg1 a JOIN si s ON a.sessionid = s.sessionid
 AND s.rowtime BETWEEN a.eventtime - INTERVAL 5 MINUTE AND a.eventtime""")
    q["flows_agg_step_2"] = step2
    q["flows_agg_sharded"] = step2
    q["flows_agg_step_2_session"] = _with(f""", {agg1}
SELECT sessionid, eventtime, cellid, minOctets, maxOctets, sumOctets, countOctets FROM (
  SELECT a.*, s.cellid,
         row_number() OVER (PARTITION BY a.rid ORDER BY s.rowtime DESC, s.cellid DESC) AS rn
  FROM agg1 a JOIN si s ON a.sessionid = s.sessionid
   AND s.rowtime BETWEEN a.eventtime - INTERVAL 1 HOUR AND a.eventtime)
WHERE rn = 1""")

    newest = """lf AS (
  SELECT *, max(eventtime) OVER (ORDER BY arrival, flowid
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest_before
  FROM flows)"""
    q["late_rows"] = _with(f""", {newest}
SELECT sessionid, eventtime, octets, packets, arrival, newest_before FROM lf
WHERE eventtime < newest_before - INTERVAL 30 SECOND""")
    q["t_sort"] = _with(f""", {newest}
SELECT sessionid, eventtime, octets, packets FROM lf
WHERE newest_before IS NULL OR NOT (eventtime < newest_before - INTERVAL 30 SECOND)""")
    per = """per AS (
  SELECT date_trunc('second', arrival) AS rowtime, count(*) AS rps,
         min(eventtime) AS rowtime_low, max(eventtime) AS rowtime_high
  FROM flows GROUP BY 1)"""
    q["data_rate"] = _with(f""", {per}
SELECT rowtime, rps, CAST(sum(rps) OVER (ORDER BY rowtime) AS BIGINT) AS cumulative_rows,
       rowtime_low, rowtime_high,
       CAST((epoch_ms(rowtime) - epoch_ms(min(rowtime) OVER ())) // 1000 AS INTEGER) AS testsecs
FROM per""")
    q["throughput_meter"] = _with(f"""
SELECT clocktime, recs_per_sec, max_event_time,
       (epoch_us(clocktime) - epoch_us(min(start) OVER ())) // 1000000
         - {STARTUP_ALLOWANCE_SECONDS} AS testsecs
FROM (SELECT date_trunc('second', arrival) AS clocktime, count(*) AS recs_per_sec,
             max(eventtime) AS max_event_time, min(arrival) AS start
      FROM flows GROUP BY 1)""")
    q["running_avg_rps"] = _with("""
SELECT second, rps, round(avg(rps) OVER (ORDER BY second), 4) AS avg_rps
FROM (SELECT date_trunc('second', arrival) AS second, count(*) AS rps FROM flows GROUP BY 1)""")
    return q
