"""Seeded generator of flows and sessions records, as a Spark job.

Rows are a function of (seed, second, position) only - every random choice is
a hash of those - so any partitioning, any executor loss and re-run, and any
number of tasks give the same records.  One second of data is ``rate``
session rows plus the flow bursts that follow them.

Distribution (per second): ``rate`` distinct sessions out of
``n_sessions``, evenly spread in the second; ``int(int(rate*flow_ratio) /
mean_burst)`` bursts from the sessions that carry flows (``match_pct`` of
them), each burst a run of flow rows sharing one event time; cells uniform
over ``cells`` towers; optional exponential lateness.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import floor_div
from .schemas import FLOWS_COLUMNS, SESSIONS_COLUMNS

# --- fixed values: burst-length distribution and data-profile defaults ---
# cumulative slot counts (out of 1000) of burst lengths 1, 2, 3, ...
BURST_CUMULATIVE = [385, 594, 689, 763, 807, 845, 867, 888, 903, 917,
                    928, 937, 944, 950, 955, 960, 964, 967, 970, 973,
                    975, 977, 979, 981, 982, 984, 985, 986, 987, 988,
                    989, 990, 991, 992, 993, 994, 994, 995, 996, 996,
                    1000]
DEFAULT_START = 1640995200          # 2022-01-01 00:00:00 UTC
DEFAULT_SESSIONS = 30000
DEFAULT_RATE = 250                  # session rows per second
DEFAULT_FLOW_RATIO = 4.5            # flow rows per session row
DEFAULT_MATCH_PCT = 70              # sessions with flows: hash % 101 < 70
DEFAULT_CELLS = 400
CELL_BASE = 10000
FLOW_MAX_OCTETS = 25000
SESSION_MAX_OCTETS = 100000
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
# --- end of fixed values ---


def _effective_breakpoints() -> list[int]:
    """Slot i has burst length 1 + #{breakpoints < i}, walking the breakpoints
    in order; the walk stops at the first repeated value (a repeated value
    can never be met again), which caps the length at 37."""
    out = []
    for b in BURST_CUMULATIVE:
        if out and b <= out[-1]:
            break
        out.append(b)
    return out


def burst_lengths() -> list[int]:
    """Burst length of each of the 1000 slots (for tests and the mean)."""
    bps = _effective_breakpoints()
    return [1 + sum(1 for b in bps if b < i) for i in range(1000)]


MEAN_BURST = sum(burst_lengths()) / 1000.0


def _h(seed: int, *parts) -> Column:
    """Non-negative 63-bit hash of the seed and row coordinates."""
    return F.abs(F.xxhash64(F.lit(seed), *parts)) % F.lit(2**62)


def _uniform(seed: int, *parts) -> Column:
    """Uniform in (0, 1]."""
    return (F.pmod(_h(seed, *parts), F.lit(1_000_000)) + 1) / F.lit(1_000_000.0)


def _randint(seed: int, hi: int, *parts) -> Column:
    """Uniform integer in [0, hi]."""
    return F.pmod(_h(seed, *parts), F.lit(hi + 1))


def _tonnage(seed: int, max_octets: int, *parts) -> dict[str, Column]:
    d = _randint(seed, max_octets, *parts, F.lit("d"))
    u = _randint(seed, max_octets, *parts, F.lit("u"))
    p = F.pmod(d, F.lit(10)) / 20.0
    p = F.when(p < 0.25, F.lit(0.0)).otherwise(p)
    up_p, down_p = floor_div(d, 100), floor_div(u, 100)
    vals = {
        "uplinkoctets": d, "uplinkpackets": up_p,
        "downlinkoctets": u, "downlinkpackets": down_p,
        "uplinkdropoctets": F.floor(d * p), "uplinkdroppackets": F.floor(up_p * p),
        "downlinkdropoctets": F.floor(u * p), "downlinkdroppackets": F.floor(down_p * p),
    }
    return {k: v.cast("bigint").cast("string") for k, v in vals.items()}


def _filler(seed: int, width: int, *parts) -> Column:
    """A slice of the doubled alphabet, half the declared width long."""
    n = max(1, width // 2)
    start = F.pmod(_h(seed, *parts, F.lit(width)), F.lit(len(LETTERS))) + 1
    return F.substr(F.lit(LETTERS * 2), start.cast("int"), F.lit(n))


def _time_text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss.SSS")


def _late(us: Column, seed: int, lateness_secs: float, *parts) -> Column:
    """Subtract an exponential lateness (mean lateness/6 s), truncated to ms."""
    if not lateness_secs:
        return us
    adj = -F.log(_uniform(seed, *parts, F.lit("late"))) * (lateness_secs / 6.0) * 1e6
    return floor_div(us - adj.cast("bigint"), 1000) * 1000


def _seconds(spark: SparkSession, seconds: int, per_second: int, partitions: int | None
             ) -> DataFrame:
    n = seconds * per_second
    df = spark.range(0, n, 1, partitions) if partitions else spark.range(0, n)
    return df.select(floor_div(F.col("id"), per_second).alias("sec"),
                     F.pmod(F.col("id"), F.lit(per_second)).alias("j"))


def _stride(n: int) -> int:
    """A multiplier coprime to n, so j -> (a*j + b) mod n is a permutation."""
    a = 7919
    while math.gcd(a, n) != 1:
        a += 2
    return a


def gen_sessions(spark: SparkSession, seconds: int, *, start: int = DEFAULT_START,
                 rate: int = DEFAULT_RATE, n_sessions: int = DEFAULT_SESSIONS,
                 cells: int = DEFAULT_CELLS, lateness_secs: float = 0, seed: int = 42,
                 partitions: int | None = None) -> DataFrame:
    """102-column session records for ``seconds`` seconds from ``start``."""
    if rate > n_sessions:
        raise ValueError("rate exceeds the number of sessions")
    a = _stride(n_sessions)
    base = _seconds(spark, seconds, rate, partitions)
    idx = F.pmod(F.col("j") * a + _h(seed, F.col("sec"), F.lit("s")), F.lit(n_sessions))
    t_us = (F.lit(start) + F.col("sec")) * 1_000_000 + floor_div(F.col("j") * 1_000_000, rate)
    t_us = _late(t_us, seed, lateness_secs, F.col("sec"), F.col("j"))
    x = base.select("sec", "j", idx.alias("_idx"), t_us.alias("_us"))
    et = _time_text(F.col("_us"))
    special = {
        "load_ts": F.substring(et, 1, 19),
        "sessionid": F.lpad(F.col("_idx").cast("string"), 8, "0"),
        "eventtime": et,
        "ecgieci": (F.lit(CELL_BASE) + _randint(seed, cells - 1, F.col("sec"), F.col("j"),
                                                F.lit("c"))).cast("string"),
    }
    special.update(_tonnage(seed, SESSION_MAX_OCTETS, F.col("sec"), F.col("j"), F.lit("t")))
    return x.select(*[special.get(name, _filler(seed, w, F.col("sec"), F.col("j"))).alias(name)
                      for name, w in SESSIONS_COLUMNS])


def flow_sessions(spark: SparkSession, n_sessions: int = DEFAULT_SESSIONS,
                  match_pct: int = DEFAULT_MATCH_PCT, seed: int = 42) -> DataFrame:
    """(rank, session index) of the sessions that carry flows.

    One row per session of the fixed population (a parameter, not data), so
    ranking it in one window is bounded work."""
    s = spark.range(n_sessions).filter(_randint(seed, 100, F.col("id"), F.lit("f")) < match_pct)
    return s.select((F.row_number().over(Window.orderBy("id")) - 1).alias("rank"),
                    F.col("id").alias("_idx"))


def gen_flows(spark: SparkSession, seconds: int, *, start: int = DEFAULT_START,
              rate: int = DEFAULT_RATE, flow_ratio: float = DEFAULT_FLOW_RATIO,
              n_sessions: int = DEFAULT_SESSIONS, match_pct: int = DEFAULT_MATCH_PCT,
              lateness_secs: float = 0, seed: int = 42, partitions: int | None = None,
              broadcast_limit: int = 2_000_000) -> DataFrame:
    """72-column flow records: per second, bursts from distinct flow-carrying
    sessions, each burst's rows sharing one event time."""
    bursts = int(int(rate * flow_ratio) / MEAN_BURST)
    fs = flow_sessions(spark, n_sessions, match_pct, seed)
    m = fs.count()
    if bursts > m:
        raise ValueError("more bursts per second than flow-carrying sessions")
    # the session table's size is the population parameter: broadcast only
    # under a fixed bound, else shuffle-join
    fs = F.broadcast(fs) if n_sessions <= broadcast_limit else fs
    a = _stride(m)
    base = _seconds(spark, seconds, bursts, partitions)
    rank = F.pmod(F.col("j") * a + _h(seed, F.col("sec"), F.lit("b")), F.lit(m))
    t_us = (F.lit(start) + F.col("sec")) * 1_000_000 + floor_div(F.col("j") * 1_000_000, bursts)
    t_us = _late(t_us, seed, lateness_secs, F.col("sec"), F.col("j"))
    slot = _randint(seed, 999, F.col("sec"), F.col("j"), F.lit("n"))
    bps = F.array(*[F.lit(b) for b in _effective_breakpoints()])
    length = F.lit(1) + F.size(F.filter(bps, lambda b: b < slot))
    x = base.select("sec", "j", rank.alias("rank"), t_us.alias("_us"), length.alias("_len"))
    x = x.join(fs, "rank").withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_len"))))
    special = {
        "eventtime": _time_text(F.col("_us")),
        "load_ts": _time_text(F.col("_us")),
        "sessionid": F.lpad(F.col("_idx").cast("string"), 8, "0"),
    }
    special.update(_tonnage(seed, FLOW_MAX_OCTETS, F.col("sec"), F.col("j"), F.col("_k"),
                            F.lit("t")))
    return x.select(*[special.get(name, _filler(seed, w, F.col("sec"), F.col("j"))).alias(name)
                      for name, w in FLOWS_COLUMNS])
