"""Scalar column functions used by the views (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalise_eventtime_text(c) -> Column:
    """A 22-character time stamp (two fraction digits) loses its fraction and
    gets ``.000``; every other length is kept as it is."""
    c = _c(c)
    return F.when(F.char_length(c) == 22, F.concat(F.substring(c, 1, 19), F.lit(".000"))).otherwise(c)


def to_timestamp_text(c, strict: bool = True) -> Column:
    """``CAST(text AS TIMESTAMP)``; ``strict=False`` yields NULL for bad text."""
    c = _c(c)
    return c.cast("timestamp") if strict else F.try_to_timestamp(c)


def normalise_eventtime(c, strict: bool = True, floor: str | None = None) -> Column:
    """Text event time -> TIMESTAMP after the 22-character rule; ``floor='minute'``
    gives the minute-truncated variant."""
    ts = to_timestamp_text(normalise_eventtime_text(c), strict)
    return F.date_trunc(floor, ts) if floor else ts


def to_bigint(c, strict: bool = True) -> Column:
    """``CAST(text AS BIGINT)``: strict raises on bad text (ANSI), else NULL."""
    c = _c(c)
    return c.cast("bigint") if strict else c.try_cast("bigint")


def sum_all(cols) -> Column:
    """a + b + ...: NULL if any input is NULL, like SQL ``+``."""
    out = None
    for c in cols:
        out = _c(c) if out is None else out + _c(c)
    return out


def time_micros(c) -> Column:
    """Event time as microseconds since the epoch (a LONG usable as RANGE order key)."""
    return F.unix_micros(_c(c))


def floor_time(c, unit: str = "minute") -> Column:
    return F.date_trunc(unit, _c(c))


def time_of_day(c) -> Column:
    """``CAST(ts AS TIME(3))`` as text ``HH:mm:ss.SSS``."""
    return F.date_format(_c(c), "HH:mm:ss.SSS")


def shard_of(c, num_shards: int) -> Column:
    """Shard number of a key: a non-negative modulus so negative ids land in a shard."""
    return F.pmod(_c(c), F.lit(num_shards))


def elapsed_seconds_ms(later, earlier) -> Column:
    """``CAST((unix_millis(a) - unix_millis(b)) / 1000 AS INT)``."""
    return ((F.unix_millis(_c(later)) - F.unix_millis(_c(earlier))) / 1000).cast("int")


def elapsed_seconds(later, earlier, allowance: int = 0) -> Column:
    """``TIMESTAMPDIFF(SECOND, earlier, later) - allowance``."""
    return ((F.unix_micros(_c(later)) - F.unix_micros(_c(earlier))) / MICROS_PER_SECOND
            ).cast("bigint") - F.lit(allowance)


def floor_div(c, n: int) -> Column:
    """Floor division of a LONG by a positive constant, exact (no DOUBLE) and
    correct for negative values (times before 1970): the argument is shifted
    by a large multiple of ``n`` so SQL ``div`` (which truncates) sees a
    positive number.  The argument is referenced once, so nested uses stay
    small in generated code."""
    k = (2 ** 62 // n) * n
    return F.call_function("div", _c(c) + F.lit(k), F.lit(n)) - F.lit(k // n)


def to_ntz(c) -> Column:
    return _c(c).cast("timestamp_ntz")
