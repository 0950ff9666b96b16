"""Running (prefix) aggregates over one global time order, without one task.

A running sum or maximum over a whole stream is a window with no partition,
which Spark runs in a single task.  Here the order is cut into time chunks:
each chunk's total is computed in parallel, the totals of all earlier chunks
are combined over the chunk table (one row per chunk, so its size is bounded
by the time span, not by the data), and each chunk then runs its own window
starting from that carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .frames import MICROS, micros
from .scalars import floor_div

_MERGE = {"sum": F.sum, "count": F.sum, "max": F.max, "min": F.min}
_FIRST = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind in ("sum", "count"):
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    f = F.greatest if kind == "max" else F.least
    return f(a, b)   # greatest/least skip NULLs


def prefix_aggregate(df: DataFrame, order: str, aggs: dict, *, tiebreak: list[str] | None = None,
                     include_current: bool = True, chunk=MICROS["hour"],
                     per_second: bool = False) -> DataFrame:
    """Append running aggregates in ``order`` (a TIMESTAMP column) to every row.

    ``aggs`` maps name -> (kind, column), kind in sum, count, max, min.
    ``include_current=True`` is ``RANGE UNBOUNDED PRECEDING AND CURRENT ROW``
    (peers included); ``False`` is ``ROWS UNBOUNDED PRECEDING AND 1 PRECEDING``
    in ``(order, *tiebreak)`` order - the rows strictly before this one.

    ``per_second`` says that ``df`` has at most one row per second of ``order``
    (a meter's table): a chunk's rows then travel in its row of the chunk table,
    at most 3,600 an hour, and ``df`` is evaluated once.
    """
    c = micros(chunk)
    tiebreak = tiebreak or []
    x = df.withColumn("_ck", floor_div(F.unix_micros(F.col(order)), c))
    held = [F.collect_list(F.struct(*df.columns)).alias("_rows")] if per_second else []
    totals = x.groupBy("_ck").agg(*[_FIRST[k](F.col(col) if col != "*" else F.lit(1))
                                    .alias(f"_t_{n}") for n, (k, col) in aggs.items()], *held)
    before = Window.orderBy("_ck").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("_ck", *(["_rows"] if per_second else []),
                          *[_MERGE[k](f"_t_{n}").over(before).alias(f"_c_{n}")
                            for n, (k, _) in aggs.items()])
    if per_second:
        x = carry.withColumn("_row", F.explode("_rows")).select(
            "_ck", *[f"_c_{n}" for n in aggs], "_row.*")
    else:
        x = x.join(carry, "_ck", "left")
    okey = [F.col(order), *[F.col(t) for t in tiebreak]]
    if include_current:
        w = (Window.partitionBy("_ck").orderBy(F.unix_micros(order))
             .rangeBetween(Window.unboundedPreceding, Window.currentRow))
    else:
        w = Window.partitionBy("_ck").orderBy(*okey).rowsBetween(Window.unboundedPreceding, -1)
    cols = []
    for n, (k, col) in aggs.items():
        inner = _FIRST[k](F.col(col) if col != "*" else F.lit(1)).over(w)
        cols.append(_combine(k, F.col(f"_c_{n}"), inner).alias(n))
    return x.select(*df.columns, *cols)
