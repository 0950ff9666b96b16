"""RANGE-frame aggregates over event time: the one engine behind every sliding
window view.

A frame is ``[t - preceding, t - lag]`` over the order key ``t`` (peers of the
current row included when ``lag == 0``), per partition key.  Three plans give
identical results and differ in how they scale:

``window``
    Spark's own ``OVER (PARTITION BY keys ORDER BY t RANGE ...)``.  One
    shuffle on the keys; one task holds every row of a key, so a hot key is one
    hot task.

``chunked`` (default for row frames)
    Time-chunked look-back: the partition is ``(keys, chunk)`` where
    ``chunk = floor(t / C)``, and each row is also copied into the following
    chunks whose frames can reach it (rows in the last ``preceding`` of a
    chunk).  Frames are exact; a hot key is split across ``span / C`` tasks and
    the copy overhead is ``preceding / C``.

``two_level`` (dense frames: many rows per frame, e.g. per cell)
    Spark's sliding frame re-aggregates its whole buffer each time the frame
    moves, O(rows x frame rows).  Here time is cut into buckets of w/60 and
    each frame is the union of three disjoint parts: the rows of its own
    bucket up to t (a running aggregate), the whole buckets in between (a
    frame over bucket rows, at most 59 of them), and the rows of the bucket
    w back from t at or after t - w (a running aggregate in descending time
    over narrow copies of those rows moved forward by w into the row's own
    bucket).  Both running aggregates come from one window pass over
    partitions (keys, bucket), so every row gets its partials in place and
    only the small bucket table is joined in.  Every step is linear or runs
    over buckets; a hot key spreads over its buckets.

``bucketed`` (default for frames over a floored time)
    When the order key is ``date_trunc(unit, t)`` every row of a bucket shares
    one frame: reduce to one partial aggregate per ``(keys, bucket)``, run the
    frame over buckets (at most span/unit rows per key, whatever the key's
    volume), and join the frame results back to the rows on ``(keys, bucket)``.
    Without keys the bucket frame is computed by fanning each bucket out to the
    buckets whose frames contain it, so nothing runs in one task.

The bucketed and two-level plans read their input twice (the bucket table
and the rows).  With ``once`` (for an input that is itself a join) the input is
shuffled on (keys, bucket) first, and both parts read that one exchange.  It is
reused only while both parts need the same columns, so ``once`` keeps the keys,
the order column and the aggregated columns alone, and no filter of one part may
reach below the exchange.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scalars import floor_div

MICROS = {"second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000,
          "day": 86_400_000_000}

_FUNCS = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count, "avg": F.avg,
          "stddev_pop": F.stddev_pop}


def micros(d) -> int:
    """Microseconds of a timedelta, an int (already micros) or text like '60 minutes'."""
    if isinstance(d, timedelta):
        return int(d / timedelta(microseconds=1))
    if isinstance(d, int):
        return d
    n, unit = str(d).split()
    return int(float(n) * MICROS[unit.rstrip("s").lower()])


def _agg(kind: str, col: str) -> Column:
    if kind == "count" and col == "*":
        return F.count(F.lit(1))
    return _FUNCS[kind](F.col(col))


def _window_aggs(df: DataFrame, w, aggs: dict) -> list[Column]:
    return [_agg(kind, col).over(w).alias(alias) for alias, (kind, col) in aggs.items()]


def range_frame(df: DataFrame, keys: list[str], order: str, aggs: dict, preceding,
                lag=0, *, floor: str | None = None, strategy: str | None = None,
                chunk=None, once: bool = False) -> DataFrame:
    """Append frame aggregates to every row of ``df``.

    ``aggs`` maps output name -> ``(kind, column)`` with kind in min, max, sum,
    count (``column='*'`` for COUNT(*)), avg, stddev_pop.  ``preceding`` and
    ``lag`` bound the frame (timedelta, micros, or text).  ``floor`` orders by
    ``date_trunc(floor, order)`` instead of ``order``.  ``once`` evaluates an
    expensive input once; the result then has only the columns of the frame.
    """
    p, g = micros(preceding), micros(lag)
    if once:
        need = {*keys, order, *[c for _, c in aggs.values() if c != "*"]}
        df = df.select(*[c for c in df.columns if c in need])
    if g > p:
        raise ValueError("lag must not exceed preceding")
    if strategy is None:
        strategy = "bucketed" if floor else "chunked"
    if strategy == "bucketed":
        if not floor:
            raise ValueError("the bucketed plan needs a floored order key")
        return _bucketed(df, keys, order, aggs, p, g, floor, once)
    okey = F.unix_micros(F.date_trunc(floor, order) if floor else F.col(order))
    if strategy == "window":
        w = Window.partitionBy(*keys).orderBy(okey).rangeBetween(-p, -g) if keys \
            else Window.orderBy(okey).rangeBetween(-p, -g)
        return df.select("*", *_window_aggs(df, w, aggs))
    if strategy == "chunked":
        return _chunked(df, keys, okey, aggs, p, g, chunk)
    if strategy == "two_level":
        if floor or g or p < 60 or p % 60:
            raise ValueError("two_level needs a row frame [t - w, t] with w divisible by 60")
        return _two_level(df, keys, order, aggs, p, p // 60, once)
    raise ValueError(f"unknown strategy {strategy!r}")


def default_chunk(preceding_us: int) -> int:
    """Chunk width: four frame widths, at least one hour (copy overhead <= 25%)."""
    return max(4 * preceding_us, MICROS["hour"])


def lookback_chunks(df: DataFrame, okey: Column, lookback_us, chunk_us: int,
                    chunk_col: str = "_chunk", own_col: str = "_own") -> DataFrame:
    """Copy each row into its own time chunk and every later chunk whose rows can
    look back to it within ``lookback_us``; ``own_col`` marks the original."""
    reach = F.lit(lookback_us) if isinstance(lookback_us, int) else lookback_us
    first = floor_div(okey, chunk_us)
    last = floor_div(okey + reach, chunk_us)
    # explode_outer and a null-safe test keep rows whose time is NULL (one
    # NULL chunk, as a window keeps them as one peer group)
    return (df.withColumn("_first", first)
              .withColumn(chunk_col, F.explode_outer(F.sequence(F.col("_first"), last)))
              .withColumn(own_col, F.col(chunk_col).eqNullSafe(F.col("_first")))
              .drop("_first"))


def _chunked(df, keys, okey, aggs, p, g, chunk):
    c = micros(chunk) if chunk else default_chunk(p)
    cols = df.columns
    x = lookback_chunks(df.withColumn("_okey", okey), F.col("_okey"), p, c)
    w = Window.partitionBy(*keys, "_chunk").orderBy("_okey").rangeBetween(-p, -g)
    out = x.select(*cols, "_own", *_window_aggs(x, w, aggs))
    return out.filter("_own").drop("_own")


def _null_safe_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which NULL keys match, as they share a window partition."""
    right = right.withColumnsRenamed({c: f"_on_{c}" for c in on})
    cond = None
    for c in on:
        e = F.col(c).eqNullSafe(F.col(f"_on_{c}"))
        cond = e if cond is None else cond & e
    return left.join(right, cond, "left").drop(*[f"_on_{c}" for c in on])


# -- bucketed plan ---------------------------------------------------------

def _partials(aggs: dict) -> tuple[list[Column], dict]:
    """Per-bucket partial aggregates, and how to merge each output from them."""
    parts, merge = [], {}
    for alias, (kind, col) in aggs.items():
        if kind in ("min", "max", "sum"):
            parts.append(_agg(kind, col).alias(f"_p_{alias}"))
            merge[alias] = (kind, [f"_p_{alias}"])
        elif kind == "count":
            parts.append(_agg("count", col).alias(f"_p_{alias}"))
            merge[alias] = ("count", [f"_p_{alias}"])
        elif kind == "avg":
            parts.append(F.sum(col).alias(f"_ps_{alias}"))
            parts.append(F.count(col).alias(f"_pn_{alias}"))
            merge[alias] = ("avg", [f"_ps_{alias}", f"_pn_{alias}"])
        else:
            raise ValueError(f"{kind} has no exact bucket merge")
    return parts, merge


def _merged(merge: dict, over=None) -> list[Column]:
    def ap(c):
        return c.over(over) if over is not None else c
    out = []
    for alias, (kind, cols) in merge.items():
        if kind in ("min", "max"):
            e = ap(_FUNCS[kind](cols[0]))
        elif kind == "sum":
            e = ap(F.sum(cols[0]))
        elif kind == "count":
            e = F.coalesce(ap(F.sum(cols[0])), F.lit(0)).cast("bigint")
        else:  # avg
            e = ap(F.sum(cols[0])) / ap(F.sum(cols[1]))
        out.append(e.alias(alias))
    return out


def _bucketed(df, keys, order, aggs, p, g, floor, once=False):
    unit = MICROS[floor]
    parts, merge = _partials(aggs)
    bucket = F.date_trunc(floor, order)
    if once:
        df = df.repartition(*keys, bucket)
    rows = df.withColumn("_bucket", bucket)
    per_bucket = rows.groupBy(*keys, "_bucket").agg(*parts)
    if keys:
        w = (Window.partitionBy(*keys).orderBy(F.unix_micros("_bucket"))
             .rangeBetween(-p, -g))
        frames = per_bucket.select(*keys, "_bucket", *_merged(merge, w))
    else:
        # fan each bucket out to the buckets whose frame holds it; never one task
        lo, hi = -(-g // unit), p // unit   # offsets (in buckets) that can see it
        # (rows with a NULL time are one peer group: their bucket sees itself alone)
        reach = F.when(F.col("_bucket").isNull(), F.array(F.lit(lo).cast("bigint"))) \
            .otherwise(F.sequence(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint")))
        x = per_bucket.withColumn("_k", F.explode(reach))
        x = x.withColumn("_target", F.timestamp_micros(F.unix_micros("_bucket")
                                                       + F.col("_k") * unit))
        frames = x.groupBy("_target").agg(*_merged(merge)).withColumnRenamed("_target",
                                                                             "_bucket")
    out = _null_safe_left(rows, frames, [*keys, "_bucket"])
    # a bucket whose frame holds nothing (offset frames) still keeps its rows
    for alias, (kind, _) in merge.items():
        if kind == "count":
            out = out.withColumn(alias, F.coalesce(F.col(alias), F.lit(0)).cast("bigint"))
    return out.drop("_bucket")


# -- two-level plan -----------------------------------------------------------

def _nsum(*cols: Column) -> Column:
    """Sum ignoring NULLs; NULL only when every part is NULL (SQL SUM)."""
    all_null = None
    total = None
    for c in cols:
        all_null = c.isNull() if all_null is None else all_null & c.isNull()
        z = F.coalesce(c, F.lit(0))
        total = z if total is None else total + z
    return F.when(all_null, F.lit(None)).otherwise(total)


def _combine_parts(kind: str, cols: list[Column]) -> Column:
    if kind == "min":
        return F.least(*cols)
    if kind == "max":
        return F.greatest(*cols)
    if kind == "sum":
        return _nsum(*cols)
    return sum((F.coalesce(c, F.lit(0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0)))


def _row_values(aggs: dict) -> tuple[dict, dict]:
    """Per partial: how it is added up, and what a single row adds to it."""
    kind_of, value = {}, {}
    for alias, (kind, col) in aggs.items():
        seen = F.lit(1) if col == "*" else F.when(F.col(col).isNotNull(), F.lit(1)).otherwise(F.lit(0))
        if kind == "avg":
            kind_of[f"_ps_{alias}"], value[f"_ps_{alias}"] = "sum", F.col(col)
            kind_of[f"_pn_{alias}"], value[f"_pn_{alias}"] = "count", seen
        else:
            kind_of[f"_p_{alias}"] = kind
            value[f"_p_{alias}"] = seen if kind == "count" else F.col(col)
    return kind_of, value


def bucket_partials(rows: DataFrame, keys: list[str], order: str, aggs: dict, bucket: int) -> DataFrame:
    """One row per key and bucket of time: the partials that frames are merged from."""
    return rows.groupBy(*keys, floor_div(F.unix_micros(F.col(order)), bucket).alias("_b")).agg(*_partials(aggs)[0])


def _two_level(df, keys, order, aggs, p, bucket, once=False):
    if once:
        df = df.repartition(*keys, floor_div(F.unix_micros(F.col(order)), bucket))
    kind_of, value = _row_values(aggs)
    k = p // bucket
    cols = df.columns
    rows = (df.withColumn("_t", F.unix_micros(F.col(order)))
              .withColumn("_b", floor_div(F.col("_t"), bucket)))
    # every row once as itself (kind 0, all columns) and once as a narrow "far"
    # copy moved one frame width forward (kind 2: time + w, bucket + k).  In
    # partition (keys, bucket) a row then finds, in one pass and with its
    # peers, the rows of its bucket up to it (ascending RANGE aggregate of kind
    # 0 values) and the far copies at or after it - the rows of bucket b - k at
    # or after t - w (descending RANGE aggregate of kind 2 values).
    x = rows.withColumn("_kind", F.explode(F.array(F.lit(0), F.lit(2))))
    # rows with a NULL time are one peer group of their own: no far copies
    x = x.filter((F.col("_kind") == 0) | F.col("_t").isNotNull())
    far = F.col("_kind") == 2
    x = x.select(*[F.when(~far, F.col(c)).alias(c) for c in cols if c not in keys], *keys,
                 "_kind",
                 F.when(far, F.col("_t") + F.lit(p)).otherwise(F.col("_t")).alias("_tt"),
                 F.when(far, F.col("_b") + F.lit(k)).otherwise(F.col("_b")).alias("_b"),
                 *[F.when(~far, e).alias(f"_u_{c}") for c, e in value.items()],
                 *[F.when(far, e).alias(f"_f_{c}") for c, e in value.items()])
    panes = rows.groupBy(*keys, "_b").agg(*_partials(aggs)[0]) if k > 1 else None
    return _two_level_merge(x, panes, cols, keys, aggs, kind_of, k)


def two_level_over(near: DataFrame, far: DataFrame, panes: DataFrame, keys: list[str], order: str,
                   aggs: dict, preceding, bucket: int) -> DataFrame:
    """The two-level plan over parts that are kept apart (a stream's carried tables):
    ``near`` holds the rows to aggregate for and all rows before them in their
    buckets, ``far`` the rows of the buckets one frame width before those, ``panes``
    the :func:`bucket_partials` of the buckets of both and of those in between."""
    p = micros(preceding)
    kind_of, value = _row_values(aggs)
    cols = near.columns
    t = F.unix_micros(F.col(order))
    types = dict(near.select(*[e.alias(c) for c, e in value.items()]).dtypes)
    own = near.select(*cols, F.lit(0).alias("_kind"), t.alias("_tt"), floor_div(t, bucket).alias("_b"),
                      *[e.alias(f"_u_{c}") for c, e in value.items()],
                      *[F.lit(None).cast(types[c]).alias(f"_f_{c}") for c in value])
    moved = far.select(*[F.col(c) if c in keys else F.lit(None).cast(near.schema[c].dataType).alias(c) for c in cols],
                       F.lit(2).alias("_kind"), (t + F.lit(p)).alias("_tt"),
                       (floor_div(t, bucket) + F.lit(p // bucket)).alias("_b"),
                       *[F.lit(None).cast(types[c]).alias(f"_u_{c}") for c in value],
                       *[e.alias(f"_f_{c}") for c, e in value.items()])
    return _two_level_merge(own.unionByName(moved), panes, cols, keys, aggs, kind_of, p // bucket)


def _two_level_merge(x, panes, cols, keys, aggs, kind_of, k):
    """Frames of the rows of kind 0 of ``x`` from their own bucket, the far copies in
    it, and the buckets between.  Those are a window over ``panes``, which has a row
    for each bucket of kind 0; its result goes into the bucket as a row of kind 1
    before all others, so that no join is needed."""
    _, merge = _partials(aggs)
    pnames = list(kind_of)
    run = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.sum}
    mids = []
    if k > 1:
        w = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-(k - 1), -1)
        mid = panes.select(*keys, "_b", *[run[kind_of[c]](c).over(w).alias(f"_mid_{c}") for c in pnames])
        # rows with a NULL time have no whole buckets
        mid = mid.filter(F.col("_b").isNotNull())
        mids = [f"_mid_{c}" for c in pnames]
        types = x.select(*cols, *[f"_u_{c}" for c in pnames], *[f"_f_{c}" for c in pnames]).schema
        x = x.select("*", *[F.lit(None).cast(mid.schema[m].dataType).alias(m) for m in mids]).unionByName(mid.select(
            *[F.col(f.name) if f.name in keys else F.lit(None).cast(f.dataType).alias(f.name) for f in types],
            *[c for c in keys if c not in cols], "_b", F.lit(1).alias("_kind"),
            F.lit(-(1 << 63)).cast("long").alias("_tt"), *mids))
    fwd = Window.partitionBy(*keys, "_b").orderBy("_tt").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    bwd = Window.partitionBy(*keys, "_b").orderBy(F.col("_tt").desc()).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    u = x.select(*cols, *[c for c in keys if c not in cols], "_b", "_kind",
                 *[F.max(m).over(fwd).alias(m) for m in mids],
                 *[run[kind_of[c]](f"_u_{c}").over(fwd).alias(f"_up_{c}") for c in pnames],
                 *[run[kind_of[c]](f"_f_{c}").over(bwd).alias(f"_lo_{c}") for c in pnames])
    res = u.filter(F.col("_kind") == 0).drop("_kind")
    if not mids:
        for c in pnames:
            res = res.withColumn(f"_mid_{c}", F.lit(None).cast("bigint"))
    combined = {c: _combine_parts(kind_of[c], [F.col(f"_up_{c}"), F.col(f"_mid_{c}"),
                                              F.col(f"_lo_{c}")]) for c in pnames}
    outs = []
    for alias, (kind, cols_) in merge.items():
        if kind == "avg":
            e = combined[cols_[0]] / combined[cols_[1]]
        elif kind == "count":
            e = combined[cols_[0]].cast("bigint")
        else:
            e = combined[cols_[0]]
        outs.append(e.alias(alias))
    return res.select(*cols, *outs)


def bucketed_over(rows: DataFrame, panes: DataFrame, keys: list[str], order: str, aggs: dict,
                  preceding, lag, bucket: int) -> DataFrame:
    """Frames over a floored time from carried partials: each row takes the buckets
    from ``preceding`` to ``lag`` before its own out of ``panes``."""
    _, merge = _partials(aggs)
    own = rows.withColumn("_b", floor_div(F.unix_micros(F.col(order)), bucket))
    parts = [c for c in panes.columns if c not in (*keys, "_b")]
    empty = [F.lit(None).cast(panes.schema[c].dataType).alias(c) for c in parts]
    wanted = own.select(*keys, "_b").distinct().select(*keys, "_b", *empty, F.lit(True).alias("_own"))
    x = panes.select(*keys, "_b", *parts, F.lit(False).alias("_own")).unionByName(wanted)
    w = Window.partitionBy(*keys).orderBy("_b").rangeBetween(-(micros(preceding) // bucket), -(micros(lag) // bucket))
    frames = x.select(*keys, "_b", "_own", *_merged(merge, w)).filter("_own").drop("_own")
    return _null_safe_left(own, frames, [*keys, "_b"]).drop("_b")
