"""Order of rows by a score, as Spark jobs: the cutoff of the best rows is bracketed
with a quantile sketch, and rows are numbered without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import staged

#: accuracy of the quantile sketch (its size is bounded by it): ranks are right to 1 in this
ACCURACY = 10_000
#: rows that are sorted and numbered in one task
PART_ROWS = 1 << 18


def numbered(df: DataFrame, order: list[Column], rows: int, name: str = "rank") -> DataFrame:
    """``df`` with ``name`` 1, 2, 3 ... in ``order``, which must be a total one (a key
    in ``order`` that ties would lie in one part).  Parts are ranges of the order;
    each is sorted by itself and goes on from the rows of the parts before it."""
    parts = max(1, -(-rows // PART_ROWS))
    x = staged(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    # one row for each part: a window over all of them is small
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    start = x.groupBy("_part").agg(F.count("*").alias("_n")) \
        .select(F.col("_part").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return x.withColumn("_place", place).join(start, F.col("_part") == F.col("_at")) \
        .withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_place", "_at", "_start")


def bracket(scores: DataFrame, take: int, rows: int, score: str = "score",
            accuracy: int = ACCURACY) -> tuple[int, int, int]:
    """(low, high, rows above high): the ``take``-th highest of ``rows`` scores lies
    in [low, high].  A quantile sketch proposes the bracket; the exact count of rows
    above it and in it confirms it, or it is widened."""
    at, margin = 1 - take / rows, 2 / accuracy
    while True:
        ends = [max(0.0, at - margin), min(1.0, at + margin)]
        low, high = scores.agg(F.percentile_approx(score, F.array(*map(F.lit, ends)), accuracy)).first()[0]
        if ends[0] == 0.0:
            low = scores.agg(F.min(score)).first()[0]
        if ends[1] == 1.0:
            high = scores.agg(F.max(score)).first()[0]
        above, inside = scores.agg(F.count_if(F.col(score) > high),
                                   F.count_if(F.col(score).between(low, high))).first()
        if above < take <= above + inside:
            return low, high, above
        margin *= 4
