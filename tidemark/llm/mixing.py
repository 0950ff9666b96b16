"""Mixing sources to target weights.

Token counts are aggregated per source, each source gets a target by weight
(bounded by ``max_rate`` repetitions of its own size), and every document is
emitted ``floor(rate)`` times plus one hash-seeded Bernoulli copy with
probability equal to the fraction of ``rate = target / source size``.

Defined results: a null text has size 0; a null source is a source of its
own, ordered last; sources without words get target 0; repeated rows are
mixed row by row with the same draw; an empty table gives an empty result.
Only the columns named here are read, so extra columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import nested, row_columns, staged

WORD = r"[^\x20\x09-\x0D]+"
#: a table of at most this many sources is broadcast, a larger one is joined by shuffle
BROADCAST_SOURCES = 20_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: str) -> Column:
    """A draw in [0, 1) that depends on the seed and the document id alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_rate: int = 3) -> DataFrame:
    """``(source, source_size, target)`` from per-document ``(source, size)``.

    Sources in code point order (null last) weigh ``weights`` in turn and share
    the total size; a target stops at ``max_rate`` times the source's size and
    the excess goes to the others by weight until none is above.  With the
    sources ordered by cap / weight, the level per unit of weight is the
    largest of (total - caps before) / (weights from here on).  The windows run
    over one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("source", "source_size", place.alias("place"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", "place", weight.cast("long").alias("weight"),
                     (F.col("source_size") * max_rate).alias("cap"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))).cast("double")
             / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return per.select("source", "source_size",
                      F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def with_copies(docs: DataFrame, seed: str = "mix", weights: tuple[int, ...] = (1, 2, 3),
                max_rate: int = 3) -> DataFrame:
    """``_row`` (the columns of ``docs``), ``doc_id``, ``_size``, ``_source_size``,
    ``_target`` and ``_copies``."""
    sized = nested(docs, "doc_id", "source", word_count(F.col("text")).alias("_size"))
    per = staged(source_targets(sized.select("source", F.col("_size").alias("size")), weights, max_rate), "targets")
    per = per.select(F.col("source").alias("_source"), F.col("source_size").alias("_source_size"),
                     F.col("target").alias("_target"))
    if per.count() <= BROADCAST_SOURCES:
        per = F.broadcast(per)
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = F.least(F.lit(max_rate).cast("long"),
                     whole + (uniform(F.col("doc_id"), seed) < rate - whole).cast("long"))
    return (sized.join(per, F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("_copies", copies).drop("_source"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """One row per document with the words the mix takes from it."""
    mixed = with_copies(docs.select("doc_id", "text", "source"), **options)
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


MIXED = ("copy", "size", "source_size", "target", "taken")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document's row once per copy, numbered from 1 in
    ``copy``; ``taken`` is the words of that row.  Columns of ``docs`` that are
    named like one of the added ones are replaced."""
    mixed = with_copies(docs, **options).where("_copies > 0")
    mixed = mixed.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))))
    return mixed.select(*row_columns(docs, *MIXED), "copy", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"),
                        F.col("_target").alias("target"), F.col("_size").alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM {documents}
), p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place
  FROM d GROUP BY source
), w AS (
  SELECT *, place % 3 + 1 AS weight, 3 * source_size AS cap FROM p
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER prev, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER prev, 0))::DOUBLE AS step
  FROM w
  WINDOW prev AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(cap::DOUBLE, max(step) OVER () * weight) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)
           / 4503599627370496.0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(3, floor(rate) + (draw < rate - floor(rate))::INT) AS BIGINT) AS taken
FROM r
"""
