"""Connected components of an edge table, as joins and aggregates.

Large-star and small-star steps alternate until the edges stop changing: every
node ends up linked to the smallest id of its component.  A node's smallest
neighbour is aggregated before the shuffle and joined back, so a node with very
many neighbours is never gathered.  Lineage is cut with ``checkpoint``, whose
files lie in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")) \
        .select("e.a", "e.b")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m")
    moved = edges.join(least, F.col("a") == F.col("n"))
    return moved.select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")) \
        .select("e.a", "e.b").where("a > b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` of every node with an edge to another node."""
    checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b")) \
        .where("a > b").distinct().checkpoint()
    state = _state(edges)
    while state[0]:
        edges = _small_star(_large_star(edges)).checkpoint()
        last, state = state, _state(edges)
        if state == last:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")) \
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
