"""Sharding by session id, and merging several inputs into one stream.

The upstream deployment runs N copies of a pipeline, each filtering both
inputs to ``MOD(sessionid, N) = k``.  ``co_sharded_join`` lays both inputs out in N
shards once and joins them shard by shard in one job, without N scans; ``shard``
and ``sharded`` express the filter and prove the union identity.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import shard_of
from ..session import scratch_path
from .joins import interval_pairs, interval_sides


def shard(df: DataFrame, num_shards: int, k: int, key: str = "sessionid") -> DataFrame:
    """Rows of shard ``k`` of ``num_shards`` (a non-negative modulus of the key)."""
    if not 0 <= k < num_shards:
        raise ValueError("shard out of range")
    return df.filter(shard_of(F.col(key).cast("bigint"), num_shards) == k)


def sharded(query: Callable[..., DataFrame], inputs: list[DataFrame], num_shards: int,
            key: str = "sessionid") -> DataFrame:
    """Union over shards of ``query`` run on the shard-filtered inputs; equal
    to ``query(*inputs)`` when the query only combines rows of one key."""
    parts = [query(*[shard(df, num_shards, k, key) for df in inputs])
             for k in range(num_shards)]
    return reduce(DataFrame.unionByName, parts)


def laid_out(df: DataFrame, num_shards: int, keys: list[str]) -> DataFrame:
    """``df`` as a table of ``num_shards`` buckets by ``keys``, sorted in each, in the
    shared scratch folder.  Tables laid out alike join shard by shard, without an
    exchange, and the layout can be read by many queries."""
    spark = df.sparkSession
    name = f"shards_{uuid.uuid4().hex}"
    (df.repartition(num_shards, *keys).write.format("parquet").bucketBy(num_shards, *keys).sortBy(*keys)
     .option("path", scratch_path(spark, name)).saveAsTable(name))
    out = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # from the catalog alone: the files stay, as those of any staged table
    return out


def co_sharded_join(left: DataFrame, right: DataFrame, num_shards: int, lower, upper, key: str = "sessionid",
                    time: str = "eventtime", right_cols: tuple[str, ...] = ("cellid",)) -> DataFrame:
    """Interval join of two inputs that are both cut into ``num_shards`` first: a shard
    of one meets the same shard of the other alone.  Shards are made of (key, time
    bucket), so that a key with very many rows lies in many of them; rows without a
    key are in none."""
    sides = interval_sides(left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull()), key, time, time,
                           lower, upper, list(right_cols))
    l, r = (laid_out(side, num_shards, [k, "_b"]) for side, k in zip(sides, (key, "_rkey")))
    return interval_pairs(l.hint("merge"), r, key, lower, upper, left.columns, list(right_cols))


def merge_streams(*dfs: DataFrame) -> DataFrame:
    """Several pumps into one stream: a union by column name (batch or stream).

    Inputs must be disjoint (e.g. distinct directories); a shared source
    would deliver every row once per pump."""
    return reduce(DataFrame.unionByName, dfs)
