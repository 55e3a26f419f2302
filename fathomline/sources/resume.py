"""Resumable outputs: shards by a stable hash, and what of them is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def shard(key: Column, n: int) -> Column:
    """A stable shard number, the same in any engine that has MD5."""
    return F.pmod(F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long"), F.lit(n)).cast("int")


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key).distinct(), key, "left_anti")


def missing_shards(todo: DataFrame, done: DataFrame, key: str, n: int) -> DataFrame:
    """(shard, missing): shards with keys that have no result yet, and how many."""
    rest = remaining(todo.where(F.col(key).isNotNull()), done, key)
    return rest.groupBy(shard(F.col(key), n).alias("shard")).agg(F.count("*").alias("missing"))
