"""Distinct values of every key, where a few keys hold most of the rows.

Keys become dense codes, equal splits are counted with ``numpy.bincount`` into blocks of a dense array, and the blocks
are added up by a reduction of bounded fan-in.  No step handles one key as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import stage, width

#: Counters in a block of the dense array, and blocks that one step of the reduction adds up.
BLOCK, FAN_IN = 1024, 64


@dataclass
class Distincts:
    """The result in parts: ``pairs`` (key, value, code), ``keys`` (code, key) and ``counts`` (key, code, n_values)."""

    pairs: DataFrame
    keys: DataFrame
    counts: DataFrame


def _local_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a sorted split: successive codes of its keys from 0, and where each key begins."""
    last, code = None, -1
    for batch in batches:
        n, key = batch.num_rows, batch.column("_key")
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = key[0].as_py() != last
        if n > 1:
            new[1:] = pc.not_equal(key.slice(1), key.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        codes = code + np.cumsum(new)
        last, code = key[n - 1].as_py(), int(codes[-1])
        yield pa.RecordBatch.from_arrays([key, batch.column("_value"), pa.array(codes), pa.array(new)], names=["_key", "_value", "_code", "_new"])


def _bincount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count the codes of an input split into blocks of the dense array; at most 256 open blocks are held."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        codes = np.sort(batch.column("code").to_numpy())
        blocks = codes // BLOCK
        edges = np.flatnonzero(np.diff(blocks)) + 1
        for a, b in zip([0, *edges], [*edges, len(codes)]):
            if a < b:
                block = int(blocks[a])
                held[block] = held.get(block, 0) + np.bincount(codes[a:b] - block * BLOCK, minlength=BLOCK)
        while len(held) > 256:
            block = next(iter(held))
            yield _block(block, held.pop(block))
    for block, counts in held.items():
        yield _block(block, counts)


def _block(block: int, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([counts.astype(np.int64)], pa.list_(pa.int64()))], names=["block", "counts"])


def _add_blocks(blocks: DataFrame, parts: int) -> DataFrame:
    """Sum the arrays of every block; each step adds at most FAN_IN arrays, so no task holds more than that."""
    zero = F.array_repeat(F.lit(0).cast("long"), BLOCK)
    plus = lambda df: df.agg(F.aggregate(F.collect_list("counts"), zero, lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("counts"))
    while parts > 1:
        parts = -(-parts // FAN_IN)
        blocks = plus(blocks.withColumn("part", (F.col("part") % F.lit(parts)).cast("int")).groupBy("block", "part"))
    return blocks.select("block", "counts")


def distincts(df: DataFrame, key: str, value: str) -> Distincts:
    """Count and list the distinct ``value`` of every ``key`` with even work.

    Rows whose key or value is null count for nothing; repeated rows count once; an empty table gives empty results;
    other columns are ignored, whatever their names.  Both columns are taken as strings.

    1. Repeats are removed before and after an exchange by the *pair*, which spreads a hot key over all tasks.
    2. Pairs are range-partitioned by (key, value): equal splits, each with an ascending run of keys.  A split's keys
       get successive codes; where its codes begin follows from one row a split, so encoding needs no join.
    3. Input splits are counted with bincount into blocks of BLOCK counters; ``_add_blocks`` sums the blocks.
    """
    spark = df.sparkSession
    pairs = df.select(F.col(key).cast("string").alias("_key"), F.col(value).cast("string").alias("_value")).where(F.col("_key").isNotNull() & F.col("_value").isNotNull()).distinct()
    n = width(spark)
    schema = T.StructType([T.StructField("_key", T.StringType()), T.StructField("_value", T.StringType()), T.StructField("_code", T.LongType()), T.StructField("_new", T.BooleanType())])
    splits = stage(pairs.repartitionByRange(n, "_key", "_value").sortWithinPartitions("_key", "_value").mapInArrow(_local_codes, schema).withColumn("_split", F.spark_partition_id()), "splits")
    ends = splits.where("_new").groupBy("_split").agg(F.min("_key").alias("lo"), F.max("_key").alias("hi"), F.max("_code").alias("top")).orderBy("_split").collect()  # one row a split
    starts, nxt, hi = [], 0, None
    for e in ends:
        begin = nxt - (e["lo"] == hi)  # a key that the split before began keeps its code
        starts.append((e["_split"], begin))
        nxt, hi = begin + e["top"] + 1, e["hi"]
    begins = F.broadcast(spark.createDataFrame(starts, "_split int, _start long"))
    coded = splits.join(begins, "_split").withColumn("code", F.col("_start") + F.col("_code"))
    blocks = stage(coded.select("code").mapInArrow(_bincount, "block long, counts array<bigint>").withColumn("part", F.spark_partition_id()), "blocks")
    parts = (blocks.agg(F.max("part")).first()[0] or 0) + 1
    dense = _add_blocks(blocks, parts)
    counts = dense.select((F.col("block") * BLOCK).alias("base"), F.posexplode("counts").alias("at", "n_values")).where("n_values > 0").select((F.col("base") + F.col("at")).alias("code"), "n_values")
    keys = coded.where("_new").groupBy("code").agg(F.min("_key").alias(key))
    return Distincts(coded.select(F.col("_key").alias(key), F.col("_value").alias(value), "code"), keys, counts.join(keys, "code").select(key, "code", "n_values"))


def heavy_keys(df: DataFrame, key: str, value: str, percent: int) -> DataFrame:
    """Keys that hold at least ``percent`` hundredths of all distinct pairs, with their number of values."""
    counts = stage(distincts(df, key, value).counts, "counts")
    total = counts.agg(F.coalesce(F.sum("n_values"), F.lit(0))).first()[0]
    return counts.where((F.lit(total) > 0) & (F.col("n_values") * 100 >= F.lit(total) * percent)).select(key, "n_values")


def value_lists(df: DataFrame, key: str, value: str, chunk: int = 1000) -> DataFrame:
    """The sorted distinct values of every key as lists of at most ``chunk``, numbered from 0.

    A hot key has many lists, made by many tasks: positions come from ``ranked``, and lists are grouped by (key, list).
    """
    from ..plans.skew import ranked

    pairs = df.select(F.col(key).cast("string").alias(key), F.col(value).cast("string").alias(value)).where(F.col(key).isNotNull() & F.col(value).isNotNull()).distinct()
    at = ranked(pairs, [key], [F.col(value)], "_at")
    return (
        at.groupBy(key, F.floor((F.col("_at") - 1) / chunk).cast("long").alias("list_no"))
        .agg(F.count("*").alias("n_values"), F.array_sort(F.collect_list(value)).alias("values"))
    )
