"""Plans whose tasks stay even when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .stage import stage, width

#: A key is hot when it holds more than one 256th of the rows, so there are at most 255 hot keys: safe to broadcast.
HOT_PARTS = 256


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with one row a key, where ``weight`` of ``per_key`` says how many rows the key has.

    Keys with more than ``total / 256`` rows (at most 255 of them, whatever the data) are broadcast, so their rows are
    not moved at all; the others are joined by an ordinary exchange, in which no key is large.  Null keys match nothing.
    """
    hot = F.broadcast(per_key.where(F.col(weight) * HOT_PARTS > F.lit(total)))
    cold = per_key.where(~(F.col(weight) * HOT_PARTS > F.lit(total)))
    left = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return rows.join(hot, key).unionByName(left.join(cold, key))


def _local_ranks(groups: list[str], fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, at = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            new = np.zeros(n, bool)
            new[0] = True
            for g in groups:
                c = batch.column(g)
                if n > 1:
                    same = pc.equal(c.slice(1), c.slice(0, n - 1))
                    both = pc.and_(pc.is_null(c.slice(1)), pc.is_null(c.slice(0, n - 1)))
                    new[1:] |= ~pc.fill_null(pc.or_kleene(same, both), False).to_numpy(zero_copy_only=False)
            first = tuple(batch.column(g)[0].as_py() for g in groups)
            starts = np.flatnonzero(new)
            rank = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) + 1
            if last == first:
                rank[: starts[1] if len(starts) > 1 else n] += held
            last, held = tuple(batch.column(g)[n - 1].as_py() for g in groups), int(rank[-1])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(f) for f in fields), pa.array(rank, pa.int64()), pa.array(np.arange(at, at + n), pa.int64())],
                names=[*fields, "_local", "_pos"],
            )
            at += n

    return run


def ranked(df: DataFrame, groups: list[str], order: list[Column], out: str) -> DataFrame:
    """Add the 1-based position of every row in its group, however large the group is.

    Rows are range-partitioned by group *and* order, so a group of any size is spread over many equal splits; each
    split numbers its own rows, and what it must add is one number for the group that it continues.  Only those
    numbers, one a split, meet at the driver.  Equal rows get successive positions.
    """
    spark = df.sparkSession
    fields = df.columns
    keys = [F.col(g) for g in groups]
    splits = df.repartitionByRange(width(spark), *keys, *order).sortWithinPartitions(*keys, *order)
    schema = T.StructType([*df.schema.fields, T.StructField("_local", T.LongType()), T.StructField("_pos", T.LongType())])
    held = stage(splits.mapInArrow(_local_ranks(groups, fields), schema).withColumn("_split", F.spark_partition_id()), "ranked")
    ends = (
        held.groupBy("_split")
        .agg(F.min_by(F.struct(*keys), "_pos").alias("first"), F.max_by(F.struct(*keys, "_local"), "_pos").alias("last"))
        .orderBy("_split")
        .collect()  # one row a split
    )
    add, before, held_rows = [], None, 0
    for e in ends:
        first, last = tuple(e["first"]), tuple(e["last"])
        plus = held_rows if before == first else 0
        add.append((e["_split"], plus, *first))
        held_rows = last[-1] + (plus if last[:-1] == first else 0)
        before = last[:-1]
    names = [f"_first{i}" for i in range(len(groups))]
    kinds = [T.StructField(n, df.schema[g].dataType) for n, g in zip(names, groups)]
    offsets = spark.createDataFrame(add, T.StructType([T.StructField("_split", T.IntegerType()), T.StructField("_add", T.LongType()), *kinds]))
    here = F.lit(True)
    for n, g in zip(names, groups):
        here = here & F.col(g).eqNullSafe(F.col(n))
    return (
        held.join(F.broadcast(offsets), "_split")
        .withColumn(out, F.col("_local") + F.when(here, F.col("_add")).otherwise(F.lit(0)))
        .select(*fields, out)
    )


#: One of so many rows is looked at to tell hot keys.
LOOK = 8


def join_salted(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
    """Inner join in which no key's rows meet in one task: the rows of a hot key of ``right`` are spread by ``spread``.

    Hot is a key that holds more than a 256th of the rows of ``right`` (at most 255 of them, broadcast); its rows of
    ``left`` go to each of the parts.  Hot keys are told from the rows whose ``spread`` hashes to a multiple of LOOK:
    that decides the layout only, every row is joined.  Null keys match nothing.  ``right`` is read twice: a stage.
    """
    parts = width(left.sparkSession)
    some = right.where(F.pmod(F.xxhash64(spread), F.lit(LOOK)) == 0)
    total = some.count()
    hot = F.broadcast(some.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") * HOT_PARTS > F.lit(max(total, HOT_PARTS))).select(key, F.lit(True).alias("_hot")))
    ask = left.join(hot, key, "left").withColumn("_part", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))))
    show = right.join(hot, key, "left").withColumn("_part", F.when(F.col("_hot"), F.pmod(F.hash(spread), F.lit(parts))).otherwise(F.lit(0)))
    return ask.drop("_hot").join(show.drop("_hot"), [key, "_part"]).drop("_part")
