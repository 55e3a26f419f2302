"""The best N items of every group by a multiway merge of sorted runs."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage, width

#: Rows in one block of a stored run, and runs that one merge takes at most: it holds a block of each.
BLOCK_ROWS, FAN_IN = 1024, 512
_RUN = "bucket int, run long, g0 string, s0 double, i0 string, groups array<string>, items array<string>, scores array<double>"


class LoserTree:
    """Tournament over sources: inner nodes keep the losers, so replacing the winner replays one path to the root.

    A key is any comparable tuple; ``None`` means that a source has ended and loses against everything.
    """

    def __init__(self, keys: list[tuple | None]):
        self.n = n = max(1, len(keys))
        self.keys = list(keys) or [None]
        self.tree = [-1] * n
        winner = [-1] * (2 * n)
        winner[n:] = range(n)
        for i in range(n - 1, 0, -1):
            a, b = winner[2 * i], winner[2 * i + 1]
            winner[i], self.tree[i] = (a, b) if self._wins(a, b) else (b, a)
        self.top = winner[1] if n > 1 else 0

    def _wins(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def replace(self, key: tuple | None) -> None:
        """The winner's source moves on to ``key``."""
        at = self.top
        self.keys[at] = key
        i = (at + self.n) // 2
        while i:
            if not self._wins(at, self.tree[i]):
                at, self.tree[i] = self.tree[i], at
            i //= 2
        self.top = at


class _Block:
    """A block of a stored run and a place in it; ``seek`` jumps over the rest of the current group."""

    def __init__(self, groups: list[str], items: list[str], scores: list[float]):
        self.groups, self.items, self.scores, self.at = groups, items, scores, 0

    def key(self) -> tuple | None:
        i = self.at
        return (self.groups[i], -self.scores[i], self.items[i]) if i < len(self.groups) else None

    def step(self) -> tuple | None:
        self.at += 1
        return self.key()

    def seek(self, group: str) -> tuple | None:
        """To the first row of a later group (string order, as the run is sorted)."""
        lo = self.at
        hop = 1
        while lo + hop < len(self.groups) and self.groups[lo + hop] <= group:
            hop *= 2
        self.at = bisect_left(self.groups, group + "\0", lo, min(len(self.groups), lo + hop + 1))
        return self.key()


def merge_runs(blocks: Iterator[tuple[int, tuple, Callable[[], _Block]]], n: int) -> Iterator[tuple[str, str, float]]:
    """The first ``n`` distinct items of every group, in order.

    blocks: (run, first key, how to load it) of all runs, by first key.  A block is loaded when the merge comes to its
    first key, and left when it is used up, so a merge holds about one block a run.  After ``n`` outputs of a group all
    loaded blocks seek the next one, and blocks that lie wholly within the group are left again at once.
    """
    blocks = iter(blocks)
    waiting = next(blocks, None)
    held: list[_Block] = []
    group, seen = None, set()
    while held or waiting:
        first = min((b.key() for b in held), default=None)
        while waiting and (first is None or waiting[1] <= first):
            block = waiting[2]()
            if group is not None and len(seen) == n:
                block.seek(group)
            if block.key() is not None:
                held.append(block)
                first = min(first, block.key()) if first else block.key()
            waiting = next(blocks, None)
        tree = LoserTree([b.key() for b in held])
        bound = waiting[1] if waiting else None
        while (key := tree.keys[tree.top]) is not None and (bound is None or key < bound):
            if key[0] != group:
                group, seen = key[0], set()
            if len(seen) == n:
                tree.replace(held[tree.top].seek(group))
            else:
                if key[2] not in seen:
                    seen.add(key[2])
                    yield group, key[2], -key[1]
                tree.replace(held[tree.top].step())
        held = [b for b in held if b.key() is not None]


def _blocks(rows: Iterator[tuple[int, int, str, str, float]]) -> Iterator[pa.RecordBatch]:
    """Blocks of at most BLOCK_ROWS rows from rows that are sorted by (bucket, group, score, item)."""
    held: list[tuple] = []
    made: list[tuple] = []
    for row in rows:
        if held and (row[:2] != held[0][:2] or len(held) == BLOCK_ROWS):
            made.append(_as_block(held))
            held = []
            if len(made) == 64:
                yield _as_batch(made)
                made = []
        held.append(row)
    if held:
        made.append(_as_block(held))
    if made:
        yield _as_batch(made)


def _as_block(rows: list[tuple]) -> tuple:
    bucket, run, groups, items, scores = zip(*rows)
    return bucket[0], run[0], groups[0], scores[0], items[0], groups, items, scores


def _as_batch(made: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.float64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["bucket", "run", "g0", "s0", "i0", "groups", "items", "scores"])


def _cut(n: int):
    """Of a sorted split: the first ``n`` distinct items of every group, as runs.  Only group starts are looked at one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            group, seen, split = None, set(), 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                if group is None:
                    split = batch.column("run")[0].as_py()
                g = batch.column("g").dictionary_encode()
                codes = g.indices.to_numpy()
                starts = np.append(0, np.flatnonzero(np.diff(codes)) + 1)
                for a, b in zip(starts, np.append(starts[1:], len(codes))):
                    name = g.dictionary[int(codes[a])].as_py()
                    if name != group:
                        group, seen = name, set()
                    bucket, at = batch.column("bucket")[int(a)].as_py(), int(a)
                    while at < b and len(seen) < n:
                        some = batch.slice(at, min(4 * n, int(b) - at))
                        for item, score in zip(some.column("i").to_pylist(), some.column("s").to_pylist()):
                            if len(seen) < n and item not in seen:
                                seen.add(item)
                                yield bucket, split, name, item, score
                        at += 4 * n

        yield from _blocks(rows())

    return run


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, tuple, Callable[[], _Block]]]:
    for batch in batches:
        heads = zip(*(batch.column(c).to_pylist() for c in ("bucket", "part", "run", "g0", "s0", "i0")))
        for i, (bucket, part, run, g, s, item) in enumerate(heads):
            yield (bucket, part), run, (g, -s, item), lambda b=batch, i=i: _Block(*(b.column(c)[i].values.to_pylist() for c in ("groups", "items", "scores")))


def _merge(n: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (bucket, part), blocks in groupby(_stored(batches), key=lambda b: b[0]):
                for row in merge_runs((b[1:] for b in blocks), n):
                    yield bucket, part, *row

        if not last:
            yield from _blocks(rows())
            return
        found = rows()
        while some := list(islice(found, 10_000)):
            _, _, g, i, s = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(i, pa.string()), pa.array(s, pa.float64())], names=["g", "i", "s"])

    return run


def top_n(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """The ``n`` best distinct items of every group: score descending, equal scores by item ascending.

    Rows whose group, item or score is null or NaN take no part; an item delivered more than once counts with its
    highest score; groups with fewer items keep all; an empty table gives no rows; other columns are ignored.

    1. Every input split is sorted (spilling if need be) by bucket, group, score and item, and cut to the first n of
       each group: a group that holds a third of all rows leaves n rows a split.  Runs are stored as sorted blocks.
    2. The blocks of a bucket come to its task by their first keys (sorted by Spark, on disk if need be) and are merged
       by a loser tree; after n outputs every run seeks the next group.  Where there are more than FAN_IN splits, merges
       of FAN_IN runs come first.  A merge holds about a block a run, however large the bucket is.
    """
    spark = df.sparkSession
    buckets = width(spark)
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("i"), F.col(score).cast("double").alias("s"))
    rows = rows.where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("s").isNotNull() & ~F.isnan("s"))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("g"), F.lit(buckets)).cast("int")).withColumn("run", F.spark_partition_id().cast("long"))
    # -0.0 and 0.0 are one score, as in the tree's comparisons.
    rows = rows.withColumn("s", F.when(F.col("s") == 0, F.lit(0.0)).otherwise(F.col("s")))
    split = rows.sortWithinPartitions("bucket", "g", F.desc("s"), "i").mapInArrow(_cut(n), _RUN)
    runs = stage(split, "runs")
    parts = (runs.agg(F.max("run")).first()[0] or 0) + 1
    order = ["bucket", "part", "g0", F.desc("s0"), "i0"]
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        merged = runs.withColumn("part", F.col("run") % F.lit(parts)).repartition(buckets, "bucket", "part").sortWithinPartitions(*order).mapInArrow(_merge(n, False), _RUN)
        runs = stage(merged, "runs")
    best = runs.withColumn("part", F.lit(0).cast("long")).repartition(buckets, "bucket").sortWithinPartitions(*order).mapInArrow(_merge(n, True), "g string, i string, s double")
    return best.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score))
