"""Filling containers of fixed capacity with whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.skew import ranked
from ..plans.stage import stage
from . import tokens


def harmonic_class(size: int, capacity: int) -> int:
    """j with capacity/(j+1) < size <= capacity/j: j such items always fit into one container."""
    return capacity // max(1, size)


def plan(counts: dict[int, int], capacity: int, mixed: bool = True) -> list[tuple[dict[int, int], int]]:
    """Container templates and how often each is filled: [({size: items of it in one container}, containers)].

    Items are counted by size, so there are at most ``capacity`` numbers to plan with, however many items exist.  A
    template of plain harmonic packing holds items of one reciprocal-capacity class only (``mixed=False``): class j
    fills every container with exactly j items, which leaves up to half of a container unused.  ``mixed`` refines the
    classes down to single sizes and lets a template take, after its largest size, the largest that still fits from
    the smaller ones; the item count of a template stays fixed, so its containers are still filled independently.
    """
    left = {max(1, s): 0 for s in counts}
    for s, n in counts.items():
        left[max(1, s)] += n
    out: list[tuple[dict[int, int], int]] = []
    sizes = sorted((s for s, n in left.items() if n), reverse=True)
    if not mixed:
        for s in sizes:  # one class after another; a size class is filled with j items, the last container with fewer
            j = harmonic_class(s, capacity)
            if left[s] // j:
                out.append(({s: j}, left[s] // j))
            if left[s] % j:
                out.append(({s: left[s] % j}, 1))
        return out
    while sizes:
        room, template = capacity, {}
        for s in sizes:
            if s <= room:
                m = min(room // s, left[s])
                template[s] = m
                room -= m * s
                if not room:
                    break
        times = min(left[s] // m for s, m in template.items())
        out.append((template, times))
        for s, m in template.items():
            left[s] -= m * times
        sizes = [s for s in sizes if left[s]]
    return out


def pack(df: DataFrame, item: str, size: str, capacity: int, mixed: bool = True) -> DataFrame:
    """Container of every piece: (item, piece, size, container).

    Items of at most ``capacity`` are one piece (0).  A larger item, the only kind that is split, makes full pieces of
    ``capacity`` and one of the rest; its full pieces fill containers of their own.  Null sizes count as 0, and items
    of size 0 take the room of size 1; null ids and repeated rows are items like others; no rows give no rows.

    Only the number of items of each size (at most ``capacity`` numbers) reaches the driver; an item finds its
    container from its position among those of its size, which is made by range partitioning, so a size that a third
    of the items share is spread over many tasks.
    """
    spark = df.sparkSession
    rows = df.select(F.col(item), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("_size"))
    cap = F.lit(capacity)
    whole = F.when(F.col("_size") > cap, F.floor(F.col("_size") / cap)).otherwise(F.lit(0)).cast("long")
    rest = F.col("_size") - whole * cap
    pieces = F.when(whole > 0, F.sequence(F.lit(0).cast("long"), whole - F.when(rest == 0, F.lit(1)).otherwise(F.lit(0)))).otherwise(F.array(F.lit(0).cast("long")))
    cut = rows.select(item, rest.alias("_rest"), whole.alias("_whole"), F.explode(pieces).alias("piece"))
    cut = cut.select(item, "piece", F.when(F.col("piece") < F.col("_whole"), cap).otherwise(F.col("_rest")).cast("long").alias("size"))
    cut = cut.withColumn("_class", F.greatest(F.col("size"), F.lit(1)).cast("int"))
    placed = stage(ranked(cut, ["_class"], [F.col(item), F.col("piece")], "_rank"), "sizes")
    counts = {r[0]: r[1] for r in placed.groupBy("_class").count().collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple]] = {}
    taken: dict[int, int] = {}
    container = 0
    for template, times in plan(counts, capacity, mixed):
        for s, m in template.items():
            start = taken.get(s, 0)
            slots.setdefault(s, []).append((start, start + m * times, m, container))
            taken[s] = start + m * times
        container += times
    slot = T.StructType([T.StructField(n, T.LongType()) for n in ("lo", "hi", "each", "base")])
    plans = spark.createDataFrame([(s, v) for s, v in slots.items()], T.StructType([T.StructField("_class", T.IntegerType()), T.StructField("_slots", T.ArrayType(slot))]))
    rank = F.col("_rank") - 1
    mine = F.filter("_slots", lambda x: (x["lo"] <= rank) & (rank < x["hi"]))[0]
    return (
        placed.join(F.broadcast(plans), "_class")  # at most `capacity` rows
        .withColumn("_mine", mine)
        .select(item, "piece", "size", (F.col("_mine.base") + F.floor((rank - F.col("_mine.lo")) / F.col("_mine.each"))).cast("long").alias("container"))
    )


def pack_documents(df: DataFrame, doc: str, text: str, capacity: int = 2048) -> DataFrame:
    """Pack documents by their token counts (see ``tokens``)."""
    sizes = stage(df.select(F.col(doc), tokens.count(F.col(text)).alias("n_tokens")), "token_counts")
    return pack(sizes, doc, "n_tokens", capacity)
