"""The most similar vectors of every vector: NN-descent over a forest of random hyperplanes, and greedy graph search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import join_by_key
from ..plans.stage import drop_stage, stage, width

#: Neighbours kept while the graph is built, trees, bits of a tree's signature, rows compared in a sorted run.
K, TREES, BITS, WINDOW = 40, 14, 48, 48
#: Edges that a tree gives a node to start with; the rounds find the rest.
FIRST = 12
#: Rounds of neighbours-of-neighbours at most, and the share of changed edges below which they end.
ROUNDS, SETTLED = 5, 0.001
SEED = 7
_EDGE = "src long, dst long, sim double"


def clean(df: DataFrame, item: str, vector: str) -> DataFrame:
    """(item, vector) once an item: usable vectors of the commonest length.

    Null items, null or all-zero vectors, such with a null, NaN or infinite element, and vectors of another length
    than the commonest (ties: the longest) take no part; of several vectors of one item the smallest counts.
    """
    rows = df.select(F.col(item).cast("string").alias("item"), F.col(vector).cast("array<float>").alias("vector")).where("item is not null and vector is not null")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    rows = rows.where(F.forall("vector", fine) & F.exists("vector", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    rows = rows.where(F.size("vector") == (lengths["n"] if lengths else -1))
    return rows.groupBy("item").agg(F.min("vector").alias("vector"))


@dataclass
class Index:
    """classes (cid, n, vector: one row for each different direction), members (item, cid) and graph (src, dst, sim)."""

    classes: DataFrame
    members: DataFrame
    graph: DataFrame


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of one direction are one node of the graph; a direction that a third of the items share is one row.

    Directions are told apart by a millionth of each element, so cosines in a class are 1 to nine digits.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    unit = rows.withColumn("l", length).withColumn("u", F.transform("vector", lambda x: F.round(x.cast("double") / F.col("l") * 1e6).cast("long")))
    keyed = stage(unit.select("item", "vector", F.concat_ws(" ", F.xxhash64("u").cast("string"), F.hash("u").cast("string")).alias("k")), "vectors")
    one = keyed.groupBy("k").agg(F.first("vector").alias("vector"), F.count("*").alias("n"))
    classes = stage(one.withColumn("cid", F.monotonically_increasing_id()), "classes")
    members = join_by_key(keyed.select("k", "item"), classes.select("k", "n", "cid"), "k", "n", keyed.count())
    return classes.select("cid", "n", "vector"), members.select("item", "cid")


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows as half-precision bytes: a quarter of what an array of doubles takes in an exchange."""
    x = np.ascontiguousarray(x, np.float16)
    size = x.shape[1] * 2
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, (len(x) + 1) * size, size, dtype=np.int32)), pa.py_buffer(x)])


def _unpacked(column: pa.Array) -> np.ndarray:
    column = pa.concat_arrays([column])
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    flat = np.frombuffer(column.buffers()[2], np.float16, (ends[-1] - ends[0]) // 2, int(ends[0]))
    return flat.reshape(len(column), -1).astype(np.float32)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each tree: the signs of random projections, the vector in half precision."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _unit(batch.column("vector"))
        planes = np.random.default_rng(SEED).standard_normal((x.shape[1], TREES * BITS))
        weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
        v = _packed(x)
        for t in range(TREES):
            signature = (x @ planes[:, t * BITS : (t + 1) * BITS] > 0).astype(np.int64) @ weights
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(signature), batch.column("cid"), v], names=["tree", "sig", "cid", "v"])


def _best_in_window(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(src, dst, sim) of the k best of each row among the rows at most a window away on either side."""
    src, dst, sim = [], [], []
    for a in range(0, len(ids), WINDOW):
        lo, hi, b = max(0, a - WINDOW), min(len(ids), a + 2 * WINDOW), min(len(ids), a + WINDOW)
        s = x[a:b] @ x[lo:hi].T
        s[np.arange(b - a), np.arange(a - lo, b - lo)] = -2
        m = min(k, hi - lo - 1)
        if m <= 0:
            continue
        best = np.argpartition(-s, m - 1, axis=1)[:, :m]
        src.append(np.repeat(ids[a:b], m))
        dst.append(ids[lo:hi][best].ravel())
        sim.append(np.take_along_axis(s, best, 1).ravel())
    none = np.zeros(0, np.int64)
    return (np.concatenate(src), np.concatenate(dst), np.concatenate(sim)) if src else (none, none, none.astype(float))


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst), pa.array(np.round(sim.astype(np.float64), 6))], names=["src", "dst", "sim"])


def _windows(k: int):
    """Compare sorted rows with those near them; a window of the last rows is carried from batch to batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, ids, x = None, np.zeros(0, np.int64), None
        for batch in batches:
            if not batch.num_rows:
                continue
            trees, cids, v = batch.column("tree").to_numpy(), batch.column("cid").to_numpy(), _unpacked(batch.column("v"))
            edges = np.flatnonzero(np.diff(trees)) + 1
            for a, b in zip([0, *edges], [*edges, len(trees)]):
                same = tree == trees[a]
                tree = trees[a]
                ids = np.append(ids[-WINDOW:], cids[a:b]) if same else cids[a:b]
                x = np.concatenate([x[-WINDOW:], v[a:b]]) if same else v[a:b]
                yield _edges(*_best_in_window(ids, x, k))

    return run


def _forest_edges(classes: DataFrame, k: int) -> DataFrame:
    """Edges to start from: rows that are close in the order of a tree's signatures.

    A sorted run is cut by position, not by signature, so a bucket of any size costs the same a row.
    """
    n = width(classes.sparkSession)
    signed = classes.select("cid", "vector").mapInArrow(_signed, "tree int, sig long, cid long, v binary")
    return signed.repartitionByRange(n, "tree", "sig", "cid").sortWithinPartitions("tree", "sig", "cid").mapInArrow(_windows(k), _EDGE)


def _top(edges: DataFrame, k: int) -> DataFrame:
    """The k best edges of every source; partial limits come before the exchange."""
    by = Window.partitionBy("src").orderBy(F.desc("sim"), "dst")
    return edges.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k).drop("r")


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by v: pairs of v's neighbours, one of them new, that improve the list of either."""

    def groups() -> Iterator[tuple]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column("v").to_numpy()
            last = int(np.searchsorted(v, v[-1]))  # the last group may go on in the next batch
            if last or (held and held[-1].column("v")[-1].as_py() != v[0]):
                yield pa.Table.from_batches([*held, batch.slice(0, last)]) if last else pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(last))
        if held:
            yield pa.Table.from_batches(held)

    for table in groups():
        batch = table.combine_chunks().to_batches()[0]
        v, u = batch.column("v").to_numpy(), batch.column("u").to_numpy()
        new, worst, x = batch.column("new").to_numpy(zero_copy_only=False), batch.column("worst").to_numpy(), _unpacked(batch.column("x"))
        starts = np.append(0, np.flatnonzero(np.diff(v)) + 1)
        sizes = np.diff(np.append(starts, len(v)))
        for m in np.unique(sizes[sizes > 1]):
            mine = starts[sizes == m]
            for part in np.array_split(mine, max(1, len(mine) * m * m // 2_000_000)):
                at = part[:, None] + np.arange(m)
                i, j = np.triu_indices(m, 1)
                xs = x[at]
                s = np.round((xs @ xs.transpose(0, 2, 1))[:, i, j].astype(np.float64), 6)
                a, b = at[:, i], at[:, j]
                use = new[a] | new[b]
                one, two = use & (s > worst[a]), use & (s > worst[b])
                yield _edges(np.append(u[a[one]], u[b[two]]), np.append(u[b[one]], u[a[two]]), np.append(s[one], s[two]))


def _round(graph: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """One round of NN-descent: every node introduces its neighbours, in both directions, to one another."""
    n = width(graph.sparkSession)
    both = graph.select(F.col("src").alias("v"), F.col("dst").alias("u"), "sim", "new").unionByName(graph.select(F.col("dst").alias("v"), F.col("src").alias("u"), "sim", "new"))
    both = both.groupBy("v", "u").agg(F.max("sim").alias("sim"), F.max("new").alias("new"))
    # A node may be a neighbour of very many: it introduces the 2k that are new or closest, as the method has it.
    by = Window.partitionBy("v").orderBy(F.desc("new"), F.desc("sim"), "u")
    both = both.withColumn("r", F.row_number().over(by)).where(F.col("r") <= 2 * k)
    worst = graph.groupBy("src").agg(F.when(F.count("*") >= k, F.min("sim")).otherwise(F.lit(-2.0)).alias("worst"))
    nodes = vectors.join(worst.withColumnRenamed("src", "u"), "u")
    met = both.select("v", "u", "new").join(nodes, "u").repartition(n, "v").sortWithinPartitions("v")
    found = met.select("v", "u", "new", "worst", "x").mapInArrow(_local_join, _EDGE)
    joined = graph.withColumn("new", F.lit(False)).unionByName(found.withColumn("new", F.lit(True)))
    once = joined.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    return stage(_top(once, k), "graph")


def _half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column("cid"), _packed(_unit(batch.column("vector")))], names=["u", "x"])


def build(df: DataFrame, item: str, vector: str, k: int = K, rounds: int = ROUNDS) -> Index:
    """A graph of the k nearest neighbours of every different direction, by cosine (approximate; see ``clean``)."""
    classes, members = _classes(clean(df, item, vector))
    first = _forest_edges(classes, min(k, FIRST)).groupBy("src", "dst").agg(F.max("sim").alias("sim")).withColumn("new", F.lit(True))
    graph = stage(_top(first, k), "graph")
    vectors = stage(classes.select("cid", "vector").mapInArrow(_half, "u long, x binary"), "half")
    for _ in range(rounds):
        before, graph = graph, _round(graph, vectors, k)
        drop_stage(before)
        news, edges = graph.agg(F.count_if("new"), F.count("*")).first()
        if news <= SETTLED * edges:
            break
    return Index(classes, members, graph.select("src", "dst", "sim"))


def _cosines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = _unit(batch.column("a")), _unit(batch.column("b"))
            yield pa.RecordBatch.from_arrays([batch.column("src"), batch.column("dst"), pa.array((a * b).sum(1))], names=["src", "dst", "sim"])


def exact_edges(index: Index, edges: DataFrame, least: float) -> DataFrame:
    """Edges with their cosine in double precision, those below ``least`` left out."""
    near = edges.where(F.col("sim") >= least - 0.01)  # half precision is off by less
    v = index.classes
    with_both = near.select("src", "dst").join(v.select(F.col("cid").alias("src"), F.col("vector").alias("a")), "src").join(v.select(F.col("cid").alias("dst"), F.col("vector").alias("b")), "dst")
    return with_both.select("src", "dst", "a", "b").mapInArrow(_cosines, _EDGE).where(F.col("sim") >= least)


def nearest(index: Index, k: int, least: float) -> DataFrame:
    """(item, other, cosine): the k others of highest cosine of every item (ties: smaller id), none below ``least``.

    Items of one direction are neighbours with cosine 1.  A class hands over at most k + 1 of its ids, whatever its
    size; its list of neighbours reaches its members without moving those of a large class.
    """
    by = Window.partitionBy("cid").orderBy("item")
    heads = index.members.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1).groupBy("cid").agg(F.array_sort(F.collect_list("item")).alias("ids"))
    heads = stage(heads, "heads")
    listed: Column = F.transform("ids", lambda i: F.struct((-F.col("sim")).alias("far"), i.alias("other")))
    edges = exact_edges(index, index.graph, least).join(heads.withColumnRenamed("cid", "dst"), "dst").select(F.col("src").alias("cid"), listed.alias("list"))
    own = heads.select("cid", "ids", F.lit(1.0).alias("sim")).select("cid", listed.alias("list"))
    lists = edges.unionByName(own).groupBy("cid").agg(F.slice(F.array_sort(F.flatten(F.collect_list("list"))), 1, k + 1).alias("list"))  # at most K + 1 lists
    lists = stage(lists.join(index.classes.select("cid", "n"), "cid"), "lists")
    rows = join_by_key(index.members, lists, "cid", "n", index.members.count())
    rows = rows.select("item", F.slice(F.filter("list", lambda x: x["other"] != F.col("item")), 1, k).alias("list"))
    return rows.select("item", F.explode("list").alias("x")).select("item", F.col("x.other").alias("other"), (-F.col("x.far")).alias("cosine"))


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = (_unpacked(batch.column("q")) * _unpacked(batch.column("x"))).sum(1)
            yield _edges(batch.column("src").to_numpy(), batch.column("dst").to_numpy(), s)


def search(index: Index, queries: DataFrame, item: str, vector: str, k: int, beam: int = 24, hops: int = 4) -> DataFrame:
    """(query, item, cosine): the k most similar items of every query vector by greedy search of the graph.

    A query enters where the forest puts it, then its ``beam`` best nodes so far pass on their neighbours, until none
    is better (``hops`` times at most).  Unusable query vectors (see ``clean``) get no row.
    """
    asked = clean(queries, item, vector).withColumn("cid", -F.monotonically_increasing_id() - 1)
    asked = stage(asked, "queries")
    vectors = stage(index.classes.select("cid", "vector").mapInArrow(_half, "u long, x binary"), "half")
    mine = asked.select("cid", "vector").mapInArrow(_half, "u long, x binary").select(F.col("u").alias("src"), F.col("x").alias("q"))
    mixed = index.classes.select("cid", "vector").unionByName(asked.select("cid", "vector"))
    held = stage(_top(_forest_edges(mixed, beam).where("src < 0 and dst >= 0").groupBy("src", "dst").agg(F.max("sim").alias("sim")), beam).withColumn("open", F.lit(True)), "beam")
    ways = index.graph.select(F.col("src").alias("at"), F.col("dst").alias("to")).unionByName(index.graph.select(F.col("dst").alias("at"), F.col("src").alias("to"))).distinct()
    for _ in range(hops):
        steps = held.where("open").select("src", F.col("dst").alias("at")).join(ways, "at").select("src", F.col("to").alias("dst")).distinct()
        steps = steps.join(held.select("src", "dst"), ["src", "dst"], "left_anti")
        scored = steps.join(vectors.withColumnRenamed("u", "dst"), "dst").join(mine, "src").select("src", "dst", "q", "x").mapInArrow(_scored, _EDGE)
        held = stage(_top(held.withColumn("open", F.lit(False)).unionByName(scored.withColumn("open", F.lit(True))), beam), "beam")
        if not held.where("open").head(1):
            break
    all_vectors = index.classes.select("cid", "vector").unionByName(asked.select("cid", "vector"))
    exact = exact_edges(Index(all_vectors, index.members, index.graph), held.select("src", "dst", "sim"), -1.0)
    by_class = Window.partitionBy("cid").orderBy("item")
    heads = index.members.withColumn("r", F.row_number().over(by_class)).where(F.col("r") <= k + 1).drop("r")
    named = exact.join(asked.select(F.col("cid").alias("src"), F.col("item").alias("query")), "src").join(heads.withColumnRenamed("cid", "dst"), "dst").where(F.col("item") != F.col("query"))
    by = Window.partitionBy("query").orderBy(F.desc("sim"), "item")
    return named.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query", "item", F.col("sim").alias("cosine"), "rank")
