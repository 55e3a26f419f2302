"""Exact top-k search of query vectors in a corpus of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import TINY, dot, l2
from ..plans.stage import width

#: Bytes of corpus vectors that one task holds while queries stream by, and rows of them that are compared at once.
CELL_BYTES, STEP_ROWS = 64 << 20, 16_384
#: Query sets of up to so many vectors may be broadcast.
FEW = 2_000
DIGITS = 6


def _unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TINY)


def top(df: DataFrame, k: int, score: str = "score", group: str = "query_id", tie: str = "candidate_id", rank: str = "rank") -> DataFrame:
    """The k best of every group, ranked from 1: score descending, then id.  Partial limits come before the exchange."""
    by = Window.partitionBy(group).orderBy(F.desc(score), tie)
    return df.withColumn(rank, F.row_number().over(by)).where(F.col(rank) <= k)


def allowed_pairs(pairs: DataFrame, rules: DataFrame | None) -> DataFrame:
    """Leave out excluded candidates, and those not allowed where a query names what is allowed (null: anything is)."""
    if rules is None:
        return pairs
    r = rules.select("query_id", F.col("excluded").alias("_no"), F.col("allowed").alias("_yes"))
    out = pairs.join(r, "query_id", "left")
    no = F.coalesce(F.array_contains("_no", F.col("candidate_id")), F.lit(False))
    yes = F.col("_yes").isNull() | F.coalesce(F.array_contains("_yes", F.col("candidate_id")), F.lit(False))
    return out.where(~no & yes).drop("_no", "_yes")


class _Cell:
    """A part of the corpus: unit vectors, names, and the names' order for ties."""

    def __init__(self, names: list[str], x: np.ndarray):
        self.names, self.x = np.array(names), x
        self.order = np.argsort(np.argsort(self.names))
        self._at: dict[str, int] | None = None

    def at(self, ids: list[str]) -> np.ndarray:
        if self._at is None:
            self._at = {n: j for j, n in enumerate(self.names)}
        return np.array([self._at[i] for i in ids if i in self._at], np.int64)

    def best(self, q: np.ndarray, no: list, yes: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place, score) of the k best of each query; its rules are applied before they are taken."""
        rows, places, scores = [], [], []
        free = [i for i in range(len(q)) if yes[i] is None]
        gone = {i: self.at(no[i]) for i in range(len(q)) if no[i]}
        if free:
            held_s, held_p = np.zeros((len(free), 0)), np.zeros((len(free), 0), np.int64)
            for a in range(0, len(self.x), STEP_ROWS):
                s = np.round(q[free] @ self.x[a : a + STEP_ROWS].T, DIGITS)
                for r, i in enumerate(free):
                    if i in gone:
                        out = gone[i]
                        s[r, out[(out >= a) & (out < a + STEP_ROWS)] - a] = -np.inf
                both_s = np.concatenate([held_s, s], axis=1)
                both_p = np.concatenate([held_p, np.broadcast_to(np.arange(a, a + s.shape[1]), s.shape)], axis=1)
                m = min(k, both_s.shape[1])
                # Ties at the cut go by id: a little less for a later id, below the precision of the scores.
                cut = np.argpartition(-(both_s - self.order[both_p] * (10.0 ** -(DIGITS + 2) / len(self.x))), m - 1, axis=1)[:, :m]
                held_s, held_p = np.take_along_axis(both_s, cut, 1), np.take_along_axis(both_p, cut, 1)
            rows.append(np.repeat(np.array(free), held_s.shape[1]))
            places.append(held_p.ravel())
            scores.append(held_s.ravel())
        for i in range(len(q)):
            if yes[i] is not None:
                p = np.setdiff1d(self.at(yes[i]), gone.get(i, np.zeros(0, np.int64)))
                s = np.round(self.x[p] @ q[i], DIGITS)
                p = p[np.lexsort((self.order[p], -s))[:k]]
                rows.append(np.full(len(p), i))
                places.append(p)
                scores.append(np.round(self.x[p] @ q[i], DIGITS))
        row, place, score = (np.concatenate(v) if v else np.zeros(0) for v in (rows, places, scores))
        ok = score > -np.inf
        return row[ok].astype(np.int64), place[ok].astype(np.int64), score[ok]


def _cells(k: int):
    """Rows sorted by cell, the corpus before the queries: a cell's corpus is held, its queries stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, names, parts, cell = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, asks = batch.column("cell").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            ends = np.flatnonzero((np.diff(cells) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *ends], [*ends, batch.num_rows]):
                if cells[a] != cell:
                    held, names, parts, cell = None, [], [], cells[a]
                some = batch.slice(a, b - a)
                if not asks[a]:
                    names += some.column("id").to_pylist()
                    parts.append(_unit(some.column("vector")))
                    continue
                if held is None:
                    if not parts:
                        continue  # a cell without a corpus
                    held, parts = _Cell(names, np.concatenate(parts)), []
                for at in range(0, some.num_rows, 512):
                    q = some.slice(at, 512)
                    row, place, score = held.best(_unit(q.column("vector")), q.column("excluded").to_pylist(), q.column("allowed").to_pylist(), k)
                    yield pa.RecordBatch.from_arrays([q.column("id").take(pa.array(row)), pa.array(held.names[place], pa.string()), pa.array(score)], names=["query_id", "candidate_id", "score"])

    return run


def search(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """(query_id, candidate_id, score, rank): exact top-k by cosine, rounded to DIGITS places.

    queries: query_id, vector and, where given, excluded and allowed (arrays of ids; allowed null means anything).
    corpus: candidate_id, vector.  Queries and corpus are laid out as a grid: a cell holds a part of the corpus of at
    most CELL_BYTES, and a part of the queries streams by it, so no vector goes through the driver and no pair is
    written.  Each part of the corpus hands over k rows a query; there are as many parts as its size asks for, and as
    many parts of the queries as it takes to keep all tasks busy.  Vectors of another length than the corpus' commonest
    are an error of the data and left out.
    """
    spark = corpus.sparkSession
    for c in ("excluded", "allowed"):
        if c not in queries.columns:
            queries = queries.withColumn(c, F.lit(None).cast("array<string>"))
    vector = F.col("vector").cast("array<double>").alias("vector")
    asked = queries.select(F.col("query_id").cast("string").alias("id"), vector, "excluded", "allowed").where("id is not null and vector is not null")
    held = corpus.select(F.col("candidate_id").cast("string").alias("id"), vector).where("id is not null and vector is not null")
    n, dim = held.agg(F.count("*"), F.mode(F.size("vector"))).first()
    if not n:
        return spark.createDataFrame([], "query_id string, candidate_id string, score double, rank int")
    parts = -(-n * dim * 8 // CELL_BYTES)
    rows = max(1, -(-width(spark) // parts))
    asked, held = (x.where(F.size("vector") == dim) for x in (asked, held))
    place = lambda m: F.pmod(F.xxhash64("id"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    none = F.lit(None).cast("array<string>")
    left = held.select("id", "vector", none.alias("excluded"), none.alias("allowed"), F.lit(False).alias("asks"), place(parts).alias("p"), every(rows).alias("r"))
    right = asked.select("id", "vector", "excluded", "allowed", F.lit(True).alias("asks"), every(parts).alias("p"), place(rows).alias("r"))
    cell = left.unionByName(right).withColumn("cell", (F.col("p") * rows + F.col("r")).cast("long")).drop("p", "r")
    # Cells are numbered through, so ranges of their numbers are even parts.
    laid = cell.repartitionByRange(parts * rows, "cell") if parts * rows > 1 else cell.coalesce(1)
    found = laid.sortWithinPartitions("cell", "asks").mapInArrow(_cells(k), "query_id string, candidate_id string, score double")
    return top(found, k)


def search_declared(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """The same by column functions, for query sets of at most FEW vectors, which may be broadcast; else see ``search``."""
    if len(queries.limit(FEW + 1).select("query_id").collect()) > FEW:
        return search(queries, corpus, k)
    q = queries.select("query_id", l2(F.col("vector")).alias("_q"))
    c = corpus.select("candidate_id", l2(F.col("vector")).alias("_c"))
    pairs = c.join(F.broadcast(q), F.lit(True))
    return top(pairs.select("query_id", "candidate_id", F.round(dot(F.col("_q"), F.col("_c")), DIGITS).alias("score")), k)
