"""Features, labels and scores of query-candidate pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import pair_features
from .rankers import erf
from .semantic import top

NUMERIC = ["f_semantic", "f_graph", "f_score", "f_nodes", "f_edges", "f_paths", "f_hops"]


def numeric(ranked: DataFrame, graph: DataFrame) -> DataFrame:
    """Seven numbers of each ranked pair: its three scores and the scaled counts of its evidence."""
    return numbers(ranked.join(graph, ["query_id", "candidate_id"], "left").na.fill(0, ["node_count", "edge_count", "path_count", "best_path_hops"]))


def numbers(rows: DataFrame) -> DataFrame:
    return rows.select(
        "query_id", "candidate_id", "rank", F.col("semantic_score").alias("f_semantic"), F.col("graph_score").alias("f_graph"), F.col("score").alias("f_score"),
        (F.log1p("node_count") / 5).alias("f_nodes"), (F.log1p("edge_count") / 5).alias("f_edges"), (F.log1p("path_count") / 3).alias("f_paths"), (F.col("best_path_hops") / 10).alias("f_hops"),
    )


def labelled(pairs: DataFrame, positives: DataFrame) -> DataFrame:
    pos = positives.select("query_id", "candidate_id").distinct().withColumn("_y", F.lit(1.0))
    return pairs.join(pos, ["query_id", "candidate_id"], "left").withColumn("label", F.coalesce("_y", F.lit(0.0))).drop("_y")


def full(numbers: DataFrame, queries: DataFrame, corpus: DataFrame, strict: bool = False) -> DataFrame:
    """4 D + 7 features of every pair as one array; ``strict``: a candidate or query without a vector is an error, else
    it has no row."""
    how = "left" if strict else "inner"
    rows = numbers.join(corpus.select("candidate_id", F.col("vector").alias("_c")), "candidate_id", how).join(queries.select("query_id", F.col("vector").alias("_q")), "query_id", how)
    if strict:
        missing = F.raise_error(F.concat_ws(" ", F.lit("no vector for"), "query_id", F.lit("or"), "candidate_id"))
        rows = rows.withColumn("_c", F.when(F.col("_c").isNull() | F.col("_q").isNull(), missing).otherwise(F.col("_c")))
    return rows.select("query_id", "candidate_id", "rank", F.concat(pair_features(F.col("_q"), F.col("_c")), F.array(*NUMERIC)).alias("features"), F.col("f_score").alias("score"))


def padded(rows: pd.DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Features [k, D] and mask [k] of one query's rows in rank order."""
    rows = rows.sort_values("rank").head(k)
    x = np.stack(rows["features"].to_numpy())
    out, mask = np.zeros((k, x.shape[1]), np.float32), np.zeros(k, bool)
    out[: len(x)], mask[: len(x)] = x, True
    return out, mask


def epoch_order(df: DataFrame, seed: int, epoch: int) -> DataFrame:
    """Place of each query in an epoch: the same permutation for every worker, another one each epoch."""
    from ..plans.skew import ranked

    rows = df.select("query_id").distinct().withColumn("_g", F.lit(epoch)).withColumn("_h", F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.lit(epoch).cast("string"), "query_id")))
    return ranked(rows, ["_g"], [F.col("_h"), F.col("query_id")], "place").select("query_id", "place")


def write_dataset(rows: DataFrame, path: str, side: str, per_file: int = 512) -> None:
    """Features by split, a bounded number of rows a file."""
    rows.repartition(side, "query_id").sortWithinPartitions("query_id", "rank").write.mode("overwrite").partitionBy(side).option("maxRecordsPerFile", per_file).parquet(path)


# ---- Rankers ----------------------------------------------------------------------------------------------------------


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + erf(x / 2**0.5))


def layer_norm(x: np.ndarray, gain: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5) * gain + bias


class PointwiseMLP:
    """score + head(mlp(features)); with a head of zeros, as it is untrained, the order is that of the score."""

    def __init__(self, dim: int, hidden: int = 256, representation: int = 16, seed: int = 13):
        r = np.random.default_rng(seed)
        w = lambda a, b: r.standard_normal((a, b)) * (2 / a) ** 0.5
        self.w = [w(dim, hidden), w(hidden, representation)]
        self.b = [np.zeros(hidden), np.zeros(representation)]
        self.head = np.zeros(representation)

    def __call__(self, x: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = gelu(x @ self.w[0] + self.b[0])
        rep = gelu(h @ self.w[1] + self.b[1])
        return score + rep @ self.head, rep


class SetTransformer:
    """Candidates of a query attend to one another: projection, post-norm encoder layers with GELU, a linear head."""

    def __init__(self, dim: int, hidden: int = 256, heads: int = 8, layers: int = 3, feedforward: int = 1024, seed: int = 13):
        r = np.random.default_rng(seed)
        w = lambda a, b: r.standard_normal((a, b)) / a**0.5
        self.hidden, self.heads = hidden, heads
        self.inp = (w(dim, hidden), np.zeros(hidden))
        self.layers = [{"qkv": w(hidden, 3 * hidden), "out": w(hidden, hidden), "f1": w(hidden, feedforward), "f2": w(feedforward, hidden)} for _ in range(layers)]
        self.one, self.zero = np.ones(hidden), np.zeros(hidden)
        self.head = w(hidden, 1)[:, 0]

    def __call__(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        norm = lambda h: layer_norm(h, self.one, self.zero)
        h = norm(x @ self.inp[0] + self.inp[1])
        n, d = len(x), self.hidden // self.heads
        for p in self.layers:
            q, k, v = (t.reshape(n, self.heads, d).transpose(1, 0, 2) for t in np.split(h @ p["qkv"], 3, axis=1))
            s = q @ k.transpose(0, 2, 1) / d**0.5
            s[:, :, ~mask] = -np.inf
            s = np.exp(s - s.max(-1, keepdims=True))
            a = (s / s.sum(-1, keepdims=True)) @ v
            h = norm(h + a.transpose(1, 0, 2).reshape(n, -1) @ p["out"])
            h = norm(h + gelu(h @ p["f1"]) @ p["f2"])
        rep = norm(h)
        return np.where(mask, rep @ self.head, np.finfo(np.float32).min), rep


def score_points(rows: DataFrame, model: PointwiseMLP, k: int) -> DataFrame:
    """Re-rank by a pointwise model: scored in Arrow batches, no exchange before the ranking."""

    def run(batches):
        for b in batches:
            if len(b):
                s, _ = model(np.stack(b["features"].to_numpy()), b["score"].to_numpy())
                yield b[["query_id", "candidate_id"]].assign(neural_score=s)

    return top(rows.mapInPandas(run, "query_id string, candidate_id string, neural_score double"), k, "neural_score", rank="neural_rank")


def score_sets(rows: DataFrame, model: Callable, k: int, candidates: int = 100) -> DataFrame:
    """Re-rank by a model that sees a query's first ``candidates`` rows together (its masked places are padding)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        x, mask = padded(group, candidates)
        s, _ = model(x, mask)
        kept = group.sort_values("rank").head(candidates)[["query_id", "candidate_id"]]
        return kept.assign(neural_score=s[: len(kept)].astype(float))

    scored = rows.groupBy("query_id").applyInPandas(run, "query_id string, candidate_id string, neural_score double")
    return top(scored, k, "neural_score", rank="neural_rank")


def by_points(model: PointwiseMLP) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Scores of a query's rows by a pointwise model, as ``score_points`` has them."""
    return lambda x, score: model(x, score)[0]


def by_sets(model: Callable, candidates: int) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Scores of a query's rows, in rank order, by a model that sees them together, as ``score_sets`` has them."""

    def run(x: np.ndarray, _) -> np.ndarray:
        filled, mask = np.zeros((candidates, x.shape[1]), np.float32), np.arange(candidates) < len(x)
        filled[: len(x)] = x
        return model(filled, mask)[0][: len(x)].astype(float)

    return run


def _gradient(w: np.ndarray):
    """Sum of the queries' gradients of one task: a row of the features' length, whatever the number of queries."""

    def run(batches):
        total, n = np.zeros(len(w)), 0
        for b in batches:
            for rows in b["rows"]:
                x, y = np.stack([np.asarray(r["features"]) for r in rows]), np.array([r["label"] for r in rows])
                s = x @ w
                p = np.exp(s - s.max())
                total, n = total + (p / p.sum() - y / y.sum()) @ x, n + 1
        if n:
            yield pd.DataFrame({"g": [total.tolist()], "n": [n]})

    return run


def fit_listwise(rows: DataFrame, epochs: int = 50, rate: float = 0.5, decay: float = 0.01, judge: Callable[[np.ndarray], float] | None = None) -> np.ndarray:
    """Weights of a linear listwise ranker by full-batch gradient descent.

    With ``judge`` (say NDCG@10 of the validation queries) the weights of the best epoch are returned, else the last.

    rows: query_id, features, label; queries without a positive don't count.  Each epoch is one aggregation of the
    gradient over the cluster; only a vector of the features' length reaches the driver.
    """
    valid = rows.join(rows.where("label > 0").select("query_id").distinct(), "query_id", "left_semi").groupBy("query_id").agg(F.collect_list(F.struct("features", "label")).alias("rows")).persist()  # a query's top-k
    try:
        one = valid.select(F.size(F.col("rows")[0]["features"])).first()
        if one is None:
            raise ValueError("no query has a positive")
        w = np.zeros(one[0])
        best = None
        for _ in range(epochs):
            each = valid.select("rows").mapInPandas(_gradient(w), "g array<double>, n long")
            total = each.select("n", F.posexplode("g").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
            g = np.zeros(len(w))
            for r in total:
                g[r["i"]] = r["v"] / r["n"]
            w = w - rate * (g + decay * w)
            now = None if judge is None else judge(w)
            if now is not None and (best is None or now > best[0]):
                best = now, w
        return w if best is None else best[1]
    finally:
        valid.unpersist()
