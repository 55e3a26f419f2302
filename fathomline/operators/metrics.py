"""Ranking metrics, by query and as macro averages, and listwise and pointwise losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _gain(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def by_query(queries: DataFrame, ranking: DataFrame, positives: DataFrame, ks: list[int], retrieved_only: bool = False) -> DataFrame:
    """recall@k, hit@k, ndcg@k and mrr of every query; a query without positives or results has 0 everywhere.

    ranking: query_id, candidate_id, rank (from 1, to any depth).  positives: query_id, candidate_id (repeats count
    once).  With ``retrieved_only`` the positives are those in the ranking, as seen while training.
    """
    pos = positives.select("query_id", "candidate_id").distinct().withColumn("_pos", F.lit(1))
    hits = ranking.select("query_id", "candidate_id", "rank").join(pos, ["query_id", "candidate_id"])
    aggs = [F.min("rank").alias("_first"), F.count("*").alias("_got")]
    for k in ks:
        inside = F.col("rank") <= k
        aggs += [F.count_if(inside).alias(f"_n{k}"), F.sum(F.when(inside, _gain(F.col("rank"))).otherwise(F.lit(0.0))).alias(f"_g{k}")]
    got = hits.groupBy("query_id").agg(*aggs)
    total = pos.groupBy("query_id").agg(F.count("*").alias("_all"))
    out = queries.select("query_id").distinct().join(got, "query_id", "left").join(total, "query_id", "left")
    size = F.coalesce(F.col("_got" if retrieved_only else "_all"), F.lit(0))
    zero = lambda c: F.when(size > 0, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
    cols = [zero(1 / F.col("_first")).alias("mrr")]
    for k in ks:
        best = F.element_at(F.array(*(F.lit(sum(1 / math.log2(i + 2) for i in range(n))) for n in range(1, k + 1))), F.greatest(F.lit(1), F.least(F.lit(k), size)).cast("int"))
        cols += [zero(F.col(f"_n{k}") / size).alias(f"recall@{k}"), zero(F.when(F.col(f"_n{k}") > 0, 1.0).otherwise(0.0)).alias(f"hit@{k}"), zero(F.col(f"_g{k}") / best).alias(f"ndcg@{k}")]
    return out.select("query_id", *cols)


def macro(each: DataFrame) -> DataFrame:
    """Macro averages over all queries, with their number; of no queries, 0."""
    names = [c for c in each.columns if c != "query_id"]
    return each.agg(F.count("*").alias("queries"), *(F.coalesce(F.avg(F.col(f"`{c}`")), F.lit(0.0)).alias(c) for c in names))


def stages(queries: DataFrame, rankings: dict[str, DataFrame], positives: DataFrame, ks: dict[str, list[int]]) -> DataFrame:
    """(stage, metric, value) of several stages in long form."""
    out = None
    for name, ranking in rankings.items():
        row = macro(by_query(queries, ranking, positives, ks.get(name, ks.get("*", [5, 10]))))
        names = [c for c in row.columns if c != "queries"]
        pairs = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").alias("value")) for c in names))
        part = row.select(F.lit(name).alias("stage"), "queries", F.explode(pairs).alias("m")).select("stage", "queries", "m.metric", "m.value")
        out = part if out is None else out.unionByName(part)
    return out


def listwise_loss(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Softmax cross-entropy of each query with positives, its mass spread evenly over them: (query_id, loss).

    log-sum-exp is taken from the query's maximum, by aggregates only.
    """
    one = scored.groupBy("query_id").agg(F.max(score).alias("_m"), F.sum(F.when(F.col(label) > 0, 1).otherwise(0)).alias("_p"), F.sum(F.when(F.col(label) > 0, F.col(score)).otherwise(0.0)).alias("_s"))
    by = scored.join(one.where("_p > 0"), "query_id").groupBy("query_id").agg(F.first("_m").alias("_m"), F.first("_p").alias("_p"), F.first("_s").alias("_s"), F.sum(F.exp(F.col(score) - F.col("_m"))).alias("_e"))
    return by.select("query_id", (F.col("_m") + F.ln("_e") - F.col("_s") / F.col("_p")).alias("loss"))


def pointwise_loss(scored: DataFrame, score: str, label: str, positive_weight: float = 1.0) -> DataFrame:
    """Mean weighted binary cross-entropy of logits, without overflow."""
    x, y = F.col(score), F.col(label).cast("double")
    soft = lambda v: F.greatest(v, F.lit(0.0)) + F.ln(1 + F.exp(-F.abs(v)))
    return scored.agg(F.avg(F.lit(positive_weight) * y * soft(-x) + (1 - y) * soft(x)).alias("loss"), F.count("*").alias("rows"))


def softmax(scored: DataFrame, score: str) -> DataFrame:
    by = Window.partitionBy("query_id")
    e = scored.withColumn("_e", F.exp(F.col(score) - F.max(score).over(by)))
    return e.withColumn("probability", F.col("_e") / F.sum("_e").over(by)).drop("_e")
