"""Reordering by an outside provider, with a cache of its replies."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the only prompt version.
PROMPTS = {"v1": "Order the candidates by how well they answer the query. Reply with a JSON object {\"ranking\": [{\"candidate_id\": ..., \"score\": ...}]}."}
MAX_TEXT = 4000
REPLY = "ranking array<struct<candidate_id string, score string>>"

Provider = Callable[[dict], list[dict]]


def prompt(version: str) -> str:
    if version not in PROMPTS:
        raise ValueError(f"unknown prompt version: {version}")
    return PROMPTS[version]


def passthrough(request: dict) -> list[dict]:
    """The order as given: the first of n candidates scores n."""
    n = len(request["candidates"])
    return [{"candidate_id": c["candidate_id"], "score": str(float(n - i))} for i, c in enumerate(request["candidates"])]


def requests(ranked: DataFrame, queries: DataFrame, texts: DataFrame, provider: str, version: str = "v1", max_text: int = MAX_TEXT) -> DataFrame:
    """(query_id, request, cache_key): a query and its ranked candidates as JSON; texts are cut to ``max_text`` letters.

    The key is the SHA-256 of provider, prompt version and request, so it changes with any of them.
    """
    prompt(version)
    rows = ranked.join(texts.select("candidate_id", F.substring("text", 1, max_text).alias("text")), "candidate_id", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("rank", "candidate_id", F.coalesce("text", F.lit("")).alias("text")))), lambda x: F.struct(x["candidate_id"].alias("candidate_id"), x["text"].alias("text")))
    rows = rows.groupBy("query_id").agg(listed.alias("candidates")).join(queries.select("query_id", F.col("text").alias("query")), "query_id", "left")
    rows = rows.select("query_id", F.to_json(F.struct("candidates", "query", F.lit(version).alias("version"))).alias("request"))
    return rows.withColumn("cache_key", F.sha2(F.concat_ws("\x1f", F.lit(provider), "request"), 256))


def replies(asked: DataFrame, provider: Provider, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(replies, misses): cached replies, and those of the provider for requests that the cache lacks.

    misses (cache_key, ranking) are what a caller appends to the cache; equal requests are asked once.
    """

    def run(batches):
        for b in batches:
            yield pd.DataFrame({"cache_key": b["cache_key"], "ranking": [provider(json.loads(r)) for r in b["request"]]})

    missing = asked if cache is None else asked.join(cache.select("cache_key"), "cache_key", "left_anti")
    misses = missing.groupBy("cache_key").agg(F.first("request").alias("request")).mapInPandas(run, f"cache_key string, {REPLY}")
    known = misses if cache is None else misses.unionByName(cache.select("cache_key", "ranking"))
    return asked.select("query_id", "cache_key").join(known, "cache_key").select("query_id", "ranking"), misses


def merged(ranked: DataFrame, got: DataFrame, k: int) -> DataFrame:
    """The provider's order, then what it left out in the order before; unknown and repeated ids don't count.

    Columns: query_id, candidate_id, llm_score, llm_rank.  A missing or unreadable score becomes n - (place - 1), with n
    the candidates and the place after unknown and repeated ids are gone.
    """
    listed = got.select("query_id", F.posexplode("ranking").alias("p", "x")).select("query_id", F.col("x.candidate_id").alias("candidate_id"), F.expr("try_cast(x.score as double)").alias("s"), "p")
    once = listed.groupBy("query_id", "candidate_id").agg(F.min("p").alias("p"), F.min_by("s", "p").alias("s"))
    every = Window.partitionBy("query_id")
    rows = ranked.select("query_id", "candidate_id", "rank").withColumn("n", F.count("*").over(every)).join(once, ["query_id", "candidate_id"], "left")
    by = every.orderBy(F.col("p").asc_nulls_last(), "rank", "candidate_id")
    rows = rows.withColumn("llm_rank", F.row_number().over(by))
    score = F.when(F.col("s").isNull() | F.isnan("s"), (F.col("n") - F.col("llm_rank") + 1).cast("double")).otherwise(F.col("s"))
    return rows.where(F.col("llm_rank") <= k).select("query_id", "candidate_id", score.alias("llm_score"), "llm_rank")


def rerank(ranked: DataFrame, queries: DataFrame, texts: DataFrame, provider: Provider, name: str, k: int, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    asked = requests(ranked, queries, texts, name)
    got, misses = replies(asked, provider, cache)
    return merged(ranked, got, k), misses
