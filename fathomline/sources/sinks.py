"""Sinks: results nested once at the end, digests, shards that can be resumed, merged deliveries."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .resume import remaining, shard


def as_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_corpus(df: DataFrame, path: str) -> str:
    """Write in id order; returns a digest of the content that does not depend on how it was partitioned."""
    df.repartitionByRange("candidate_id").sortWithinPartitions("candidate_id").write.mode("overwrite").parquet(path)
    return digest(df)


def digest(df: DataFrame) -> str:
    """SHA-256 over the sums of the rows' SHA-256 digests (in four parts) and their number."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 16 * i, 16), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    return hashlib.sha256(str(tuple(df.agg(F.count("*"), *parts).first())).encode()).hexdigest()


def nested_results(ranked: DataFrame, queries: DataFrame, positives: DataFrame, stage: str) -> DataFrame:
    """One row a query: its ordered candidates as structs, its positives, and an empty list where it has no result."""
    fields = [c for c in ranked.columns if c != "query_id"]
    one = F.struct("rank", *(c for c in fields if c != "rank"))
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates"))  # a top-k: bounded
    pos = positives.groupBy("query_id").agg(F.array_sort(F.collect_set("candidate_id")).alias("positive_ids"))
    out = queries.select("query_id", F.col("text").alias("query_text")).join(lists, "query_id", "left").join(pos, "query_id", "left")
    none = F.array().cast(lists.schema["candidates"].dataType)
    out = out.withColumn("candidates", F.coalesce("candidates", none))
    return out.withColumn("positive_ids", F.coalesce("positive_ids", F.array().cast("array<string>"))).withColumn("stage", F.lit(stage)).withColumn("schema_version", F.lit(1))


def write_shards(df: DataFrame, path: str, key: str, n: int) -> None:
    """Rows in ``n`` stable shards; only the shards that ``df`` touches are replaced."""
    rows = df.withColumn("shard", shard(F.col(key), n))
    rows.repartition("shard").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def resume(spark: SparkSession, todo: DataFrame, path: str, key: str, n: int) -> DataFrame:
    """Keys whose shard is not complete yet (all of a shard's keys are done again with those that are missing)."""
    rows = todo.withColumn("shard", shard(F.col(key), n))
    try:
        done = spark.read.parquet(path)
    except Exception:  # nothing is written yet
        return rows
    return rows.join(remaining(rows, done, key).select("shard").distinct(), "shard", "left_semi")


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """Append rows whose key the output lacks; returns their number."""
    spark = df.sparkSession
    try:
        done = spark.read.parquet(path)
    except Exception:  # nothing is written yet
        done = None
    new = (df if done is None else remaining(df, done, key)).persist()
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    new.unpersist()
    return n


def merge_extractions(spark: SparkSession, pattern: str, schema: str, expected: int | None = None) -> DataFrame:
    """All delivered parts as one table; a repeated id, a record without one, or another count than expected is an error."""
    rows = spark.read.schema(schema).json(pattern)
    n, ids, nulls = rows.agg(F.count("*"), F.count_distinct("id"), F.count_if(F.col("id").isNull())).first()
    if nulls or ids != n:
        raise ValueError(f"{n} records have {ids} different ids, {nulls} have none")
    if expected is not None and n != expected:
        raise ValueError(f"{n} records, {expected} expected")
    return rows


def worker_part(df: DataFrame, key: str, index: int, count: int) -> DataFrame:
    """The part of one of ``count`` workers that run outside of Spark."""
    if not 0 <= index < count:
        raise ValueError("the index must be below the count")
    return df.where(shard(F.col(key), count) == index)
