"""Splits of a retrieval protocol, and what they may not contain."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans import files

PROTOCOLS = {"development": ("train", "validation"), "test": ("test",)}


def select(protocol: str, split: str, parts: dict[str, DataFrame], forbidden: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Instances of a split (``all``: those of the protocol, train before validation), without forbidden queries.

    parts: split to (query_id, seq, ...).  ``limit`` counts what is left, in order.
    """
    if protocol not in PROTOCOLS:
        raise ValueError(f"unknown protocol: {protocol}")
    if split not in ("all", "train", "validation", "test"):
        raise ValueError(f"unknown split: {split}")
    names = [s for s in PROTOCOLS[protocol] if split in ("all", s)]
    out = None
    for i, s in enumerate(names):
        rows = parts[s].withColumn("split", F.lit(s)).withColumn("split_at", F.lit(i))
        if forbidden is not None and s != "test":
            rows = rows.join(forbidden.select("query_id").distinct(), "query_id", "left_anti")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"{protocol} has no split {split}")
    return out if limit is None else out.orderBy("split_at", "seq").limit(limit)


def forbidden_ids(*parts: DataFrame | None) -> DataFrame | None:
    """Distinct query ids of all parts (validation queries belong to them as well as test queries)."""
    out = None
    for p in parts:
        if p is not None:
            ids = p.select(F.col("query_id").cast("string").alias("query_id")).where("query_id <> ''")
            out = ids if out is None else out.unionByName(ids)
    return None if out is None else out.distinct()


def require_positives(queries: DataFrame, positives: DataFrame) -> None:
    """A test protocol needs a positive for every query."""
    bare = queries.select("query_id").distinct().join(positives.select("query_id").distinct(), "query_id", "left_anti").limit(1).collect()
    if bare:
        raise ValueError(f"query without a positive: {bare[0][0]}")


def enrichment_gate(spark: SparkSession, paths: list[str], required: bool) -> list[str]:
    """Enrichment files that are there; a missing one is an error only where enrichment is required."""
    there = [p for p in paths if files.exists(spark, p)]
    if required and len(there) < len(paths):
        raise FileNotFoundError(f"missing enrichment: {sorted(set(paths) - set(there))}")
    return there


def same_queries(have: DataFrame, want: DataFrame) -> None:
    """Ids must be unique on both sides and the same, else the stage does not belong to the split."""
    for df, name in ((have, "stage"), (want, "split")):
        n, d = df.agg(F.count("*"), F.count_distinct("query_id")).first()
        if n != d:
            raise ValueError(f"{name} has repeated queries")
    odd = have.select("query_id").join(want.select("query_id"), "query_id", "left_anti").unionByName(want.select("query_id").join(have.select("query_id"), "query_id", "left_anti")).limit(1).collect()
    if odd:
        raise ValueError(f"query on one side only: {odd[0][0]}")


def same_order(have: DataFrame, want: DataFrame, at: str = "seq") -> None:
    """The same query ids at the same places, else an error that names the first place that differs."""
    by = Window.orderBy("_a")  # a list of query ids: one row each
    place = lambda df, c: df.select(F.col(at).alias("_a"), F.col("query_id").alias(c)).withColumn("_n", F.row_number().over(by)).drop("_a")
    odd = place(have, "h").join(place(want, "w"), "_n", "full_outer").where("not (h <=> w)").orderBy("_n").limit(1).collect()
    if odd:
        raise ValueError(f"place {odd[0]['_n']}: {odd[0]['h']} instead of {odd[0]['w']}")


def project(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of given queries (query_id, seq), with their places; a repeated or a missing query is an error."""
    n, distinct = ids.agg(F.count("*"), F.count_distinct("query_id")).first()
    if n != distinct:
        raise ValueError("a query is named twice")
    missing = ids.join(rows.select("query_id").distinct(), "query_id", "left_anti").limit(1).collect()
    if missing:
        raise ValueError(f"no result for query {missing[0]['query_id']}")
    return rows.join(ids.select("query_id", "seq"), "query_id")
