"""Queries on spellings of names (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .names import variants

KINDS, OTHERS = ("person", "organisation"), ("location", "work")


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    return variants(table(spark, d, "entities"), "entity_id", "name", "entity_type", KINDS, OTHERS)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    found = p1_clusters(spark, d)
    a, b = found.select("cluster", F.col("entity_id").alias("entity_id_a")), found.select("cluster", F.col("entity_id").alias("entity_id_b"))
    return a.join(b, "cluster").where("entity_id_a < entity_id_b").select("entity_id_a", "entity_id_b")


QUERIES = {"p1_found": p1_found, "p1_clusters": p1_clusters}
SQL: dict[str, str] = {}
