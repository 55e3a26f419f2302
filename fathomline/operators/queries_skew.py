"""Queries on keys that hold most of the rows (problem 4), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .accumulate import distincts, heavy_keys, value_lists


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return heavy_keys(table(spark, d, "entity_to_paragraphs"), "entity_id", "paragraph_id", 2).select("entity_id")


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    return distincts(table(spark, d, "entity_to_paragraphs"), "entity_id", "paragraph_id").counts.select("entity_id", "n_values")


def p4_lists(spark: SparkSession, d: str) -> DataFrame:
    out = value_lists(table(spark, d, "entity_to_paragraphs"), "entity_id", "paragraph_id")
    return out.select("entity_id", "list_no", "n_values", F.array_join("values", ",").alias("paragraphs"))


_PAIRS = "WITH p AS (SELECT DISTINCT entity_id, paragraph_id FROM entity_to_paragraphs WHERE entity_id IS NOT NULL AND paragraph_id IS NOT NULL)"

QUERIES = {"p4_found": p4_found, "p4_counts": p4_counts, "p4_lists": p4_lists}
SQL = {
    "p4_found": f"{_PAIRS} SELECT entity_id FROM p GROUP BY entity_id HAVING count(*) * 100 >= 2 * (SELECT count(*) FROM p)",
    "p4_counts": f"{_PAIRS} SELECT entity_id, count(*) AS n_values FROM p GROUP BY entity_id",
    "p4_lists": f"""{_PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY paragraph_id) - 1 AS pos FROM p)
        SELECT entity_id, CAST(pos // 1000 AS BIGINT) AS list_no, count(*) AS n_values, string_agg(paragraph_id, ',' ORDER BY paragraph_id) AS paragraphs
        FROM r GROUP BY entity_id, pos // 1000""",
}
