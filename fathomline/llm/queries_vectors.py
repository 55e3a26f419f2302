"""Queries on vectors (problem 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.semantic import search as exact_search
from ..plans.stage import stage
from ..sources.tables import table
from .neighbours import build, clean, nearest, search


def p5_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).withColumn("cosine", F.round("cosine", 9))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return nearest(build(table(spark, d, "candidates"), "candidate_id", "embedding"), 5, 0.8)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _nearest(spark, d)
    return pairs.select(F.least("item", "other").alias("paragraph_id_a"), F.greatest("item", "other").alias("paragraph_id_b")).distinct()


def p5_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar candidates of every candidate whose id, read as a number, is divisible by 50."""
    rows = table(spark, d, "candidates")
    return search(build(rows, "candidate_id", "embedding"), rows.where(_asked_of("candidate_id")), "candidate_id", "embedding", 10)


def _asked_of(c: str) -> Column:
    number = F.conv(F.substring(c, 26, 15), 16, 10).cast("long")
    head = F.conv(F.substring(c, 1, 15), 16, 10).cast("long")
    middle = F.conv(F.substring(c, 16, 10), 16, 10).cast("long")
    # The id has 40 hexadecimal digits: 15, 10 and 15 of them.
    rest = (F.pmod(head, F.lit(50)) * (16**25 % 50) + F.pmod(middle, F.lit(50)) * (16**15 % 50) + F.pmod(number, F.lit(50))) % 50
    return rest == 0


def p5_search_recall(spark: SparkSession, d: str) -> DataFrame:
    """Queries of p5_search, and whether it finds at least nine tenths of what an exact search of all rows finds."""
    usable = stage(clean(table(spark, d, "candidates"), "candidate_id", "embedding"), "usable")
    asked = usable.where(_asked_of("item"))
    exact = exact_search(asked.select(F.col("item").alias("query_id"), "vector", F.array("item").alias("excluded")), usable.select(F.col("item").alias("candidate_id"), "vector"), 10)
    found = p5_search(spark, d).select(F.col("query").alias("query_id"), F.col("item").alias("candidate_id"), F.lit(1).alias("_hit"))
    out = exact.join(found, ["query_id", "candidate_id"], "left").agg((F.count("_hit") >= 0.9 * F.count("*")).alias("enough"))
    return asked.agg(F.count("*").alias("queries")).crossJoin(F.broadcast(out))  # one row each


_NEAR = """WITH v AS (SELECT candidate_id AS id, min(embedding)::DOUBLE[] AS e FROM candidates WHERE candidate_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY candidate_id),
    u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    s AS (SELECT a.id AS item, b.id AS other, list_dot_product(a.e, b.e) AS cosine FROM u a JOIN u b ON a.id <> b.id WHERE list_dot_product(a.e, b.e) >= 0.8),
    k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY item ORDER BY cosine DESC, other) <= 5)"""

QUERIES = {"p5_found": p5_found, "p5_neighbours": p5_neighbours, "p5_search": p5_search, "p5_search_recall": p5_search_recall}
#: The SQL is exact, the operator approximate: they are equal where no neighbour is lost.
SQL = {
    "p5_found": f"{_NEAR} SELECT DISTINCT least(item, other) AS paragraph_id_a, greatest(item, other) AS paragraph_id_b FROM k",
    "p5_search_recall": """WITH v AS (SELECT DISTINCT candidate_id AS c, len(embedding) AS n FROM candidates WHERE candidate_id IS NOT NULL AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        m AS (SELECT n FROM v GROUP BY n ORDER BY count(*) DESC, n DESC LIMIT 1)
        SELECT count(*) AS queries, true AS enough FROM (SELECT DISTINCT c FROM v JOIN m USING (n)) WHERE (('0x' || substr(c, 1, 15))::UBIGINT % 50 * 26 + ('0x' || substr(c, 16, 10))::UBIGINT % 50 * 26 + ('0x' || substr(c, 26, 15))::UBIGINT % 50) % 50 = 0""",
    "p5_neighbours": f"{_NEAR} SELECT item, other, round(cosine, 9) AS cosine FROM k",
}
