"""Queries on whole texts: packing, leaks and splitting (problems 8 to 10), with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .leaks import leaks
from .pack import pack_documents
from .split import split_documents

CAPACITY, SIZE, OVERLAP = 2048, 512, 64


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), "doc_id", "text", CAPACITY)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_containers(spark, d).where("piece > 0").select("doc_id").distinct()


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens in them, and the share of their room that is used."""
    each = p8_containers(spark, d).groupBy("container").agg(F.sum("size").alias("n"))
    return each.agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), (F.sum("n") / (F.count("*") * CAPACITY)).alias("used"))


def p8_sound(spark: SparkSession, d: str) -> DataFrame:
    """One row: pieces and tokens in all containers, containers above their capacity, small documents that are split."""
    c = p8_containers(spark, d)
    full = c.groupBy("container").agg(F.sum("size").alias("n")).agg(F.count_if(F.col("n") > CAPACITY).alias("overfull"))
    split = c.groupBy("doc_id").agg(F.sum("size").alias("n"), F.count("*").alias("k")).agg(F.count_if((F.col("k") > 1) & (F.col("n") <= CAPACITY)).alias("split_small"))
    total = c.agg(F.count("*").alias("pieces"), F.sum("size").alias("tokens"))
    return total.crossJoin(F.broadcast(full)).crossJoin(F.broadcast(split))  # one row each


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items of every document, with the number of the item's words that stand in it."""
    return leaks(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "words")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_documents(table(spark, d, "documents"), "doc_id", "text", SIZE, OVERLAP)


def p10_sound(spark: SparkSession, d: str) -> DataFrame:
    """Of each document: its tokens, and whether its pieces begin at 0, are in size, overlap as asked and end at the end."""
    from pyspark.sql import Window

    p = split_documents(table(spark, d, "documents"), "doc_id", "text", SIZE, OVERLAP, with_text=False)
    before = F.lag("end_token").over(Window.partitionBy("doc_id").orderBy("piece"))
    start = F.when(F.col("piece") == 0, F.lit(0)).otherwise(before - OVERLAP)
    good = (F.col("first_token") == start) & (F.col("end_token") - F.col("first_token") <= SIZE) & (F.col("end_token") > F.coalesce(before, F.lit(0)))
    return p.select("doc_id", "end_token", good.alias("good")).groupBy("doc_id").agg(F.max("end_token").alias("tokens"), F.bool_and("good").alias("sound"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = split_documents(table(spark, d, "documents"), "doc_id", "text", SIZE, OVERLAP, with_text=False)
    return pieces.where("piece = 1").select("doc_id").distinct()


_COUNTED = r"""WITH n AS (SELECT doc_id, length(text) - length(regexp_replace(text, '[\x{4e00}-\x{9fff}]', '', 'g'))
    + len(regexp_extract_all(regexp_replace(text, '[\x{4e00}-\x{9fff}]', ' ', 'g'), '[\p{L}\p{N}]{1,8}|[^\t\n\x0B\f\r \p{L}\p{N}]')) AS n FROM documents)"""

_WORDS = r"regexp_extract_all(strip_accents(lower(regexp_replace(regexp_replace(text, '<[^<>]{0,40}>', ' ', 'g'), '&[a-z]{2,6};', ' ', 'g'))), '[\p{L}\p{N}]+')"
_LEAKS = f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS w FROM eval_items),
    dw AS (SELECT DISTINCT doc_id, array_to_string(w[p + 1:p + 8], ' ') AS g FROM (SELECT *, unnest(range(len(w) - 7)) AS p FROM d)),
    iw AS (SELECT item_id, p, len(w) AS n, array_to_string(w[p + 1:p + 8], ' ') AS g FROM (SELECT *, unnest(range(len(w) - 7)) AS p FROM i)),
    c AS (SELECT doc_id, item_id, n, count(DISTINCT x) AS words FROM (SELECT doc_id, item_id, n, unnest(range(p, p + 8)) AS x FROM dw JOIN iw USING (g)) GROUP BY doc_id, item_id, n)"""

QUERIES = {"p8_found": p8_found, "p8_containers": p8_containers, "p8_fill": p8_fill, "p8_sound": p8_sound, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found, "p10_pieces": p10_pieces, "p10_sound": p10_sound}
SQL = {
    "p8_found": f"{_COUNTED} SELECT DISTINCT doc_id FROM n WHERE n > {CAPACITY}",
    "p8_sound": f"{_COUNTED} SELECT sum(greatest(1, ceil(coalesce(n, 0) / {CAPACITY})))::BIGINT AS pieces, sum(n)::BIGINT AS tokens, 0 AS overfull, 0 AS split_small FROM n",
    "p10_sound": f"{_COUNTED} SELECT doc_id, n AS tokens, true AS sound FROM n WHERE n > 0",
    "p9_found": f"{_LEAKS} SELECT doc_id, item_id FROM c WHERE words * 5 >= n * 2",
    "p9_leaks": f"{_LEAKS} SELECT doc_id, item_id, words FROM c WHERE words * 5 >= n * 2",
    "p10_found": f"{_COUNTED} SELECT DISTINCT doc_id FROM n WHERE n > {SIZE}",
}
