"""Queries on ranked groups and on repeated records (problems 2, 3, 6 and 7), with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .fuse import fused_ranking, leaders
from .ledger import collapse, copies_of, read_payloads
from .overlap import overlaps, record_pairs, report
from .topn import top_n

WEIGHTS = {"semantic_score": 0.5, "graph_score": 0.5}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "generated_candidates"), "query_id", "candidate_id", "semantic_score", 10).select("query_id", "candidate_id")


def p2_top(spark: SparkSession, d: str) -> DataFrame:
    return top_n(table(spark, d, "generated_candidates"), "query_id", "candidate_id", "semantic_score", 10)


def _split_records(spark: SparkSession, d: str) -> DataFrame:
    questions = table(spark, d, "hotpot_tiny").select(F.lit("question").alias("kind"), F.col("id").alias("key"), F.col("question").alias("text"), "split", "source")
    paragraphs = table(spark, d, "paragraphs").select(F.lit("paragraph").alias("kind"), F.col("record_id").alias("key"), "text", "split", "source")
    return questions.unionByName(paragraphs)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return record_pairs(*overlaps(_split_records(spark, d)))


def p3_exact(spark: SparkSession, d: str) -> DataFrame:
    members, links = overlaps(_split_records(spark, d))
    return record_pairs(members, links.where("exact"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return report(*overlaps(_split_records(spark, d)))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = leaders(table(spark, d, "generated_candidates"), "query_id", "candidate_id", WEIGHTS, 5)
    return rows.where(F.col("graph_score") > 0).select("query_id", "candidate_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    out = fused_ranking(table(spark, d, "generated_candidates"), "query_id", "candidate_id", WEIGHTS)
    return out.select("query_id", "candidate_id", F.round("fused", 6).alias("fused"), "rank")


def _records(spark: SparkSession, d: str) -> list[DataFrame]:
    known = table(spark, d, "paragraphs").select("record_id", "title", "text")
    return [known, read_payloads(table(spark, d, "paragraph_raw"), "payload", ["record_id"], ["title", "text"])]


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    ledger, members = collapse(_records(spark, d), "record_id", ["title", "text"])
    return copies_of(ledger, members, "record_id").select(F.col("first_id").alias("record_id_a"), F.col("record_id").alias("record_id_b"))


def p7_records(spark: SparkSession, d: str) -> DataFrame:
    return collapse(_records(spark, d), "record_id", ["title", "text"])[0].select(F.col("first_id").alias("record_id"), "copies")


_BEST = "WITH b AS (SELECT query_id, candidate_id, max(semantic_score) AS semantic_score FROM generated_candidates WHERE semantic_score IS NOT NULL AND CAST(semantic_score AS VARCHAR) <> 'nan' GROUP BY ALL)"
_LN = f"({math.log(1e-9)!r}::DOUBLE)"
_LOG = "(CASE WHEN {0} > 15 THEN exp(-2 * {0}) / 2 - exp(-{0}) ELSE -ln(1 + exp(-{0})) END)"
_TOP = f"{_BEST} SELECT query_id, candidate_id, semantic_score FROM b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY semantic_score DESC, candidate_id) <= 10"
_PAIRS = """p AS (SELECT query_id, candidate_id, max(CASE WHEN CAST(semantic_score AS VARCHAR) <> 'nan' THEN semantic_score END) AS s,
    max(CASE WHEN CAST(graph_score AS VARCHAR) <> 'nan' THEN graph_score END) AS g FROM generated_candidates GROUP BY ALL)"""
_KEYS = r"""r AS (SELECT record_id, title, text FROM paragraphs UNION ALL
        SELECT record_id, payload->>'$.title', payload->>'$.text' FROM (SELECT record_id, CASE WHEN json_valid(payload) THEN payload END AS payload FROM paragraph_raw) WHERE payload IS NOT NULL),
    k AS (SELECT record_id, regexp_replace(lower(title), '[^\p{L}\p{N}]+', '', 'g') AS t, regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS x
        FROM r WHERE regexp_replace(title, '\s', '', 'g') <> '' AND regexp_replace(text, '\s', '', 'g') <> ''),
    m AS (SELECT record_id, min(record_id) OVER w AS first_id, count(*) OVER w AS copies FROM k WINDOW w AS (PARTITION BY t, x))"""

_SPLITS = r"""a AS (SELECT 'question' AS kind, id AS key, question AS text, split, source FROM hotpot_tiny UNION ALL SELECT 'paragraph', record_id, text, split, source FROM paragraphs),
    c AS (SELECT *, row_number() OVER () AS rid, CASE WHEN split = 'train' THEN 't' ELSE 'e' END AS side, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM a WHERE key IS NOT NULL AND split IN ('train', 'validation', 'test')),
    m AS (SELECT *, array_to_string(w, ' ') AS canon, len(w) AS n FROM c WHERE len(w) > 0),
    t AS (SELECT rid, kind, side, n, word, row_number() OVER (PARTITION BY rid, word) AS nth FROM (SELECT rid, kind, side, n, unnest(w) AS word FROM m)),
    o AS (SELECT e.rid AS re, t.rid AS rt, count(*) AS common FROM t e JOIN t USING (kind, word, nth) WHERE e.side = 'e' AND t.side = 't' GROUP BY e.rid, t.rid, e.n, t.n HAVING count(*) * 5 >= 4 * greatest(e.n, t.n))"""

QUERIES = {"p2_found": p2_found, "p2_top": p2_top, "p3_found": p3_found, "p3_exact": p3_exact, "p3_report": p3_report, "p6_found": p6_found, "p6_ranking": p6_ranking, "p7_found": p7_found, "p7_records": p7_records}
SQL = {
    "p2_found": f"SELECT query_id, candidate_id FROM ({_TOP})",
    "p2_top": _TOP,
    "p3_found": f"""WITH {_SPLITS} SELECT DISTINCT least(x.key, y.key) AS key_a, greatest(x.key, y.key) AS key_b FROM o JOIN m x ON x.rid = re JOIN m y ON y.rid = rt WHERE x.key <> y.key""",
    "p3_report": f"""WITH {_SPLITS}, h AS (SELECT re, bool_or(x.canon = y.canon) AS exact, bool_or(x.canon <> y.canon) AS near FROM o JOIN m x ON x.rid = re JOIN m y ON y.rid = rt GROUP BY re)
        SELECT kind, split, source, count(*) AS records, count(*) FILTER (exact) AS exact, count(*) FILTER (near) AS near FROM m LEFT JOIN h ON re = rid WHERE side = 'e' GROUP BY kind, split, source""",
    "p3_exact": rf"""WITH a AS (SELECT 'question' AS kind, id AS key, question AS text, split FROM hotpot_tiny UNION ALL SELECT 'paragraph', record_id, text, split FROM paragraphs),
        c AS (SELECT kind, key, split, trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS c FROM a),
        p AS (SELECT e.key AS e, t.key AS t FROM c e JOIN c t USING (kind, c) WHERE c <> '' AND e.split IN ('validation', 'test') AND t.split = 'train' AND e.key <> t.key)
        SELECT DISTINCT least(e, t) AS key_a, greatest(e, t) AS key_b FROM p""",
    "p6_found": f"""WITH {_PAIRS}, s AS (SELECT query_id, candidate_id FROM p WHERE s IS NOT NULL QUALIFY rank() OVER (PARTITION BY query_id ORDER BY s DESC) <= 5),
        g AS (SELECT query_id, candidate_id, g FROM p WHERE g IS NOT NULL QUALIFY rank() OVER (PARTITION BY query_id ORDER BY g DESC) <= 5)
        SELECT query_id, candidate_id FROM s JOIN g USING (query_id, candidate_id) WHERE g > 0""",
    "p6_ranking": f"""WITH {_PAIRS}, m AS (SELECT query_id, quantile_disc(s, 0.5) AS ms, quantile_disc(g, 0.5) AS mg FROM p GROUP BY query_id),
        o AS (SELECT p.*, ms, mg, abs(s - ms) AS ds, abs(g - mg) AS dg FROM p JOIN m USING (query_id)),
        d AS (SELECT query_id, quantile_disc(ds, 0.5) AS qs, quantile_disc(dg, 0.5) AS qg, avg(ds) AS vs, avg(dg) AS vg FROM o GROUP BY query_id),
        z AS (SELECT query_id, candidate_id, s, g, CASE WHEN qs > 0 THEN qs * 1.4826::DOUBLE ELSE vs * 1.2533::DOUBLE END AS cs, CASE WHEN qg > 0 THEN qg * 1.4826::DOUBLE ELSE vg * 1.2533::DOUBLE END AS cg, ms, mg FROM o JOIN d USING (query_id)),
        y AS (SELECT query_id, candidate_id, s, g, CASE WHEN cs > 0 THEN (s - ms) / cs ELSE 0 END AS zs, CASE WHEN cg > 0 THEN (g - mg) / cg ELSE 0 END AS zg FROM z),
        b AS (SELECT query_id, candidate_id, CASE WHEN s IS NULL THEN {_LN} ELSE greatest({_LN}, {_LOG.format('zs')}) END AS ls, CASE WHEN g IS NULL THEN {_LN} ELSE greatest({_LN}, {_LOG.format('zg')}) END AS lg FROM y),
        f AS (SELECT query_id, candidate_id, (0.5::DOUBLE * ls + 0.5::DOUBLE * lg) / 1.0::DOUBLE AS l FROM b)
        SELECT query_id, candidate_id, round(exp(l), 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(ln(greatest(-l, 1e-300)), 9), candidate_id) AS rank FROM f""",
    "p7_found": f"WITH {_KEYS} SELECT DISTINCT first_id AS record_id_a, record_id AS record_id_b FROM m WHERE record_id <> first_id",
    "p7_records": f"WITH {_KEYS} SELECT first_id AS record_id, any_value(copies) AS copies FROM m GROUP BY first_id",
}
