"""Queries of text functions, corpora, splits, judgements, metrics and audits, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.vectors import embed, pair_features, split_side
from ..sources.derived import DIM, NGRAMS, corpus, corpus_vectors, graph, judgements, kg_records, queries, query_vectors, ranking
from ..sources.resume import missing_shards
from ..sources.tables import table
from . import corpus as cp
from . import metrics
from .features import labelled
from .graph import citation_graph, lexical_links
from .queries_ranking import CORPUS, GRAPH, norm_sql, strip_sql, vectors_sql
from .semantic import search

# DuckDB 2.0 takes "NOT isnan(x)" for true on some Parquet files (by their statistics), so its SQL compares text.
KS = [5, 10, 20]


# ---- Text ---------------------------------------------------------------------------------------------------------


def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "paragraphs").select("record_id", tx.paragraph_id(F.col("title"), F.col("text")).alias("candidate_id"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "entities").select("entity_id", tx.normalize_entity(F.col("name")).alias("normal"))


def tokens_bigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", tx.tokens(F.col("text")).alias("w")).withColumn("b", tx.bigrams(F.col("w")))
    return rows.select("doc_id", F.size("w").alias("n_tokens"), F.size("b").alias("n_bigrams"), F.md5(F.concat_ws(" ", "w")).alias("tokens_md5"), F.md5(F.concat_ws(" ", "b")).alias("bigrams_md5"))


def lexical_terms_topk(spark: SparkSession, d: str) -> DataFrame:
    return lexical_links(table(spark, d, "documents"), "doc_id", "text")


def hash_embed_md5(spark: SparkSession, d: str) -> DataFrame:
    rows = corpus_vectors(spark, d).select("candidate_id", F.posexplode("vector").alias("b", "x"))
    return rows.where("x <> 0").select("candidate_id", "b", F.round("x", 7).alias("x"))


def hash_embed_blake2b(spark: SparkSession, d: str) -> DataFrame:
    return embed(corpus(spark, d), "candidate_id", "text", 256, NGRAMS)


# ---- Corpus -------------------------------------------------------------------------------------------------------


def corpus_dedup(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).select("candidate_id", "title", F.md5("text").alias("text_md5"), F.array_join("sources", "|").alias("sources"))


def corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return cp.corpus_stats(table(spark, d, "paragraphs"))


def metadata_fold_merge(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paragraphs").where("title is not null")
    out = cp.fold_merge(rows.withColumn("key", tx.normalize_entity(F.col("title"))), "key", "record_id", "text", ["text", "split", "source"])
    return out.select("key", F.md5("text").alias("text_md5"), "split", "source")


def question_instances(spark: SparkSession, d: str) -> DataFrame:
    return cp.instances(table(spark, d, "hotpot_tiny")).select("query_id", "pos", "candidate_id", "title", "positive")


def missing_positive_titles(spark: SparkSession, d: str) -> DataFrame:
    return cp.missing_titles(table(spark, d, "hotpot_tiny")).select("query_id", F.array_join("missing", "|").alias("missing"))


def qrels_first_wins(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generated_candidates").withColumn("seq", F.struct("ingested_at", "semantic_score"))
    got = cp.qrels(rows, "query_id", "candidate_id", F.when(~F.isnan("graph_score"), F.col("graph_score")), "seq")
    return got.select("query_id", "candidate_id", F.col("pos.ingested_at").alias("first_at"))


def kg_build_links(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).links


def kg_build_edges_bidirectional(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).edges


def kg_build_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph(spark, d).nodes.select("node_id")


def kg_records_nested(spark: SparkSession, d: str) -> DataFrame:
    return kg_records(spark, d).select("id", F.size("entities").alias("n_entities"), F.size("relationships").alias("n_relationships"))


def citation_graph_forbidden(spark: SparkSession, d: str) -> DataFrame:
    """Questions as papers that cite their seed paragraphs; those of the test split are forbidden."""
    q = queries(spark, d)
    papers = q.select(F.col("query_id").alias("paper_id"), F.when(F.col("user_id").isNotNull(), F.array("user_id")).otherwise(F.array().cast("array<string>")).alias("authors"), F.array().cast("array<string>").alias("fields"), F.col("seeds").alias("references"))
    held = q.select(F.col("query_id").alias("candidate_id")).unionByName(corpus(spark, d).select("candidate_id"))
    forbidden = table(spark, d, "hotpot_tiny").where("split = 'test'").select(F.col("id").alias("candidate_id"))
    g = citation_graph(papers, held, forbidden)
    return g.links.select(F.col("candidate_id").alias("source"), F.col("node_id").alias("target"), "relation").unionByName(g.edges.select("source", "target", "relation"))


def missing_positive_drop(spark: SparkSession, d: str) -> DataFrame:
    positives = queries(spark, d).select("query_id", F.explode("seeds").alias("candidate_id"))
    kept, dropped = cp.audited_positives(positives, table(spark, d, "candidates").select("candidate_id"))
    return kept.withColumn("kept", F.lit(True)).unionByName(dropped.withColumn("kept", F.lit(False)))


# ---- Splits, labels, metrics ----------------------------------------------------------------------------------------


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return queries(spark, d).select("query_id", split_side(13, F.col("query_id"), 0.1).alias("side"))


def source_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "hotpot_tiny").groupBy(F.col("id").alias("query_id")).agg(F.min("split").alias("side"))


def label_join(spark: SparkSession, d: str) -> DataFrame:
    return labelled(ranking(spark, d).select("query_id", "candidate_id", "rank"), judgements(spark, d))


def pair_feature_sums(spark: SparkSession, d: str) -> DataFrame:
    """Of each query and its best candidate: length and sum of the pair features, by kind."""
    q, c = query_vectors(spark, d), corpus_vectors(spark, d)
    best = search(q, c, 1)
    rows = best.join(q.select("query_id", F.col("vector").alias("q")), "query_id").join(c.select("candidate_id", F.col("vector").alias("c")), "candidate_id")
    rows = rows.select("query_id", "candidate_id", pair_features(F.col("q"), F.col("c")).alias("f"))
    part = lambda i: F.round(F.aggregate(F.slice("f", i * DIM + 1, DIM), F.lit(0.0), lambda s, x: s + x), 5)
    return rows.select("query_id", "candidate_id", F.size("f").alias("n"), *(part(i).alias(n) for i, n in enumerate(["query", "candidate", "product", "difference"])))


def _by_query(spark: SparkSession, d: str, retrieved_only: bool = False) -> DataFrame:
    return metrics.by_query(queries(spark, d), ranking(spark, d), judgements(spark, d), KS, retrieved_only)


def _metric(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        each = _by_query(spark, d)
        names = [c for c in each.columns if c.startswith(name)]
        return each.select("query_id", *(F.round(F.col(f"`{c}`"), 9).alias(c) for c in names))

    return query


def _macro(retrieved_only: bool):
    def query(spark: SparkSession, d: str) -> DataFrame:
        row = metrics.macro(_by_query(spark, d, retrieved_only))
        return row.select("queries", *(F.round(F.col(f"`{c}`"), 9).alias(c) for c in row.columns if c != "queries"))

    return query


def stage_metrics(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generated_candidates").where("graph_score is not null and not isnan(graph_score)").groupBy("query_id", "candidate_id").agg(F.max("graph_score").alias("score"))
    graded = g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")))
    out = metrics.stages(queries(spark, d), {"semantic": ranking(spark, d), "graph": graded}, judgements(spark, d), {"semantic": [5, 10], "*": [5]})
    return out.select("stage", "queries", "metric", F.round("value", 9).alias("value"))


def listwise_loss(spark: SparkSession, d: str) -> DataFrame:
    rows = labelled(ranking(spark, d), judgements(spark, d))
    return metrics.listwise_loss(rows, "score", "label").select("query_id", F.round("loss", 9).alias("loss"))


def pointwise_loss(spark: SparkSession, d: str) -> DataFrame:
    return metrics.pointwise_loss(labelled(ranking(spark, d), judgements(spark, d)), "score", "label", 2.0).select(F.round("loss", 9).alias("loss"), "rows")


def extracted_records(spark: SparkSession, d: str) -> DataFrame:
    """Records by rule of all paragraphs: number of entities and relations, and the first entity's type."""
    from .extract import by_rule, records

    rows = records(by_rule(corpus(spark, d), "candidate_id", "title", "text"))
    return rows.select("id", F.size("relationships").alias("n_relations"), F.col("entities")[0]["entity_type"].alias("first_type"), F.array_join(F.transform("entities", lambda e: e["entity_name"]), "|").alias("names"))


def epoch_places(spark: SparkSession, d: str) -> DataFrame:
    from .features import epoch_order

    return epoch_order(queries(spark, d), 13, 1)


# ---- Audits -------------------------------------------------------------------------------------------------------


def protocol_audit(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hotpot_tiny").select(F.col("id").alias("query_id"), "split")
    return cp.protocol_audit(rows, judgements(spark, d), table(spark, d, "candidates"), "split")


def protocol_positive_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Queries without a positive paragraph (a test protocol must have none)."""
    return queries(spark, d).select("query_id").distinct().join(judgements(spark, d).select("query_id").distinct(), "query_id", "left_anti")


def split_alignment_check(spark: SparkSession, d: str) -> DataFrame:
    """Query ids of a stage (generated candidates) against those of the query table: on one side only, or delivered twice."""
    want = queries(spark, d).groupBy("query_id").agg(F.count("*").alias("n_queries"))
    have = table(spark, d, "generated_candidates").select("query_id").distinct().withColumn("n_stage", F.lit(1).cast("long"))
    both = want.join(have, "query_id", "full_outer")
    return both.where("n_queries is null or n_stage is null or n_queries > 1").na.fill(0, ["n_queries", "n_stage"])


def resume_missing_shards(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose results are missing, by shard, where all results of candidates' queries are done."""
    done = table(spark, d, "generated_candidates").select("query_id").distinct()
    return missing_shards(table(spark, d, "hotpot_tiny").select(F.col("id").alias("query_id")).distinct(), done, "query_id", 16)


_TOKENS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}_''-]+')"
_OR_EMPTY = "coalesce({}, '')"
_STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
_QRELS = f"""{CORPUS}, ht AS (SELECT DISTINCT id AS query_id, unnest(supporting_facts.title) AS title FROM hotpot_tiny WHERE id IS NOT NULL),
    firsts AS (SELECT candidate_id, arg_min(title, record_id) AS title FROM ck GROUP BY candidate_id), qrels AS (SELECT DISTINCT query_id, candidate_id FROM ht JOIN firsts USING (title))"""
_RANKING = """best AS (SELECT query_id, candidate_id, max(semantic_score) AS score FROM generated_candidates WHERE semantic_score IS NOT NULL AND CAST(semantic_score AS VARCHAR) <> 'nan' GROUP BY ALL),
    ranking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM best)"""


def metrics_sql(ranking_name: str = "ranking", retrieved_only: bool = False, ks: list[int] = KS, p: str = "") -> str:
    size = "coalesce(got, 0)" if retrieved_only else "coalesce(total, 0)"
    sums = ", ".join(f"count(*) FILTER (rank <= {k}) AS n{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS g{k}" for k in ks)
    outs = ", ".join(f"""CASE WHEN {size} > 0 THEN coalesce(n{k}, 0) / {size} ELSE 0 END AS "recall@{k}", CASE WHEN {size} > 0 AND n{k} > 0 THEN 1.0::DOUBLE ELSE 0 END AS "hit@{k}",
        CASE WHEN {size} > 0 THEN coalesce(g{k}, 0) / list_sum(list_transform(range(1, least({k}, {size}) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END AS "ndcg@{k}\"""" for k in ks)
    return f"""{p}hit AS (SELECT r.query_id, rank FROM {ranking_name} r JOIN qrels USING (query_id, candidate_id)),
    {p}agg AS (SELECT query_id, min(rank) AS first, count(*) AS got, {sums} FROM {p}hit GROUP BY query_id), {p}tot AS (SELECT query_id, count(*) AS total FROM qrels GROUP BY query_id),
    {p}each_ AS (SELECT query_id, CASE WHEN {size} > 0 THEN coalesce(1 / first, 0) ELSE 0 END AS mrr, {outs} FROM (SELECT DISTINCT query_id FROM queries) LEFT JOIN {p}agg USING (query_id) LEFT JOIN {p}tot USING (query_id))"""


def _rounded(names: list[str], how: str = "{}") -> str:
    return ", ".join(f'round({how.format(chr(34) + n + chr(34))}, 9) AS "{n}"' for n in names)


_NAMES = {m: [f"{m}@{k}" for k in KS] for m in ("recall", "hit", "ndcg")}
_EVERY = ["mrr", *(n for k in KS for n in (f"recall@{k}", f"hit@{k}", f"ndcg@{k}"))]
_LABELS = f"WITH {_QRELS}, {_RANKING}, lab AS (SELECT r.*, CASE WHEN q.query_id IS NULL THEN 0.0::DOUBLE ELSE 1 END AS label FROM ranking r LEFT JOIN qrels q USING (query_id, candidate_id))"
_SOFT = "greatest({0}, 0) + ln(1 + exp(-abs({0})))"
_LONG = " UNION ALL ".join(f"SELECT '{s}' AS stage, count(*) AS queries, '{m}' AS metric, round(coalesce(avg(\"{m}\"), 0), 9) AS value FROM {p}each_" for s, p, ms in (("semantic", "", ["mrr", *(f"{x}@{k}" for k in (5, 10) for x in ("recall", "hit", "ndcg"))]), ("graph", "g", ["mrr", "recall@5", "hit@5", "ndcg@5"])) for m in ms)

QUERIES = {
    "stable_ids": stable_ids,
    "normalize_text": normalize_text,
    "tokens_bigrams": tokens_bigrams,
    "lexical_terms_topk": lexical_terms_topk,
    "hash_embed_md5": hash_embed_md5,
    "hash_embed_blake2b": hash_embed_blake2b,
    "corpus_dedup": corpus_dedup,
    "corpus_stats": corpus_stats,
    "metadata_fold_merge": metadata_fold_merge,
    "question_instances": question_instances,
    "missing_positive_titles": missing_positive_titles,
    "qrels_first_wins": qrels_first_wins,
    "kg_build_links": kg_build_links,
    "kg_build_edges_bidirectional": kg_build_edges_bidirectional,
    "kg_build_nodes": kg_build_nodes,
    "kg_records_nested": kg_records_nested,
    "citation_graph_forbidden": citation_graph_forbidden,
    "missing_positive_drop": missing_positive_drop,
    "hash_split": hash_split,
    "source_split": source_split,
    "label_join": label_join,
    "pair_features": pair_feature_sums,
    "recall_at_k": _metric("recall"),
    "hit_at_k": _metric("hit"),
    "ndcg_at_k": _metric("ndcg"),
    "mrr": _metric("mrr"),
    "macro_metrics": _macro(False),
    "train_metrics": _macro(True),
    "stage_metrics": stage_metrics,
    "listwise_loss": listwise_loss,
    "pointwise_loss": pointwise_loss,
    "extracted_records": extracted_records,
    "epoch_places": epoch_places,
    "protocol_audit": protocol_audit,
    "protocol_positive_coverage": protocol_positive_coverage,
    "split_alignment_check": split_alignment_check,
    "resume_missing_shards": resume_missing_shards,
}
SQL = {
    "stable_ids": f"SELECT record_id, sha1({strip_sql(_OR_EMPTY.format('title'))} || chr(10) || {strip_sql(_OR_EMPTY.format('text'))}) AS candidate_id FROM paragraphs",
    "normalize_text": f"SELECT entity_id, {norm_sql('name')} AS normal FROM entities",
    "tokens_bigrams": f"""WITH t AS (SELECT doc_id, {_TOKENS} AS w FROM documents), b AS (SELECT *, list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1]) AS b FROM t)
        SELECT doc_id, len(w) AS n_tokens, len(b) AS n_bigrams, md5(array_to_string(w, ' ')) AS tokens_md5, md5(array_to_string(b, ' ')) AS bigrams_md5 FROM b""",
    "lexical_terms_topk": f"""WITH t AS (SELECT doc_id AS candidate_id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]{{3,}}'))) AS term FROM documents),
        c AS (SELECT candidate_id, term, count(*) AS tf FROM t WHERE term NOT IN ({_STOP}) GROUP BY ALL)
        SELECT candidate_id, 'lexical::' || term AS node_id, tf, row_number() OVER (PARTITION BY candidate_id ORDER BY tf DESC, term) AS rank FROM c QUALIFY rank <= 10""",
    "hash_embed_md5": f"WITH {CORPUS}, {vectors_sql('cv', 'SELECT candidate_id AS id, title || chr(10) || text AS text FROM corpus')} SELECT id AS candidate_id, b, round(x, 7) AS x FROM cv",
    "corpus_dedup": f"""WITH {CORPUS}, s AS (SELECT candidate_id, record_id, i, sources[i + 1] AS source FROM (SELECT *, unnest(range(len(sources))) AS i FROM ck)),
        f AS (SELECT candidate_id, source, min(struct_pack(r := record_id, i := i)) AS o FROM s GROUP BY ALL), l AS (SELECT candidate_id, string_agg(source, '|' ORDER BY o) AS sources FROM f GROUP BY candidate_id)
        SELECT candidate_id, title, md5(text) AS text_md5, coalesce(sources, '') AS sources FROM corpus LEFT JOIN l USING (candidate_id)""",
    "corpus_stats": f"""WITH k AS (SELECT {strip_sql('title')} AS t, {strip_sql('text')} AS x FROM paragraphs), i AS (SELECT CASE WHEN t <> '' AND x <> '' THEN sha1(t || chr(10) || x) END AS id FROM k)
        SELECT count(*) AS input_records, count(DISTINCT id) AS paragraphs, count(*) - count(id) AS blank, count(*) - count(DISTINCT id) AS duplicates_removed FROM i""",
    "metadata_fold_merge": f"""WITH k AS (SELECT {norm_sql('title')} AS key, record_id, text, split, source, coalesce(length(text), 0) AS n FROM paragraphs WHERE title IS NOT NULL),
        m AS (SELECT *, max(n) OVER (PARTITION BY key ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM k)
        SELECT key, md5(arg_max(text, record_id) FILTER (text IS NOT NULL)) AS text_md5, arg_max(split, record_id) FILTER (split IS NOT NULL) AS split, arg_max(source, record_id) FILTER (source IS NOT NULL) AS source FROM m WHERE most IS NULL OR n > most GROUP BY key""",
    "question_instances": f"""WITH o AS (SELECT * FROM hotpot_tiny WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST, question NULLS FIRST) = 1),
        u AS (SELECT id AS query_id, i AS pos, context.title[i + 1] AS title, {strip_sql("array_to_string(context.sentences[i + 1], chr(10))")} AS text, supporting_facts.title AS s FROM (SELECT *, unnest(range(least(len(context.title), len(context.sentences)))) AS i FROM o))
        SELECT query_id, pos, sha1({strip_sql('title')} || chr(10) || text) AS candidate_id, title, coalesce(list_contains(s, title), false) AS positive FROM u""",
    "missing_positive_titles": """WITH o AS (SELECT * FROM hotpot_tiny WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST, question NULLS FIRST) = 1),
        m AS (SELECT id AS query_id, list_sort(list_distinct(list_filter(supporting_facts.title, lambda t: NOT list_contains(context.title, t)))) AS m FROM o) SELECT query_id, array_to_string(m, '|') AS missing FROM m WHERE len(m) > 0""",
    "qrels_first_wins": "SELECT query_id, candidate_id, min(ingested_at) AS first_at FROM generated_candidates WHERE graph_score > 0 AND CAST(graph_score AS VARCHAR) <> 'nan' GROUP BY ALL",
    "kg_build_links": f"WITH {CORPUS}, {GRAPH} SELECT candidate_id, node_id, relation, weight FROM links",
    "kg_build_edges_bidirectional": f"WITH {CORPUS}, {GRAPH} SELECT source, target, relation, paragraph_id, 1::DOUBLE AS weight FROM edges",
    "kg_build_nodes": f"WITH {CORPUS}, {GRAPH} SELECT DISTINCT node_id FROM links",
    "kg_records_nested": "SELECT paragraph_id AS id, count(DISTINCT entity_id) AS n_entities, count(DISTINCT entity_id) - 1 AS n_relationships FROM entity_to_paragraphs WHERE entity_id IS NOT NULL GROUP BY paragraph_id",
    "citation_graph_forbidden": f"""WITH {CORPUS}, held AS (SELECT query_id AS c FROM queries UNION SELECT candidate_id FROM corpus), refs AS (SELECT DISTINCT query_id AS s, t FROM (SELECT query_id, unnest(seed_candidate_ids) AS t FROM queries)
            WHERE t IN (SELECT c FROM held) AND t <> query_id AND query_id NOT IN (SELECT id FROM hotpot_tiny WHERE split = 'test'))
        SELECT c AS source, 'candidate::' || c AS target, 'represents' AS relation FROM held UNION ALL SELECT DISTINCT query_id, 'author::' || trim(user_id), 'authored_by' FROM queries WHERE trim(user_id) <> ''
        UNION ALL SELECT 'candidate::' || s, 'candidate::' || t, 'cites' FROM refs UNION ALL SELECT 'candidate::' || t, 'candidate::' || s, 'cited_by' FROM refs""",
    "missing_positive_drop": "SELECT query_id, candidate_id, candidate_id IN (SELECT candidate_id FROM candidates) AS kept FROM (SELECT query_id, unnest(seed_candidate_ids) AS candidate_id FROM queries)",
    "hash_split": "SELECT query_id, CASE WHEN ('0x' || substr(sha1('13:' || query_id), 1, 16))::UBIGINT < 1844674407370955161 THEN 'validation' ELSE 'train' END AS side FROM queries",
    "source_split": "SELECT id AS query_id, min(split) AS side FROM hotpot_tiny GROUP BY id",
    "label_join": f"{_LABELS} SELECT query_id, candidate_id, rank, label FROM lab",
    **{f"{m}_at_k": f"WITH {_QRELS}, {_RANKING}, {metrics_sql()} SELECT query_id, {_rounded(_NAMES[m])} FROM each_" for m in ("recall", "hit", "ndcg")},
    "mrr": f"WITH {_QRELS}, {_RANKING}, {metrics_sql()} SELECT query_id, {_rounded(['mrr'])} FROM each_",
    "macro_metrics": f"WITH {_QRELS}, {_RANKING}, {metrics_sql()} SELECT count(*) AS queries, {_rounded(_EVERY, 'avg({})')} FROM each_",
    "train_metrics": f"WITH {_QRELS}, {_RANKING}, {metrics_sql(retrieved_only=True)} SELECT count(*) AS queries, {_rounded(_EVERY, 'avg({})')} FROM each_",
    "stage_metrics": f"""WITH {_QRELS}, {_RANKING}, gb AS (SELECT query_id, candidate_id, max(graph_score) AS score FROM generated_candidates WHERE graph_score IS NOT NULL AND CAST(graph_score AS VARCHAR) <> 'nan' GROUP BY ALL),
        granking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM gb), {metrics_sql(ks=[5, 10])}, {metrics_sql('granking', ks=[5], p='g')} {_LONG}""",
    "listwise_loss": f"""{_LABELS}, m AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS m FROM lab)
        SELECT query_id, round(any_value(m) + ln(sum(exp(score - m))) - sum(score * label) / sum(label), 9) AS loss FROM m GROUP BY query_id HAVING sum(label) > 0""",
    "pointwise_loss": f"{_LABELS} SELECT round(avg(2.0::DOUBLE * label * ({_SOFT.format('(-score)')}) + (1 - label) * ({_SOFT.format('score')})), 9) AS loss, count(*) AS rows FROM lab",
    "extracted_records": f"""WITH {CORPUS}, f AS (SELECT candidate_id AS id, title, list_distinct(regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}\\p{{N}}''-]+(?: \\p{{Lu}}[\\p{{L}}\\p{{N}}''-]+)+')) AS n FROM corpus),
        w AS (SELECT id, title, regexp_extract_all(text, '\\p{{Lu}}[\\p{{L}}\\p{{N}}''-]+(?: \\p{{Lu}}[\\p{{L}}\\p{{N}}''-]+)+') AS n FROM (SELECT candidate_id AS id, title, text FROM corpus)),
        e AS (SELECT id, 0 AS i, title AS name FROM w UNION ALL SELECT id, i + 1, n[i + 1] FROM (SELECT *, unnest(range(len(n))) AS i FROM w)),
        k AS (SELECT * FROM e WHERE {norm_sql('name')} <> '' QUALIFY row_number() OVER (PARTITION BY id, {norm_sql('name')} ORDER BY i) = 1)
        SELECT id, greatest(0, len(n) - 1) AS n_relations, 'document' AS first_type, names FROM f JOIN (SELECT id, string_agg(name, '|' ORDER BY i) AS names FROM k GROUP BY id) USING (id)""",
    "epoch_places": "SELECT query_id, row_number() OVER (ORDER BY md5('13:1:' || query_id), query_id) AS place FROM (SELECT DISTINCT query_id FROM queries)",
    "protocol_audit": f"""WITH {_QRELS} SELECT (SELECT count(*) FROM hotpot_tiny) AS queries, (SELECT count(DISTINCT id) FROM hotpot_tiny) AS distinct_queries, (SELECT count(*) FROM hotpot_tiny WHERE split = 'train') AS train_queries,
        (SELECT count(*) FROM qrels) AS positives, (SELECT count(*) FROM qrels WHERE candidate_id IN (SELECT candidate_id FROM candidates)) AS positives_in_corpus,
        (SELECT count(DISTINCT id) FROM hotpot_tiny WHERE id NOT IN (SELECT query_id FROM qrels)) AS queries_without_positive, (SELECT count(*) - count(DISTINCT id) FROM hotpot_tiny) AS duplicate_queries""",
    "protocol_positive_coverage": f"WITH {_QRELS} SELECT DISTINCT query_id FROM queries WHERE query_id NOT IN (SELECT query_id FROM qrels)",
    "split_alignment_check": """WITH a AS (SELECT query_id, count(*) AS n_queries FROM queries GROUP BY query_id), b AS (SELECT DISTINCT query_id, 1 AS n_stage FROM generated_candidates)
        SELECT query_id, coalesce(n_queries, 0) AS n_queries, coalesce(n_stage, 0) AS n_stage FROM a FULL JOIN b USING (query_id) WHERE n_queries IS NULL OR n_stage IS NULL OR n_queries > 1""",
    "resume_missing_shards": """WITH m AS (SELECT DISTINCT id FROM hotpot_tiny WHERE id IS NOT NULL AND id NOT IN (SELECT query_id FROM generated_candidates WHERE query_id IS NOT NULL))
        SELECT (('0x' || substr(md5(id), 1, 15))::UBIGINT % 16)::INT AS shard, count(*) AS missing FROM m GROUP BY ALL""",
    "pair_features": f"""WITH {CORPUS}, {vectors_sql('qv', 'SELECT query_id AS id, text FROM queries')}, {vectors_sql('cv', 'SELECT candidate_id AS id, title || chr(10) || text AS text FROM corpus')},
        sims AS (SELECT q.id AS query_id, c.id AS candidate_id, round(sum(q.x * c.x), 6) AS score FROM qv q JOIN cv c USING (b) GROUP BY ALL),
        best AS (SELECT s.* FROM sims s JOIN queries q USING (query_id) WHERE NOT coalesce(list_contains(excluded_candidate_ids, candidate_id), false) AND (allowed_candidate_ids IS NULL OR list_contains(allowed_candidate_ids, candidate_id))
            QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) = 1),
        f AS (SELECT query_id, candidate_id, b.b AS b, coalesce(q.x, 0) AS q, coalesce(c.x, 0) AS c FROM best CROSS JOIN (SELECT unnest(range({DIM})) AS b) b LEFT JOIN qv q ON q.id = query_id AND q.b = b.b LEFT JOIN cv c ON c.id = candidate_id AND c.b = b.b)
        SELECT query_id, candidate_id, {4 * DIM} AS n, round(sum(q), 5) AS query, round(sum(c), 5) AS candidate, round(sum(q * c), 5) AS product, round(sum(abs(q - c)), 5) AS difference FROM f GROUP BY query_id, candidate_id""",
}
