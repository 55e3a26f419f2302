"""Retrieval inputs (corpus, queries, vectors, graph, judgements) from the project's tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import embed
from ..operators.corpus import paragraph_corpus
from ..operators.graph import Graph, knowledge_graph
from ..plans import files
from ..plans.stage import drop_stage, stage, together
from .tables import table

DIM, NGRAMS = 64, 2


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return paragraph_corpus(table(spark, d, "paragraphs"), "record_id")


def queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    return q.select("query_id", "text", "user_id", F.col("seed_candidate_ids").alias("seeds"), F.col("excluded_candidate_ids").alias("excluded"), F.col("allowed_candidate_ids").alias("allowed"))


def hashed(df: DataFrame, item: str, text: str) -> DataFrame:
    return embed(df, item, text, DIM, NGRAMS, "md5", double=True)


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    q = queries(spark, d)
    return hashed(q, "query_id", "text").join(q.select("query_id", "excluded", "allowed"), "query_id")


def corpus_vectors(spark: SparkSession, d: str) -> DataFrame:
    return hashed(corpus(spark, d).select("candidate_id", F.concat_ws("\n", "title", "text").alias("t")), "candidate_id", "t")


def named_seeds(spark: SparkSession, d: str) -> DataFrame:
    return queries(spark, d).select("query_id", F.posexplode("seeds").alias("pos", "candidate_id"))


def kg_records(spark: SparkSession, d: str) -> DataFrame:
    """One extraction record a paragraph: its entities in id order, each related to the next."""
    pairs = table(spark, d, "entity_to_paragraphs").select("entity_id", "paragraph_id").where("entity_id is not null and paragraph_id is not null").distinct()
    described = pairs.join(table(spark, d, "entities").select("entity_id", "entity_type", "description"), "entity_id", "left")
    by = Window.partitionBy("paragraph_id").orderBy("entity_id")
    rows = described.withColumn("next", F.lead("entity_id").over(by))
    entity = F.struct(F.col("entity_id").alias("entity_name"), "entity_type", "description")
    relation = F.when(F.col("next").isNotNull(), F.struct(F.col("entity_id").alias("src_id"), F.col("next").alias("tgt_id"), F.lit("next_to").alias("keywords"), F.lit(None).cast("string").alias("description")))
    out = rows.groupBy("paragraph_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"), F.array_sort(F.collect_list(relation)).alias("relationships"))
    return out.select(F.col("paragraph_id").alias("id"), F.lit(None).cast("string").alias("title"), "entities", "relationships", F.col("paragraph_id").alias("seq"))


def graph(spark: SparkSession, d: str) -> Graph:
    return knowledge_graph(kg_records(spark, d), corpus(spark, d), "seq")


def judgements(spark: SparkSession, d: str) -> DataFrame:
    """(query_id, candidate_id): paragraphs whose title is a supporting title of the question."""
    titles = table(spark, d, "hotpot_tiny").where("id is not null").select(F.col("id").alias("query_id"), F.explode("supporting_facts.title").alias("title")).distinct()
    return titles.join(corpus(spark, d).select("candidate_id", "title"), "title").select("query_id", "candidate_id").distinct()


def ranking(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each query by their best semantic score (pairs without one are left out), ranked from 1."""
    g = table(spark, d, "generated_candidates").where("semantic_score is not null and not isnan(semantic_score)")
    g = g.groupBy("query_id", "candidate_id").agg(F.max("semantic_score").alias("score"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "candidate_id")))


@dataclass
class Inputs:
    queries: DataFrame
    vectors: DataFrame
    corpus: DataFrame
    corpus_vectors: DataFrame
    graph: Graph
    held: dict = field(default_factory=dict)  # by caps: what the tasks of a retrieval hold


_prepared: dict[tuple, Inputs] = {}


def inputs(spark: SparkSession, d: str) -> Inputs:
    """Corpus, vectors and graph of a folder, written once in a session: they are the assets of a retrieval, which its
    queries share.  A folder whose files change is prepared anew."""
    key = (spark.sparkContext.applicationId, d, *files.listing(spark, d))
    if key not in _prepared:
        c = stage(corpus(spark, d), "corpus")
        records = stage(kg_records(spark, d), "records")
        g = knowledge_graph(records, c, "seq")
        v = hashed(c.select("candidate_id", F.concat_ws("\n", "title", "text").alias("t")), "candidate_id", "t")
        parts = {"graph_nodes": g.nodes, "graph_links": g.links, "graph_edges": g.edges, "query_vectors": query_vectors(spark, d), "corpus_vectors": v}
        nodes, links, edges, q, v = together(lambda n: stage(parts[n], n), list(parts))
        drop_stage(records)
        _prepared[key] = Inputs(queries(spark, d), q, c, v, Graph(nodes, links, edges))
    return _prepared[key]
