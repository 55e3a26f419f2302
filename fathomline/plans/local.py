"""Ranking a question's own candidates: cosine, and paths in a graph of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_entity
from ..functions.vectors import dot, l2, unit_interval
from ..operators.corpus import instances
from ..operators.graph import lexical_links
from ..operators.pool import weighted
from ..operators.semantic import DIGITS, top
from ..sources.derived import hashed
from ..sources.tables import table
from .stage import stage

#: Nodes that paths start from, hops, terms of a text, paths that are kept as evidence.
SEEDS, HOPS, TERMS, PATHS = 8, 2, 10, 3


def project_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(candidates of each question, questions) of the project's tables."""
    raw = table(spark, d, "hotpot_tiny").where("id is not null")
    rows = instances(raw).groupBy("query_id", "candidate_id").agg(F.min("pos").alias("pos"), F.min("title").alias("title"), F.min("text").alias("text"))
    return stage(rows, "instances"), raw.groupBy(F.col("id").alias("query_id")).agg(F.min_by("question", F.struct("created_at", "question")).alias("text"))


def local_rank(spark: SparkSession, d: str) -> DataFrame:
    """Every question's own candidates, ranked in the question's lexical graph."""
    rows, asked = project_rows(spark, d)
    nodes, edges = local_graph(rows)
    return local_retriever(rows, asked, (stage(nodes, "local_nodes"), stage(edges, "local_edges")), k=1_000_000)[0]


def local_graph(rows: DataFrame, records: DataFrame | None = None, lexical: bool = True, limit: int = TERMS, stop_words: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of each question's graph.

    rows: query_id, pos, candidate_id, title, text.  records: extraction records, found by the title (the first
    entity's name).  A candidate with a record mentions its entities, which its relations join where both ends are among
    them; one without is joined to its most frequent terms or, unless ``lexical``, to an entity of its own title.
    nodes: query_id, node_id, node_type, text (of a node that is added again the last one counts), at (place of the
    first).  edges: query_id, source, target, relation.
    """
    rows = rows.withColumn("_c", F.concat(F.lit("candidate::"), "candidate_id"))
    if records is not None:
        kept = records.where(F.size("entities") > 0).select(normalize_entity(F.col("entities")[0]["entity_name"]).alias("_t"), F.struct("id", "entities", "relationships").alias("_r"))
        rows = rows.withColumn("_t", normalize_entity(F.col("title"))).join(kept, "_t", "left")
        bare, known = rows.where("_r is null"), rows.where("_r is not null")
    else:
        bare, known = rows, None
    own = rows.select("query_id", F.col("_c").alias("node_id"), F.lit("candidate").alias("node_type"), "text", F.struct("pos", F.lit(-1).alias("p")).alias("at"))
    if lexical:
        texts = bare.groupBy("candidate_id").agg(F.min("text").alias("text"))
        found = bare.select("query_id", "pos", "candidate_id", "_c").join(lexical_links(texts, "candidate_id", "text", limit, stop_words), "candidate_id")
        more = found.select("query_id", "node_id", F.lit("lexical_term").alias("node_type"), F.substring_index("node_id", "::", -1).alias("text"), F.struct("pos", F.col("rank").alias("p")).alias("at"))
        edges = found.select("query_id", F.col("_c").alias("source"), F.col("node_id").alias("target"), F.lit("contains_term").alias("relation"))
    else:
        titled = bare.withColumn("node_id", F.concat(F.lit("entity::"), F.coalesce("title", "candidate_id")))
        more = titled.select("query_id", "node_id", F.lit("entity").alias("node_type"), F.coalesce("title", "candidate_id").alias("text"), F.struct("pos", F.lit(0).alias("p")).alias("at"))
        edges = titled.select("query_id", F.col("_c").alias("source"), F.col("node_id").alias("target"), F.lit("has_title").alias("relation"))
    nodes = own.unionByName(more)
    if known is not None:
        name = lambda e: F.trim(e["entity_name"])
        known = known.withColumn("_names", F.filter(F.transform("_r.entities", name), lambda n: n != ""))
        each = known.select("query_id", "pos", "_c", F.posexplode("_r.entities").alias("p", "e")).where("trim(e.entity_name) <> ''")
        text = F.trim(F.concat(F.trim("e.entity_name"), F.lit(". "), F.coalesce("e.description", F.lit(""))))
        node = F.concat(F.lit("entity::"), F.trim("e.entity_name"))
        nodes = nodes.unionByName(each.select("query_id", node.alias("node_id"), F.coalesce("e.entity_type", F.lit("entity")).alias("node_type"), text.alias("text"), F.struct("pos", "p").alias("at")))
        edges = edges.unionByName(each.select("query_id", F.col("_c").alias("source"), node.alias("target"), F.lit("mentions").alias("relation")))
        rel = known.select("query_id", "_names", F.col("_r.id").alias("_id"), F.explode("_r.relationships").alias("r"))
        start = F.when(F.col("r.src_id") == F.col("_id"), F.col("_names")[0]).otherwise(F.col("r.src_id"))
        rel = rel.withColumn("s", start).where(F.array_contains("_names", F.col("s")) & F.array_contains("_names", F.col("r.tgt_id")))
        entity = lambda c: F.concat(F.lit("entity::"), c)
        edges = edges.unionByName(rel.select("query_id", entity(F.col("s")).alias("source"), entity(F.col("r.tgt_id")).alias("target"), F.coalesce("r.keywords", F.lit("related_to")).alias("relation")))
    once = nodes.groupBy("query_id", "node_id").agg(F.max_by(F.struct("node_type", "text"), "at").alias("n"), F.min("at").alias("at"))
    return once.select("query_id", "node_id", "n.*", "at"), edges.distinct()


def local_paths(seeds: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """(query_id, source, node, path): a shortest path of at most ``most`` steps from each seed (of several the first
    in order), level by level within each question's own small graph.

    seeds: query_id, node.  edges: query_id, source, target, in either direction.
    """
    both = edges.select("query_id", "source", "target").unionByName(edges.select("query_id", F.col("target").alias("source"), F.col("source").alias("target"))).where("source <> target").distinct()
    both = stage(both, "local_edges").select("query_id", F.col("source").alias("node"), F.col("target").alias("_n"))
    found = seeds.select("query_id", F.col("node").alias("source"), "node", F.array("node").alias("path"))
    front = found
    for _ in range(most):
        step = front.join(both, ["query_id", "node"]).select("query_id", "source", F.col("_n").alias("node"), F.concat("path", F.array("_n")).alias("path"))
        step = step.groupBy("query_id", "source", "node").agg(F.min("path").alias("path"))
        front = stage(step.join(found.select("query_id", "source", "node"), ["query_id", "source", "node"], "left_anti"), "local_front")
        found = found.unionByName(front)
    return found


def local_retriever(rows: DataFrame, questions: DataFrame, graph: tuple[DataFrame, DataFrame], embedder=hashed, seeds: int = SEEDS, hops: int = HOPS, paths: int = PATHS, k: int = 100, ws: float = 0.5, wg: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(ranked, paths) of each question's own candidates.

    Seeds are the graph's nodes (no candidates) whose text is closest to the question, ties by the place in the graph; a
    candidate's graph score is that of its best path, the seed's score less exp(-(steps - 1)), of at most hops + 1
    steps.  Its ``paths`` best paths are the evidence (ties: nearer seeds first).
    """
    nodes, edges = graph
    q = embedder(questions, "query_id", "text").select("query_id", l2(F.col("vector")).alias("_q"))
    near = lambda df, key: df.join(q, "query_id").withColumn(key, unit_interval(F.round(dot(F.col("_v"), F.col("_q")), DIGITS))).drop("_v", "_q")

    def vectors(df: DataFrame) -> DataFrame:
        one = df.select("text").distinct().withColumn("_t", F.col("text"))
        return df.join(embedder(one, "text", "_t").select("text", l2(F.col("vector")).alias("_v")), "text")

    scored = near(vectors(rows.select("query_id", "candidate_id", F.coalesce("text", F.lit("")).alias("text")).distinct()), "semantic_score").groupBy("query_id", "candidate_id").agg(F.max("semantic_score").alias("semantic_score"))
    by = Window.partitionBy("query_id").orderBy(F.desc("s"), "at")
    others = nodes.where(~F.startswith("node_id", F.lit("candidate::"))).select("query_id", "node_id", "at", F.coalesce("text", F.lit("")).alias("text"))
    first = near(vectors(others), "s").withColumn("place", F.row_number().over(by)).where(F.col("place") <= seeds)
    first = stage(first.select("query_id", F.col("node_id").alias("source"), "s", "place"), "local_seeds")
    far = local_paths(first.select("query_id", F.col("source").alias("node")), edges, hops + 1)
    ends = far.where(F.startswith("node", F.lit("candidate::"))).join(first, ["query_id", "source"])
    ends = ends.select("query_id", F.substring("node", len("candidate::") + 1, 2**31 - 1).alias("candidate_id"), (F.col("s") * F.exp(-F.greatest(F.lit(0), F.size("path") - 2))).alias("score"), "path", "place")
    order = Window.partitionBy("query_id", "candidate_id").orderBy(F.desc("score"), "place")
    best = stage(ends.withColumn("path_rank", F.row_number().over(order)).where(F.col("path_rank") <= paths), "local_paths")
    out = scored.join(best.where("path_rank = 1").select("query_id", "candidate_id", F.col("score").alias("graph_score")), ["query_id", "candidate_id"], "left").withColumn("graph_score", F.coalesce("graph_score", F.lit(0.0)))
    ranked = top(out.withColumn("score", weighted(F.col("semantic_score"), F.col("graph_score"), ws, wg)), k)
    return ranked, best.drop("place").withColumn("relations", F.array().cast("array<string>"))


def local_evidence(paths: DataFrame, graph: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(query_id, candidate_id, evidence_nodes, evidence_edges) of the kept paths: nodes and undirected edges once each,
    in the order of first appearance; an edge that several relations make has the last of them in order."""
    nodes, edges = graph
    key = ["query_id", "candidate_id"]
    at = paths.select(*key, "path_rank", F.posexplode("path").alias("p", "node_id")).groupBy(*key, "node_id").agg(F.min(F.struct("path_rank", "p")).alias("o"))
    named = at.join(nodes.select("query_id", "node_id", "node_type", "text"), ["query_id", "node_id"])
    listed = lambda df, what, out: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.struct(*what).alias("x")))), lambda r: r["x"]).alias(out))
    n = F.size("path") - 1
    steps = F.arrays_zip(F.slice("path", F.lit(1), n).alias("s"), F.slice("path", F.lit(2), n).alias("t"))
    step = paths.where(n > 0).select(*key, "path_rank", F.posexplode(steps).alias("p", "x")).select(*key, F.struct("path_rank", "p").alias("o"), F.least("x.s", "x.t").alias("source"), F.greatest("x.s", "x.t").alias("target"))
    once = step.groupBy(*key, "source", "target").agg(F.min("o").alias("o"))
    kinds = edges.groupBy("query_id", F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).agg(F.max("relation").alias("relation"))
    return listed(named, ["node_id", "node_type", "text"], "evidence_nodes").join(listed(once.join(kinds, ["query_id", "source", "target"]), ["source", "relation", "target"], "evidence_edges"), key, "left")
