"""Candidates of a query from search and graph, one fused score, ranked, with the evidence of the chosen ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import dot, l2, unit_interval
from ..plans.stage import stage
from .expand import Expansion, graph_scores
from .graph import names_by_id
from .semantic import DIGITS, allowed_pairs, top


def weighted(semantic: Column, graph: Column, ws: float, wg: float) -> Column:
    if min(ws, wg) < 0 or ws + wg <= 0:
        raise ValueError("weights must be non-negative and sum to more than 0")
    return (semantic * F.lit(float(ws)) + graph * F.lit(float(wg))) / F.lit(float(ws + wg))


def pair_scores(pairs: DataFrame, queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """Cosine of given (query_id, candidate_id) pairs; pairs without a vector on either side have no row."""
    q = queries.select("query_id", l2(F.col("vector")).alias("_q"))
    c = corpus.select("candidate_id", l2(F.col("vector")).alias("_c"))
    return pairs.select("query_id", "candidate_id").distinct().join(c, "candidate_id").join(q, "query_id").select("query_id", "candidate_id", F.round(dot(F.col("_q"), F.col("_c")), DIGITS).alias("score"))


def pool(hits: DataFrame, emitted: DataFrame, queries: DataFrame, corpus: DataFrame, e: Expansion) -> DataFrame:
    """(query_id, candidate_id, semantic_score, graph_score, by_search, by_graph).

    The best ``graph_candidates`` by graph enter; a semantic hit beyond them keeps its graph score all the same.  What
    the query excludes or doesn't allow never enters (queries: query_id, vector, excluded, allowed).
    """
    scored = stage(graph_scores(emitted, e.aggregation, e.paths_per_candidate), "graph_scores")
    entering = top(scored, e.graph_candidates, "best", rank="_g").select("query_id", "candidate_id", F.lit(True).alias("by_graph"), "graph_score")
    found = hits.select("query_id", "candidate_id", F.lit(True).alias("by_search"), F.col("score").alias("_h")).join(entering, ["query_id", "candidate_id"], "full_outer")
    found = stage(allowed_pairs(found, queries), "pool")
    beyond = found.where("by_graph is null").drop("graph_score").join(scored.drop("best"), ["query_id", "candidate_id"], "left")
    rest = pair_scores(found.where("by_search is null"), queries, corpus).withColumnRenamed("score", "_l")
    out = found.where("by_graph is not null").unionByName(beyond).join(rest, ["query_id", "candidate_id"], "left")
    cosine = F.coalesce("_h", "_l")
    return out.where(cosine.isNotNull()).select("query_id", "candidate_id", unit_interval(cosine).alias("semantic_score"), F.coalesce("graph_score", F.lit(0.0)).alias("graph_score"), F.coalesce("by_search", F.lit(False)).alias("by_search"), F.coalesce("by_graph", F.lit(False)).alias("by_graph"))


def pool_counts(pooled: DataFrame, positives: DataFrame | None = None) -> DataFrame:
    """Pool size, semantic candidates, those from the graph only, and (given positives) the share of them in the pool."""
    out = pooled.groupBy("query_id").agg(F.count("*").alias("pool_size"), F.count_if("by_search").alias("semantic"), F.count_if(F.col("by_graph") & ~F.col("by_search")).alias("graph_only"))
    if positives is None:
        return out
    total = positives.select("query_id", "candidate_id").distinct()
    got = total.join(pooled.select("query_id", "candidate_id", F.lit(1).alias("_i")), ["query_id", "candidate_id"], "left").groupBy("query_id").agg((F.count("_i") / F.count("*")).alias("pool_recall"))
    return out.join(got, "query_id", "left").withColumn("pool_recall", F.coalesce("pool_recall", F.lit(0.0)))


def rank(pooled: DataFrame, k: int, ws: float = 0.5, wg: float = 0.5) -> DataFrame:
    """The k best by fused score (ties: smaller id), ranked from 1.  Texts and evidence are joined after this."""
    return top(pooled.withColumn("score", weighted(F.col("semantic_score"), F.col("graph_score"), ws, wg)), k)


def evidence_nodes(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """Nodes of the paths of chosen candidates, in order of first appearance: (query_id, candidate_id, place, node_id)."""
    used = paths.join(chosen.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
    at = used.select("query_id", "candidate_id", "path_rank", F.posexplode("path").alias("p", "node_id")).groupBy("query_id", "candidate_id", "node_id").agg(F.min(F.struct("path_rank", "p")).alias("o"))
    by = Window.partitionBy("query_id", "candidate_id").orderBy("o")
    return at.withColumn("place", F.row_number().over(by)).drop("o")


def evidence_edges(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of the paths of chosen candidates, each once, in order of first appearance."""
    used = paths.join(chosen.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
    n = F.size("relations")
    steps = F.arrays_zip(F.slice("path", F.lit(1), n).alias("s"), F.slice("path", F.lit(2), n).alias("t"), F.col("relations").alias("r"))
    at = used.where(n > 0).select("query_id", "candidate_id", "path_rank", F.posexplode(steps).alias("p", "x")).select("query_id", "candidate_id", "path_rank", "p", F.col("x.s").alias("source"), F.col("x.t").alias("target"), F.col("x.r").alias("relation"))
    once = at.groupBy("query_id", "candidate_id", "source", "target", "relation").agg(F.min(F.struct("path_rank", "p")).alias("o"))
    by = Window.partitionBy("query_id", "candidate_id").orderBy("o")
    return once.withColumn("place", F.row_number().over(by)).drop("o")


def listed_nodes(chosen: DataFrame) -> DataFrame:
    """``evidence_nodes`` of rows that have their paths, best first: without an exchange."""
    return chosen.select("query_id", "candidate_id", F.posexplode(F.array_distinct(F.flatten("paths"))).alias("p", "node_id")).select("query_id", "candidate_id", "node_id", (F.col("p") + 1).alias("place"))


def listed_edges(chosen: DataFrame) -> DataFrame:
    """``evidence_edges`` of rows that have their paths and relations, best first: without an exchange."""
    steps = F.transform(F.col("paths"), lambda p, i: F.transform(F.element_at("relations", i + 1), lambda r, j: F.struct(F.element_at(p, j + 1).alias("source"), F.element_at(p, j + 2).alias("target"), r.alias("relation"))))
    at = chosen.select("query_id", "candidate_id", F.posexplode(F.array_distinct(F.flatten(steps))).alias("p", "x"))
    return at.select("query_id", "candidate_id", "x.source", "x.target", "x.relation", (F.col("p") + 1).alias("place"))


COUNTS = ["node_count", "edge_count", "path_count", "best_path_hops"]


def graph_features(chosen: DataFrame, paths: DataFrame) -> DataFrame:
    """node_count, edge_count, path_count and best_path_hops of chosen candidates (0 without a path)."""
    key = ["query_id", "candidate_id"]
    n = evidence_nodes(chosen, paths).groupBy(key).agg(F.count("*").alias("node_count"))
    m = evidence_edges(chosen, paths).groupBy(key).agg(F.count("*").alias("edge_count"))
    p = paths.groupBy(key).agg(F.count("*").alias("path_count"), F.max(F.when(F.col("path_rank") == 1, F.size("path") - 1)).alias("best_path_hops"))
    out = chosen.select(*key).join(n, key, "left").join(m, key, "left").join(p, key, "left")
    return out.na.fill(0, ["node_count", "edge_count", "path_count", "best_path_hops"])


def evidence(chosen: DataFrame, paths: DataFrame, nodes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(query_id, candidate_id, evidence_nodes, evidence_edges, paths) of chosen candidates, for those to read them.

    Nodes come in the order of first appearance, with type and text: that of the graph (an unknown node is a
    ``graph_node`` named by its id), for candidates the title, or the text where there is none.  Edges count once.  A
    candidate without a path has empty lists.  Only the few nodes of chosen paths are looked up.
    """
    key, mark = ["query_id", "candidate_id"], "candidate::"
    at = evidence_nodes(chosen, paths)
    own = corpus.select(F.concat(F.lit(mark), "candidate_id").alias("node_id"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), "text", F.lit("")).alias("_own"))
    named = names_by_id(at, nodes).join(own, "node_id", "left")
    is_candidate = F.startswith("node_id", F.lit(mark))
    named = named.withColumn("node_type", F.when(is_candidate, F.lit("candidate")).otherwise(F.col("node_type"))).withColumn("text", F.when(is_candidate, F.coalesce("_own", "node_id")).otherwise(F.col("text")))
    listed = lambda df, what, out: df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct(*what).alias("x")))), lambda r: r["x"]).alias(out))
    n = listed(named, ["node_id", "node_type", "text"], "evidence_nodes")
    m = listed(evidence_edges(chosen, paths), ["source", "relation", "target"], "evidence_edges")
    p = paths.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("path_rank", "path"))), lambda r: r["path"]).alias("paths"))
    out = chosen.select(*key).join(n, key, "left").join(m, key, "left").join(p, key, "left")
    empty = {"evidence_nodes": "array<struct<node_id: string, node_type: string, text: string>>", "evidence_edges": "array<struct<source: string, relation: string, target: string>>", "paths": "array<array<string>>"}
    return out.withColumns({c: F.coalesce(c, F.from_json(F.lit("[]"), t)) for c, t in empty.items()})


def retrieval_stats(pooled: DataFrame, ranked: DataFrame, emitted: DataFrame | None = None, positives: DataFrame | None = None) -> DataFrame:
    """One row: queries, mean sizes of the pool and of its parts, paths found, and (given positives) mean recall of the
    pool and of the ranked candidates."""
    counts = pool_counts(pooled, positives)
    means = [F.count("*").alias("queries"), *(F.avg(c).alias(f"mean_{c}") for c in counts.columns if c != "query_id")]
    out = counts.agg(*means)
    if emitted is not None:
        out = out.crossJoin(F.broadcast(emitted.agg(F.count("*").alias("paths"))))  # one row each
    if positives is not None:
        total = positives.select("query_id", "candidate_id").distinct()
        got = total.join(ranked.select("query_id", "candidate_id", F.lit(1).alias("_i")), ["query_id", "candidate_id"], "left").groupBy("query_id").agg((F.count("_i") / F.count("*")).alias("r"))
        out = out.crossJoin(F.broadcast(got.agg(F.avg("r").alias("mean_ranked_recall"))))
    return out
