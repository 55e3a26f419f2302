"""Scored paths from seeds through the graph, at most a few hops."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.skew import join_salted
from ..plans.stage import stage
from .graph import Graph, capped_edges, capped_links

#: Fixed value: what a path loses at every edge, and what a candidate loses for every hop it is away.
DECAY = 0.5
STEP = math.exp(-DECAY)


@dataclass(frozen=True)
class Expansion:
    hops: int = 2
    nodes_per_hop: int = 500
    neighbours: int = 100
    candidates_per_node: int = 100
    paths_per_candidate: int = 3
    graph_candidates: int = 1000
    aggregation: str = "max"


def candidate_node(c: Column) -> Column:
    return F.concat(F.lit("candidate::"), c)


def _weight(w: str) -> Column:
    return F.greatest(F.lit(0.0), F.col(w))


def _best(rows: DataFrame) -> DataFrame:
    """Best path of every (query, node): highest score, then first in order."""
    first = F.min_by(F.struct("score", "path", "relations"), F.struct(-F.col("score"), "o1", "o2"))
    return rows.groupBy("query_id", "node").agg(first.alias("b")).select("query_id", "node", "b.*")


def _frontier(rows: DataFrame, limit: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    return rows.withColumn("f", F.row_number().over(by)).where(F.col("f") <= limit)


def start(found: DataFrame, graph: Graph) -> DataFrame:
    """Best path to each node that a seed is linked to (query_id, node, score, path, relations).

    ``found`` is a stage.  A candidate that is a seed of very many queries is spread over all tasks.
    """
    by = Window.partitionBy("candidate_id").orderBy(F.desc("weight"), "node_id", "relation")
    links = graph.links.withColumn("place", F.row_number().over(by)).withColumnRenamed("candidate_id", "target")
    c = join_salted(links, found.where("kind = 'candidate'"), "target", "query_id")
    c = c.select("query_id", F.col("node_id").alias("node"), (F.col("score") * _weight("weight")).alias("score"), F.array(candidate_node(F.col("target")), "node_id").alias("path"), F.array("relation").alias("relations"), F.col("pos").alias("o1"), F.col("place").alias("o2"))
    n = found.where("kind = 'node'").select("query_id", F.col("target").alias("node"), "score", F.array("target").alias("path"), F.array().cast("array<string>").alias("relations"), F.col("pos").alias("o1"), F.lit(0).alias("o2"))
    return _best(c.unionByName(n))


def _steps(front: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges of the nodes that are expanded.  A node that is in most frontiers is spread over all tasks."""
    ways = edges.select(F.col("source").alias("node"), F.col("target").alias("_n"), F.col("relation").alias("_r"), "weight", "place")
    return join_salted(ways, front.select("query_id", "node", "score", "f"), "node", "query_id")


def _level(front: DataFrame, best: DataFrame, edges: DataFrame) -> DataFrame:
    """(query_id, node, _s, f, _r): best new score of each node that improves, all steps seeing the scores as they were."""
    steps = _steps(front, edges).select("query_id", F.col("_n").alias("node"), (F.col("score") * F.lit(STEP) * _weight("weight")).alias("score"), "f", "place", "_r")
    # Scores first, by partial aggregation; the step that it came from is looked up in the same pass.
    first = F.max_by(F.struct("f", "_r"), F.struct("score", -F.col("f"), -F.col("place")))
    new = steps.groupBy("query_id", "node").agg(F.max("score").alias("_s"), first.alias("_b")).select("query_id", "node", "_s", "_b.*")
    return new.join(best, ["query_id", "node"], "left").where(F.col("score").isNull() | (F.col("_s") > F.col("score"))).select("query_id", "node", "_s", "f", "_r")


def frontiers(found: DataFrame, graph: Graph, e: Expansion, in_order: bool = False) -> DataFrame:
    """Nodes that are expanded at each depth, with the best path to each (query_id, node, score, path, relations, depth).

    Level by level: every hop sees the paths as they were when it began.  ``in_order``: a path that was improved earlier
    in the same hop is already used by later nodes; a query's hop is then one task's work, of at most ``nodes_per_hop``
    nodes and ``neighbours`` edges each.  A query has at most ``nodes_per_hop`` rows a depth, so this is the small table
    from which scores and, for chosen candidates only, paths are made.
    """
    edges = stage(capped_edges(graph.edges, e.neighbours), "capped_edges")
    first = stage(start(found, graph), "best")  # each hop's table is read several times by the next: it is written once
    front = stage(_frontier(first, e.nodes_per_hop), "frontier")
    best, out, visited = first.select("query_id", "node", "score"), front.withColumn("depth", F.lit(0)), front.select("query_id", "node")
    for d in range(e.hops):
        if in_order:
            have = best.withColumnRenamed("node", "_n").withColumnRenamed("score", "have")
            steps = _steps(front, edges).select("query_id", "f", "_n", "_r", "weight", "place").join(have, ["query_id", "_n"], "left")
            up = front.select("query_id", "f", "node", "score", "path", "relations").groupBy("query_id").cogroup(steps.groupBy("query_id")).applyInPandas(_hop, _UP)
        else:
            # A step carries the place of the node it comes from, not its path: only nodes that are expanded get one.
            up = _level(front, best, edges)
        up = stage(up, "improved")
        score = F.coalesce("_s", "score").alias("score")
        best = stage(best.join(up.select("query_id", "node", "_s"), ["query_id", "node"], "full_outer").select("query_id", "node", score), "best") if d + 1 < e.hops else best
        new = _frontier(up.withColumnRenamed("_s", "score").withColumnRenamed("f", "_from").join(visited, ["query_id", "node"], "left_anti"), e.nodes_per_hop)
        if not in_order:
            before = front.select("query_id", F.col("f").alias("_from"), "path", "relations")
            new = new.join(before, ["query_id", "_from"]).withColumn("path", F.concat("path", F.array("node"))).withColumn("relations", F.concat("relations", F.array("_r")))
        front = stage(new.select("query_id", "node", "score", "path", "relations", "f"), "frontier")
        visited = visited.unionByName(front.select("query_id", "node"))
        out = out.unionByName(front.withColumn("depth", F.lit(d + 1)))
    return out.drop("f")


def emitted(fronts: DataFrame, graph: Graph, e: Expansion) -> DataFrame:
    """All paths of expanded nodes on to candidates; where only scores are used, the paths are never put together.

    ``fronts`` is a stage; a node that is in most frontiers is spread over all tasks.
    """
    links = capped_links(graph.links, e.candidates_per_node).select(F.col("node_id").alias("node"), "candidate_id", F.col("relation").alias("_r"), "weight")
    out = join_salted(links, fronts, "node", "query_id")
    decay = F.element_at(F.array(*(F.lit(math.exp(-DECAY * (d + 1))) for d in range(e.hops + 1))), F.col("depth") + 1)
    score = F.col("score") * decay * _weight("weight")
    return out.select("query_id", "candidate_id", score.alias("score"), F.concat("path", F.array(candidate_node(F.col("candidate_id")))).alias("path"), F.concat("relations", F.array("_r")).alias("relations"))


def emissions(found: DataFrame, graph: Graph, e: Expansion, in_order: bool = False) -> DataFrame:
    return emitted(stage(frontiers(found, graph, e, in_order), "frontiers"), graph, e)


def best_paths(rows: DataFrame, limit: int) -> DataFrame:
    """The best ``limit`` paths of every (query, candidate): by -score, then nodes (then relations)."""
    by = Window.partitionBy("query_id", "candidate_id").orderBy(F.desc("score"), "path", "relations")
    return rows.withColumn("path_rank", F.row_number().over(by)).where(F.col("path_rank") <= limit)


def graph_scores(rows: DataFrame, aggregation: str, limit: int) -> DataFrame:
    """(query_id, candidate_id, graph_score, best): ``max``, ``sum`` (at most 1) or ``noisy_or`` of the ``limit`` best scores.

    Needs no paths.  ``max`` is aggregated before the exchange.
    """
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    if aggregation not in ("max", "sum", "noisy_or"):
        raise ValueError(f"unknown aggregation: {aggregation}")
    if aggregation != "max":
        by = Window.partitionBy("query_id", "candidate_id").orderBy(F.desc("score"))
        rows = rows.select("query_id", "candidate_id", "score", F.row_number().over(by).alias("_r")).where(F.col("_r") <= limit)
    if aggregation == "max":
        value = F.max(s)
    elif aggregation == "sum":
        value = F.least(F.lit(1.0), F.sum(s))
    else:  # at most ``limit`` factors, in a fixed order
        value = 1 - F.aggregate(F.array_sort(F.collect_list(s)), F.lit(1.0), lambda a, x: a * (1 - x))
    return rows.groupBy("query_id", "candidate_id").agg(value.alias("graph_score"), F.max("score").alias("best"))


# ---- The order-dependent variant --------------------------------------------------------------------------------------

_UP = "query_id string, node string, _s double, f int, path array<string>, relations array<string>"


def _hop(key: tuple, front: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """One query, one hop, node after node: a path that was improved earlier in it is already used by later nodes."""
    state = {n: (s, list(p), list(r)) for n, s, p, r in front[["node", "score", "path", "relations"]].itertuples(index=False)}
    names = dict(zip(front["f"], front["node"]))
    best = dict(zip(steps["_n"], steps["have"])) | {n: v[0] for n, v in state.items()}
    up: dict[str, tuple] = {}
    for f, m, relation, weight in steps.sort_values(["f", "place"])[["f", "_n", "_r", "weight"]].itertuples(index=False):
        score, path, relations = state[names[f]]
        s, have = score * STEP * max(0.0, weight), best.get(m)
        if have is None or have != have or s > have:
            best[m] = s
            up[m] = (s, [*path, m], [*relations, relation])
            if m in state:
                state[m] = up[m]
    return pd.DataFrame([(key[0], n, s, 0, p, r) for n, (s, p, r) in up.items()], columns=["query_id", "node", "_s", "f", "path", "relations"])


def emissions_in_order(found: DataFrame, graph: Graph, e: Expansion) -> DataFrame:
    """Paths as a walk finds them that updates best paths in place while it goes through a hop's nodes."""
    return emissions(found, graph, e, in_order=True)
