"""Where the expansion of a query starts: semantic hits, candidates and nodes that the query names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import unit_interval

#: Positions of named candidates and nodes come after all semantic hits, and after one another.
NAMED, NODES = 1_000_000, 2_000_000


@dataclass(frozen=True)
class SeedRules:
    """semantic_k hits; merge ``first`` keeps the semantic score of a candidate that is also named, ``max`` the larger."""

    semantic_k: int = 20
    merge: str = "first"
    use_weights: bool = False
    use_candidates: bool = True
    use_nodes: bool = False
    node_score: float = 1.0

    def __post_init__(self):
        if self.merge not in ("first", "max"):
            raise ValueError("merge must be 'first' or 'max'")

    @staticmethod
    def of(kind: str = "default", **options) -> SeedRules:
        presets = {"default": {}, "weighted_query": {"use_weights": True}, "graph_nodes": {"use_candidates": False, "use_nodes": True}}
        if kind not in presets:
            raise ValueError(f"unknown seed rules: {kind}")
        return SeedRules(**(presets[kind] | options))


def seeds(rules: SeedRules, hits: DataFrame, named: DataFrame | None = None, lookup: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """(query_id, target, kind, score, source, pos); kind is ``candidate`` or ``node``, pos the order of precedence.

    hits: query_id, candidate_id, score (cosine), rank.  named: query_id, candidate_id, pos and, where given, weight.
    lookup: query_id, candidate_id, score of the named ones (those without are left out).  nodes: query_id, node_id,
    pos and, where given, weight.  Weights are clipped to [0, 1]; of repeated ones the largest counts.
    """
    found = hits.where(F.col("rank") <= rules.semantic_k).select("query_id", F.col("candidate_id").alias("target"), unit_interval(F.col("score")).alias("s"), F.col("rank").cast("long").alias("p"))
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    out = None
    if rules.use_candidates and named is not None and lookup is not None:
        n = named if "weight" in named.columns else named.withColumn("weight", F.lit(None).cast("double"))
        n = n.groupBy("query_id", "candidate_id").agg(F.min("pos").alias("p2"), F.max(clip(F.col("weight"))).alias("w"))
        n = n.join(lookup.select("query_id", "candidate_id", "score"), ["query_id", "candidate_id"])
        own = unit_interval(F.col("score"))
        n = n.select("query_id", F.col("candidate_id").alias("target"), (F.coalesce("w", own) if rules.use_weights else own).alias("s2"), "p2")
        both = found.join(n, ["query_id", "target"], "full_outer")
        larger = F.col("s").isNotNull() & (F.col("s2") > F.col("s")) if rules.merge == "max" else F.lit(False)
        source = F.when(F.col("s").isNull(), "query").when(larger, "semantic+query").otherwise("semantic")
        out = both.select("query_id", "target", F.lit("candidate").alias("kind"), F.when(F.col("s").isNull() | larger, F.col("s2")).otherwise(F.col("s")).alias("score"), source.alias("source"), F.coalesce("p", F.col("p2") + NAMED).alias("pos"))
    else:
        out = found.select("query_id", "target", F.lit("candidate").alias("kind"), F.col("s").alias("score"), F.lit("semantic").alias("source"), F.col("p").alias("pos"))
    if rules.use_nodes and nodes is not None:
        weight = clip(F.col("weight")) if "weight" in nodes.columns else F.lit(None).cast("double")
        best = nodes.groupBy("query_id", "node_id").agg(F.max(F.coalesce(weight, F.lit(clip_value(rules.node_score)))).alias("score"), F.min("pos").alias("pos"))
        out = out.unionByName(best.select("query_id", F.col("node_id").alias("target"), F.lit("node").alias("kind"), "score", F.lit("query_node").alias("source"), (F.col("pos") + NODES).alias("pos")))
    return out


def clip_value(x: float) -> float:
    return max(0.0, min(1.0, float(x)))


def known_seeds(found: DataFrame, corpus: DataFrame) -> DataFrame:
    """Candidate seeds that the corpus has, and all node seeds."""
    ids = corpus.select(F.col("candidate_id").alias("target"))
    return found.where("kind = 'candidate'").join(ids, "target", "left_semi").unionByName(found.where("kind = 'node'"))
