"""The retrieval plan: search, seeds, expansion, pool, ranking."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import held
from ..operators.expand import Expansion, best_paths, emissions_in_order, emitted, frontiers
from ..operators.pool import pair_scores, pool, rank, weighted
from ..operators.seeds import SeedRules, known_seeds, seeds
from ..operators.semantic import search
from ..sources.derived import Inputs, named_seeds
from .stage import stage, width


@dataclass(frozen=True)
class Retrieval:
    """Sizes of a retrieval.  Fixed values: the defaults."""

    semantic_k: int = 500
    seeds: SeedRules = SeedRules(semantic_k=20)
    expansion: Expansion = Expansion()
    top_k: int = 100
    semantic_weight: float = 0.5
    graph_weight: float = 0.5
    in_order: bool = False


@dataclass
class Found:
    inputs: Inputs
    hits: DataFrame
    seeds: DataFrame
    emitted: DataFrame | None = None
    pool: DataFrame | None = None
    ranked: DataFrame | None = None
    options: Retrieval = field(default_factory=Retrieval)

    def paths(self, chosen: DataFrame | None = None) -> DataFrame:
        """The best paths of chosen candidates (of all, if none are given).  Only these are ever put together."""
        rows = self.emitted
        if chosen is not None:
            rows = rows.join(chosen.select("query_id", "candidate_id"), ["query_id", "candidate_id"], "left_semi")
        return best_paths(rows, self.options.expansion.paths_per_candidate)


def begin(i: Inputs, named: DataFrame, r: Retrieval = Retrieval()) -> Found:
    """Hits and seeds; each is written, as several later steps read it."""
    hits = stage(search(i.vectors, i.corpus_vectors, r.semantic_k), "hits")
    lookup = pair_scores(named, i.vectors, i.corpus_vectors)
    return Found(i, hits, stage(known_seeds(seeds(r.seeds, hits, named, lookup), i.corpus), "seeds"), options=r)


def retrieve(i: Inputs, named: DataFrame, r: Retrieval = Retrieval()) -> Found:
    f = begin(i, named, r)
    if r.in_order:
        f.emitted = stage(emissions_in_order(f.seeds, i.graph, r.expansion), "emitted")
    else:
        f.emitted = emitted(stage(frontiers(f.seeds, i.graph, r.expansion), "frontiers"), i.graph, r.expansion)
    f.pool = pool(f.hits, f.emitted, i.vectors, i.corpus_vectors, r.expansion)
    f.ranked = rank(f.pool, r.top_k, r.semantic_weight, r.graph_weight)
    return f


def asked(i: Inputs, named: DataFrame) -> DataFrame:
    """Queries with a vector and the candidates they name, in order."""
    mine = named.where("candidate_id is not null").groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "candidate_id"))), lambda x: x["candidate_id"]).alias("named"))
    return i.vectors.select("query_id", F.col("vector").cast("array<double>").alias("vector"), "excluded", "allowed").join(mine, "query_id", "left")


@dataclass
class Walk:
    """A retrieval whose tasks hold corpus and graph (see ``operators/held.py``): each result is one pass over the queries."""

    inputs: Inputs
    queries: DataFrame
    held: object
    options: Retrieval

    def run(self, make, only_graph: bool = False) -> DataFrame:
        """``only_graph``: hits beyond the seeds don't count, so they aren't looked for."""
        r = self.options
        k = min(r.semantic_k, r.seeds.semantic_k) if only_graph else r.semantic_k
        return self.queries.mapInArrow(held.run(self.held, r.expansion, k, r.seeds.semantic_k, r.in_order, make), make.schema)

    def paths(self, digits: int | None = None, relations: bool = True) -> DataFrame:
        return self.run(held.Paths(self.options.expansion.paths_per_candidate, digits, relations), True)

    def scores(self, how: str, digits: int | None = None) -> DataFrame:
        return self.run(held.Scores(self.options.expansion.paths_per_candidate, how, digits), True)

    def pool(self, semantic: int | None = None, graph: int | None = None) -> DataFrame:
        return self.run(held.Pool(self.options.expansion.paths_per_candidate, (semantic, graph)))

    def counts(self) -> DataFrame:
        return self.run(held.Counts(self.options.expansion.paths_per_candidate))

    def ranked(self, paths: bool = False, model=None, k: int = 0) -> DataFrame:
        r = self.options
        weighted(F.lit(0.0), F.lit(0.0), r.semantic_weight, r.graph_weight)  # refuses weights that aren't
        return self.run(held.Ranked(r.expansion.paths_per_candidate, r.top_k, r.semantic_weight, r.graph_weight, paths, model, k))


def walk(i: Inputs, named: DataFrame, r: Retrieval = Retrieval()) -> Walk | None:
    """None where corpus and graph are too large to be held, seeds go by other rules, or a query isn't one row: joins do it then."""
    if (r.seeds.merge, r.seeds.use_weights, r.seeds.use_candidates, r.seeds.use_nodes) != ("first", False, True, False):
        return None
    key = r.expansion.candidates_per_node, r.expansion.neighbours
    if key not in i.held:
        found = held.hold(i.graph, i.corpus, i.corpus_vectors, r.expansion)
        i.held[key] = found and (i.corpus_vectors.sparkSession.sparkContext.broadcast(held.Packed(found)), found.x.shape[1])
    if i.held[key] is None:
        return None
    kept, dim = i.held[key]
    n, once = i.vectors.agg(F.count("*"), F.count_distinct("query_id")).first()
    if n != once:
        return None
    parts = max(1, min(16 * width(i.vectors.sparkSession), -(-n // held.QUERIES)))
    return Walk(i, asked(i, named).where(F.size("vector") == dim).repartition(parts, "query_id"), kept, r)


def walked(spark, folder: str, r: Retrieval = Retrieval()) -> Walk | None:
    from ..sources.derived import inputs

    return walk(inputs(spark, folder), named_seeds(spark, folder), r)


def over(spark, folder: str, r: Retrieval = Retrieval()) -> Found:
    from ..sources.derived import inputs

    return retrieve(inputs(spark, folder), named_seeds(spark, folder), r)
