"""A retrieval whose tasks hold corpus and graph gives the rows of the joins."""

import random
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import expand, features, held, pool
from fathomline.operators.graph import Graph
from fathomline.operators.seeds import SeedRules
from fathomline.plans import retrieve
from fathomline.plans.retrieve import Retrieval
from fathomline.sources.derived import Inputs


def case(spark, seed, equal=False):
    """A corpus, queries with rules and a graph with weights of all kinds (some make ties at 0), relations and a node that is called as a candidate is."""
    r, g = random.Random(seed), np.random.default_rng(seed)
    frame = spark.createDataFrame
    cands, nodes = [f"c{i:02d}" for i in range(40)], [*(f"n{i}" for i in range(25)), "candidate::c03", "zz"]
    corpus = frame([(c, f"text {c}") for c in cands], "candidate_id string, text string")
    vectors = [(c, (g.standard_normal(6) if i % 9 else np.ones(6)).tolist()) for i, c in enumerate(cands)]
    weight = (lambda: 1.0) if equal else (lambda: r.choice([1.0, 1.0, 0.5, 0.2, 0.0, -0.5, 2.0]))
    links = sorted({(c, n, r.choice("ab")) for c in cands for n in r.sample(nodes, 3)} | {(cands[0], nodes[0], "a"), (cands[0], nodes[0], "b")})
    edges = sorted({(a, b, r.choice("xy"), r.choice(["p1", "p2"])) for a in nodes for b in r.sample(nodes, 5)})
    graph = Graph(None, frame([(*x, weight()) for x in links], "candidate_id string, node_id string, relation string, weight double"), frame([(*x, weight()) for x in edges], "source string, target string, relation string, paragraph_id string, weight double"))
    asked = [(f"q{i}", v.tolist(), r.choice([None, [], r.sample(cands, 3), ["nope"]]), r.choice([None, None, None, [], r.sample(cands, 12)])) for i, v in enumerate(g.standard_normal((12, 6)))]
    asked += [("zero", [0.0] * 6, None, None), ("none", None, None, None)]
    named = frame([(q, p, c) for q, *_ in asked for p, c in enumerate(r.sample([*cands, "nope"], 2))], "query_id string, pos int, candidate_id string")
    i = Inputs(frame([(q, q) for q, *_ in asked], "query_id string, text string"), frame(asked, "query_id string, vector array<double>, excluded array<string>, allowed array<string>"), corpus, frame(vectors, "candidate_id string, vector array<double>"), graph)
    options = Retrieval(semantic_k=9, seeds=SeedRules(semantic_k=3), expansion=expand.Expansion(nodes_per_hop=5, neighbours=4, candidates_per_node=6, graph_candidates=11), top_k=8)
    return i, named, options


def rows(df, *columns):
    near = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else tuple(map(near, v)) if isinstance(v, list) else v
    return sorted(tuple(near(v) for v in r) for r in df.select(*columns).where("query_id <> 'none'").collect())


@pytest.mark.parametrize("seed, equal, in_order", [(0, False, False), (1, True, False), (2, False, True), (3, True, True)])
def test_held_equals_joins(spark, seed, equal, in_order):
    i, named, options = case(spark, seed, equal)
    options = replace(options, in_order=in_order)
    f, w = retrieve.retrieve(i, named, options), retrieve.walk(i, named, options)
    keys = ["query_id", "candidate_id"]
    joined = [F.array_join("path", "|").alias("path"), F.array_join("relations", "|").alias("relations")]
    want = rows(f.paths(), *keys, "path_rank", "score", *joined)
    assert len(want) > 200 and rows(w.paths(), *keys, "path_rank", "score", "path", "relations") == want
    for how in ("max", "sum", "noisy_or"):
        assert rows(w.scores(how), *keys, "graph_score", "best") == rows(expand.graph_scores(f.emitted, how, 3), *keys, "graph_score", "best")
    own = ["semantic_score", "graph_score", "by_search", "by_graph"]
    assert rows(w.pool(), *keys, *own) == rows(f.pool, *keys, *own)
    assert rows(w.counts(), "query_id", "pool_size", "semantic", "graph_only") == rows(pool.pool_counts(f.pool), "query_id", "pool_size", "semantic", "graph_only")
    assert rows(w.ranked(), *keys, *own, "rank", "score") == rows(f.ranked, *keys, *own, "rank", "score")
    chosen = f.ranked.cache()
    paths = f.paths(chosen).cache()
    listed = w.ranked(paths=True).cache()
    assert rows(pool.listed_nodes(listed), *keys, "place", "node_id") == rows(pool.evidence_nodes(chosen, paths), *keys, "place", "node_id")
    ends = [*keys, "place", "source", "target", "relation"]
    assert rows(pool.listed_edges(listed), *ends) == rows(pool.evidence_edges(chosen, paths), *ends)
    graph = pool.graph_features(chosen, paths)
    assert rows(listed, *keys, *pool.COUNTS) == rows(graph, *keys, *pool.COUNTS)
    full = features.full(features.numeric(chosen, graph), i.vectors, i.corpus_vectors)
    points, sets = features.PointwiseMLP(31, 8, 4), features.SetTransformer(31, hidden=16, heads=4, layers=2, feedforward=32)
    points.head[:] = 0.3
    ranks = [*keys, "neural_rank", F.round("neural_score", 4)]
    assert rows(w.ranked(model=features.by_points(points), k=4), *ranks) == rows(features.score_points(full, points, 4), *ranks)
    assert rows(w.ranked(model=features.by_sets(sets, 8), k=4), *ranks) == rows(features.score_sets(full, sets, 4, 8), *ranks)


def test_what_cannot_be_held_is_left_to_joins(spark, monkeypatch):
    i, named, options = case(spark, 5)
    assert retrieve.walk(i, named, replace(options, seeds=SeedRules.of("weighted_query", semantic_k=3))) is None
    twice = replace(i, vectors=i.vectors.unionByName(i.vectors), held={})
    assert retrieve.walk(twice, named, options) is None
    for change in ({"corpus": i.corpus.limit(3)}, {"corpus_vectors": i.corpus_vectors.unionByName(i.corpus_vectors.limit(1))}):
        assert retrieve.walk(replace(i, held={}, **change), named, options) is None
    monkeypatch.setattr(held, "HELD_BYTES", 100)
    assert retrieve.walk(replace(i, held={}), named, options) is None


def test_search_of_a_large_corpus(monkeypatch):
    """Guessed thresholds, parts of the corpus and many equal vectors: the best of all are found, ties by id."""
    monkeypatch.setattr(held, "ROWS", 700)
    monkeypatch.setattr(held, "LOOK", 64)
    g = np.random.default_rng(3)
    x = g.standard_normal((3000, 8))
    x[500:1500] = x[500]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    q = np.concatenate([x[[500, 7]], g.standard_normal((20, 8)), np.zeros((1, 8))])
    w = held.Walker.__new__(held.Walker)
    w.k, w.h = 60, type("H", (), {"x": x})
    no = [np.array([500, 501]), *[None] * 22]
    for i, (c, s) in enumerate(w.search(q, no, [None] * 23)):
        every = held.rounded(x @ q[i])
        if i == 0:
            every[[500, 501]] = -9
        best = np.lexsort((np.arange(3000), -every))[:60]
        assert (c == best).all() and (s == every[best]).all()
