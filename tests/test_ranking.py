import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions.vectors import embed, feature_hash, split_side
from fathomline.operators import expand, features, metrics, pool, rerank
from fathomline.operators.graph import Graph, capped_edges, citation_graph, knowledge_graph, shortest_paths, undirected
from fathomline.operators.seeds import SeedRules, known_seeds, seeds
from fathomline.operators.semantic import search, search_declared


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# ---- Search ---------------------------------------------------------------------------------------------------------


def test_search_obeys_rules_and_order(spark):
    r = np.random.default_rng(1)
    x = r.standard_normal((300, 8))
    x[7] = x[8]
    c = frame(spark, [(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)] + [("null", None)], "candidate_id string, vector array<double>").repartition(5)
    q = frame(spark, [("a", x[7].tolist(), ["c007"], None), ("b", x[9].tolist(), None, ["c001", "c002", "nope"]), ("c", x[3].tolist(), [], []), ("d", None, None, None), ("z", [0.0] * 8, None, None)], "query_id string, vector array<double>, excluded array<string>, allowed array<string>")
    got = {}
    for row in search(q, c, 4).orderBy("query_id", "rank").collect():
        got.setdefault(row["query_id"], []).append(row["candidate_id"])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u[7], 6)
    order = [f"c{i:03d}" for i in np.lexsort((np.arange(300), -s)) if i != 7][:4]
    assert got["a"] == order and got["a"][0] == "c008"
    assert sorted(got["b"]) == ["c001", "c002"] and "c" not in got and "d" not in got  # nothing allowed is not the same as no rule
    assert got["z"] == ["c000", "c001", "c002", "c003"]
    free = q.where("query_id in ('a', 'z')").drop("excluded", "allowed")
    assert {tuple(t) for t in search(free, c, 4).collect()} == {tuple(t) for t in search_declared(free, c.where("vector is not null"), 4).collect()}
    # Partitioning does not change a ranking.
    assert {tuple(t) for t in search(q, c.repartition(1), 4).collect()} == {tuple(t) for t in search(q, c.repartition(11), 4).collect()}


def test_embedder(spark):
    df = frame(spark, [("a", "Wolf it's wolf"), ("b", ""), ("c", None)], "id string, text string")
    out = {r["id"]: np.array(r["vector"]) for r in embed(df, "id", "text", 32, 2).collect()}
    assert abs(np.linalg.norm(out["a"]) - 1) < 1e-6 and not out["b"].any() and not out["c"].any()
    assert np.allclose(out["a"], feature_hash("wolf IT'S Wolf", 32, 2, "blake2b"))


def test_split_is_stable(spark):
    import hashlib

    ids = [f"q{i}" for i in range(500)]
    got = {r[0]: r[1] for r in frame(spark, [(i,) for i in ids], "q string").select("q", split_side(13, F.col("q"), 0.1)).collect()}
    want = {i: "validation" if int.from_bytes(hashlib.sha1(f"13:{i}".encode()).digest()[:8], "big") < int(0.1 * 2**64) else "train" for i in ids}
    assert got == want and 20 < sum(v == "validation" for v in got.values()) < 90


# ---- Seeds ----------------------------------------------------------------------------------------------------------


def test_seeds(spark):
    hits = frame(spark, [("q", "a", 0.8, 1), ("q", "b", 0.2, 2), ("q", "c", 0.1, 3)], "query_id string, candidate_id string, score double, rank int")
    named = frame(spark, [("q", "b", 0, 0.9), ("q", "d", 1, 2.0), ("q", "gone", 2, 1.0), ("q", "d", 3, 0.1)], "query_id string, candidate_id string, pos int, weight double")
    lookup = frame(spark, [("q", "b", 0.2), ("q", "d", -1.0)], "query_id string, candidate_id string, score double")
    nodes = frame(spark, [("q", "n", 0, -3.0), ("q", "n", 1, 0.5)], "query_id string, node_id string, pos int, weight double")
    get = lambda rules: {(r["target"], r["kind"]): (r["score"], r["source"]) for r in seeds(rules, hits, named, lookup, nodes).collect()}
    first = get(SeedRules.of(semantic_k=2))
    assert first == {("a", "candidate"): (0.9, "semantic"), ("b", "candidate"): (0.6, "semantic"), ("d", "candidate"): (0.0, "query")}
    most = get(SeedRules.of("weighted_query", semantic_k=2, merge="max"))
    assert most[("b", "candidate")] == (0.9, "semantic+query") and most[("d", "candidate")] == (1.0, "query")
    assert get(SeedRules.of("graph_nodes", semantic_k=1)) == {("a", "candidate"): (0.9, "semantic"), ("n", "node"): (0.5, "query_node")}
    corpus = frame(spark, [("a",)], "candidate_id string")
    assert {r["target"] for r in known_seeds(seeds(SeedRules.of("graph_nodes", semantic_k=2), hits, nodes=nodes), corpus).collect()} == {"a", "n"}
    for bad in ({"kind": "nothing"}, {"merge": "last"}):
        with pytest.raises(ValueError):
            SeedRules.of(**bad)


# ---- Expansion ------------------------------------------------------------------------------------------------------


def walk(seed, links, edges, e, in_place):
    """Independent walk of one query over small dictionaries; hops see the start of the hop unless ``in_place``."""
    best = {}
    for target, score in seed:
        for _, node, rel, w in sorted((x for x in links if x[0] == target), key=lambda x: (-x[3], x[1], x[2])):
            s = score * max(0.0, w)
            if node not in best or s > best[node][0]:
                best[node] = (s, (f"candidate::{target}", node), (rel,))
    out, visited, fresh = [], set(), set(best)
    for depth in range(e.hops + 1):
        front = sorted(fresh - visited, key=lambda n: (-best[n][0], n))[: e.nodes_per_hop]
        visited |= set(front)
        for n in front:
            s, p, r = best[n]
            mine = sorted((x for x in links if x[1] == n), key=lambda x: (-x[3], x[0], x[2]))[: e.candidates_per_node]
            out += [(c, s * math.exp(-0.5 * (depth + 1)) * max(0.0, w), (*p, f"candidate::{c}"), (*r, rel)) for c, _, rel, w in mine]
        if depth == e.hops:
            return out
        snapshot, fresh = dict(best), set()
        for n in front:
            s, p, r = (best if in_place else snapshot)[n]
            for _, m, rel, w in sorted((x for x in edges if x[0] == n), key=lambda x: (-x[3], x[1], x[2]))[: e.neighbours]:
                v = s * math.exp(-0.5) * max(0.0, w)
                if m not in best or v > best[m][0]:
                    best[m] = (v, (*p, m), (*r, rel))
                    fresh.add(m)


@pytest.mark.parametrize("seed", range(3))
def test_expansion_against_walk(spark, seed):
    r = random.Random(seed)
    links, edges, seed_rows = [], [], []
    cands, nodes = [f"c{i}" for i in range(6)], [f"n{i}" for i in range(7)]
    for q in range(8):
        for c in cands:
            links += [(f"{q}{c}", f"{q}{n}", "m", r.choice([1.0, 0.7, 0.2, -0.5])) for n in r.sample(nodes, 2)]
        pairs = {(a, b) for a in nodes for b in r.sample(nodes, 3) if a != b}
        edges += [(f"{q}{a}", f"{q}{b}", "r", r.choice([1.0, 1.0, 0.9, 0.3])) for a, b in pairs]
        seed_rows += [(f"q{q}", f"{q}{c}", "candidate", r.choice([0.9, 0.5, 0.1]), "semantic", p) for p, c in enumerate(r.sample(cands, 2))]
    links, edges = sorted(set(links)), sorted(set(edges))
    e = expand.Expansion(hops=2, nodes_per_hop=3, neighbours=2, candidates_per_node=2, paths_per_candidate=2)
    g = Graph(None, frame(spark, links, "candidate_id string, node_id string, relation string, weight double"), frame(spark, edges, "source string, target string, relation string, weight double"))
    found = frame(spark, seed_rows, "query_id string, target string, kind string, score double, source string, pos int")
    different = 0
    for run, in_place in ((expand.emissions, False), (expand.emissions_in_order, True)):
        got = {(x["query_id"], x["candidate_id"], round(x["score"], 9), tuple(x["path"]), tuple(x["relations"])) for x in run(found, g, e).collect()}
        want = set()
        for q in range(8):
            mine = [(t, s) for i, t, _, s, _, _ in seed_rows if i == f"q{q}"]
            want |= {(f"q{q}", c, round(s, 9), p, rel) for c, s, p, rel in walk(mine, links, edges, e, in_place)}
        assert got == want
        different ^= hash(frozenset(got))
    kept = expand.best_paths(expand.emissions(found, g, e), 2)
    assert kept.groupBy("query_id", "candidate_id").count().agg(F.max("count")).first()[0] <= 2
    for how in ("max", "sum", "noisy_or"):
        assert kept.count() and all(0 <= x["graph_score"] <= 1 for x in expand.graph_scores(kept, how, 2).collect())
    with pytest.raises(ValueError):
        expand.graph_scores(kept, "mean", 2)


def test_a_seed_reaches_itself_with_two_decays(spark):
    g = Graph(None, frame(spark, [("a", "n", "m", 1.0), ("b", "n", "m", 1.0)], "candidate_id string, node_id string, relation string, weight double"), frame(spark, [("n", "n2", "r", 1.0)], "source string, target string, relation string, weight double"))
    found = frame(spark, [("q", "a", "candidate", 0.8, "semantic", 1)], "query_id string, target string, kind string, score double, source string, pos int")
    out = {(x["candidate_id"], len(x["path"])): x["score"] for x in expand.emissions(found, g, expand.Expansion()).collect()}
    assert out == {("a", 3): pytest.approx(0.8 * math.exp(-0.5)), ("b", 3): pytest.approx(0.8 * math.exp(-0.5))}


def test_positives_never_enter_the_pool():
    import inspect

    from fathomline.plans import retrieve

    assert "positive" not in inspect.getsource(retrieve) and "positives" not in inspect.signature(pool.pool).parameters


# ---- Graphs ---------------------------------------------------------------------------------------------------------


def test_knowledge_graph(spark):
    corpus = frame(spark, [("p1", "Alice"), ("p2", "Bob"), ("p3", "bob")], "candidate_id string, title string")
    ent = lambda *n: [(x, None, f"about {x}") for x in n]
    rows = [("p1", "Alice", ent("Alice", "Paris"), [("p1", "Paris", " lives in ", None), ("Alice", "Rome", "x", None), ("Paris", "alice", "", None)], 1), ("k7", " BOB ", ent("Bob", "PARIS "), [], 2), ("zz", "none", ent("Zed"), [], 3)]
    schema = "id string, title string, entities array<struct<entity_name string, entity_type string, description string>>, relationships array<struct<src_id string, tgt_id string, keywords string, description string>>, seq int"
    g = knowledge_graph(frame(spark, rows, schema), corpus, "seq")
    assert {(r["candidate_id"], r["node_id"]) for r in g.links.collect()} == {("p1", "alice"), ("p1", "paris"), ("p2", "bob"), ("p2", "paris"), ("p3", "bob"), ("p3", "paris")}
    assert {(r["source"], r["target"], r["relation"]) for r in g.edges.collect()} == {("alice", "paris", "lives in"), ("paris", "alice", "lives in"), ("alice", "paris", "related_to"), ("paris", "alice", "related_to")}
    assert {r["node_id"]: r["text"] for r in g.nodes.collect()}["paris"] == "about Paris"
    assert capped_edges(g.edges, 1).count() == 2


def test_citation_graph(spark):
    corpus = frame(spark, [("1",), ("2",), ("3",)], "candidate_id string")
    papers = frame(spark, [("1", ["A", " "], ["Math"], ["2", "1", "9"]), ("2", [], [], ["3", "1"]), ("9", ["B"], [], [])], "paper_id string, authors array<string>, fields array<string>, references array<string>")
    g = citation_graph(papers, corpus, frame(spark, [("2",)], "candidate_id string"))
    assert {(r["source"][11:], r["target"][11:], r["relation"]) for r in g.edges.collect()} == {("1", "2", "cites"), ("2", "1", "cited_by")}
    assert {(r["candidate_id"], r["node_id"]) for r in g.links.collect()} == {("1", "candidate::1"), ("2", "candidate::2"), ("3", "candidate::3"), ("1", "author::A"), ("1", "field::math")}


def test_shortest_paths(spark):
    e = frame(spark, [("a", "b", "x", 1), ("b", "a", "y", 2), ("b", "c", "x", 1), ("c", "d", "x", 1)], "source string, target string, relation string, seq int")
    u = undirected(e, "seq")
    assert {(r["source"], r["target"], r["relation"]) for r in u.collect()} >= {("a", "b", "y"), ("b", "a", "y"), ("d", "c", "x")} and u.count() == 6
    got = shortest_paths(frame(spark, [("q", "a")], "query_id string, node string"), u.withColumn("query_id", F.lit("q")), 2)
    assert {(r["node"], r["distance"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


# ---- Metrics, features, re-ranking ------------------------------------------------------------------------------------


def test_metrics(spark):
    q = frame(spark, [("q1",), ("q2",), ("q3",)], "query_id string")
    ranking = frame(spark, [("q1", "a", 1), ("q1", "b", 2), ("q1", "c", 3), ("q2", "x", 1)], "query_id string, candidate_id string, rank int")
    pos = frame(spark, [("q1", "b"), ("q1", "b"), ("q1", "z"), ("q2", "y")], "query_id string, candidate_id string")
    got = {r["query_id"]: r.asDict() for r in metrics.by_query(q, ranking, pos, [1, 2]).collect()}
    assert got["q1"]["recall@1"] == 0 and got["q1"]["recall@2"] == 0.5 and got["q1"]["hit@2"] == 1 and got["q1"]["mrr"] == 0.5
    assert got["q1"]["ndcg@2"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    assert set(got["q2"].values()) == {"q2", 0.0} and set(got["q3"].values()) == {"q3", 0.0}
    row = metrics.macro(metrics.by_query(q, ranking, pos, [2])).first()
    assert row["queries"] == 3 and row["recall@2"] == pytest.approx(0.5 / 3)
    assert metrics.macro(metrics.by_query(q, ranking, pos, [2], retrieved_only=True)).first()["recall@2"] == pytest.approx(1 / 3)
    assert metrics.macro(metrics.by_query(q.limit(0), ranking, pos, [2])).first()["recall@2"] == 0


def test_losses(spark):
    rows = [("q", 1.0, 1.0), ("q", 2.0, 0.0), ("q", 0.5, 1.0), ("r", 3.0, 0.0), ("big", 900.0, 1.0), ("big", -900.0, 0.0)]
    df = frame(spark, rows, "query_id string, s double, y double")
    got = {r["query_id"]: r["loss"] for r in metrics.listwise_loss(df, "s", "y").collect()}
    lse = math.log(math.exp(1) + math.exp(2) + math.exp(0.5))
    assert got == {"q": pytest.approx(lse - 0.75), "big": pytest.approx(0)}
    ce = [math.log1p(math.exp(-s)) if y else math.log1p(math.exp(s)) for q, s, y in rows if q == "q"]
    assert metrics.pointwise_loss(df.where("query_id = 'q'"), "s", "y").first()["loss"] == pytest.approx(np.mean(ce))


def test_models():
    r = np.random.default_rng(0)
    x, s = r.standard_normal((5, 12)), r.random(5)
    assert np.allclose(features.PointwiseMLP(12, 8, 4)(x, s)[0], s)
    m = features.SetTransformer(12, hidden=16, heads=4, layers=2, feedforward=32)
    mask = np.array([True, True, True, False, False])
    out, rep = m(x, mask)
    assert rep.shape == (5, 16) and (out[3:] == np.finfo(np.float32).min).all()
    other = x.copy()
    other[3:] = 99  # padding has no influence
    assert np.allclose(m(other, mask)[0][:3], out[:3])
    perm = [2, 0, 1, 3, 4]  # nor has the order of the candidates
    assert np.allclose(m(x[perm], mask)[0][:3], out[perm[:3]])


def test_linear_ranker_learns(spark):
    r = np.random.default_rng(0)
    rows = []
    for q in range(20):
        x = r.standard_normal((8, 3))
        y = int(np.argmax(x[:, 0]))
        rows += [(f"q{q}", v.tolist(), float(i == y)) for i, v in enumerate(x)]
    w = features.fit_listwise(frame(spark, rows, "query_id string, features array<double>, label double"), epochs=6, rate=2.0)
    assert w[0] > 1 > abs(w[1]) and w[0] > abs(w[2])


def test_rerank_and_cache(spark):
    ranked = frame(spark, [("q", c, i + 1) for i, c in enumerate("abcd")] + [("p", "x", 1)], "query_id string, candidate_id string, rank int")
    q = frame(spark, [("q", "what"), ("p", "who")], "query_id string, text string")
    texts = frame(spark, [(c, f"text {c}" * 9000) for c in "abcdx"], "candidate_id string, text string")
    got, misses = rerank.rerank(ranked, q, texts, rerank.passthrough, "passthrough", 3)
    assert [(r["candidate_id"], r["llm_score"]) for r in got.where("query_id = 'q'").orderBy("llm_rank").collect()] == [("a", 4.0), ("b", 3.0), ("c", 2.0)]
    assert misses.count() == 2
    answer = lambda req: [{"candidate_id": "zz", "score": "9"}, {"candidate_id": "c", "score": "bad"}, {"candidate_id": "c", "score": "7"}, {"candidate_id": "a", "score": "0.5"}]
    got, _ = rerank.rerank(ranked, q, texts, answer, "other", 4)
    assert [(r["candidate_id"], r["llm_score"]) for r in got.where("query_id = 'q'").orderBy("llm_rank").collect()] == [("c", 4.0), ("a", 0.5), ("b", 2.0), ("d", 1.0)]

    def fails(req):
        raise RuntimeError("asked again")

    cache = spark.createDataFrame(misses.collect(), misses.schema)
    kept, none = rerank.rerank(ranked, q, texts, fails, "passthrough", 3, cache)
    assert kept.count() == 4 and none.count() == 0
    keys = {r["cache_key"] for r in rerank.requests(ranked, q, texts, "one").collect()} | {r["cache_key"] for r in rerank.requests(ranked, q, texts, "two").collect()}
    assert len(keys) == 4
    with pytest.raises(ValueError):
        rerank.prompt("v2")
    with pytest.raises(ValueError):
        pool.weighted(F.lit(1), F.lit(1), -1, 2)


# ---- Extraction, protocol, epochs -----------------------------------------------------------------------------------


def test_extraction_records(spark):
    from fathomline.operators.extract import by_model, by_rule, records

    df = frame(spark, [("p1", "Alice Smith", "Alice Smith met Bob Jones in New York. Bob Jones left."), ("p2", "none", None)], "id string, title string, text string")
    got = {r["id"]: r for r in records(by_rule(df, "id", "title", "text")).collect()}
    assert [(e["entity_name"], e["entity_type"]) for e in got["p1"]["entities"]] == [("Alice Smith", "document"), ("Bob Jones", "name"), ("New York", "name")]
    assert [(r["src_id"], r["tgt_id"]) for r in got["p1"]["relationships"]] == [("Alice Smith", "Bob Jones"), ("Bob Jones", "New York")]
    assert "Bob Jones" in got["p1"]["entities"][1]["description"] and len(got["p2"]["entities"]) == 1
    model = lambda texts: [([("bob", "person")], [("bob", "knows", "Zoe")]) for _ in texts]
    got = {r["id"]: r for r in records(by_model(df, "id", "title", "text", model)).collect()}
    assert [(e["entity_name"], e["entity_type"]) for e in got["p2"]["entities"]] == [("none", "document"), ("bob", "person"), ("Zoe", "unknown")]


def test_protocol(spark, tmp_path):
    from fathomline.sources import protocol

    part = lambda *ids: frame(spark, [(q, i) for i, q in enumerate(ids)], "query_id string, seq int")
    parts = {"train": part("a", "b", "c"), "validation": part("d", "t"), "test": part("t")}
    forbidden = protocol.forbidden_ids(parts["test"], None, part("b", ""))
    assert [r["query_id"] for r in protocol.select("development", "all", parts, forbidden, 3).orderBy("split_at", "seq").collect()] == ["a", "c", "d"]
    assert [r["query_id"] for r in protocol.select("test", "all", parts, forbidden).collect()] == ["t"]
    for bad in (("x", "all"), ("test", "x"), ("test", "train")):
        with pytest.raises(ValueError):
            protocol.select(*bad, parts)
    protocol.require_positives(part("a"), part("a"))
    protocol.same_queries(part("a", "b"), part("b", "a"))
    for f, args in ((protocol.require_positives, (part("a", "b"), part("a"))), (protocol.same_queries, (part("a"), part("b"))), (protocol.same_queries, (part("a", "a"), part("a"))), (protocol.enrichment_gate, (spark, ["/nowhere"], True))):
        with pytest.raises((ValueError, FileNotFoundError)):
            f(*args)
    protocol.same_order(part("a", "b"), part("a", "b"))
    assert [r["query_id"] for r in protocol.project(part("a", "b", "c"), part("c", "a")).collect()].sort() is None
    for f, args in ((protocol.same_order, (part("a", "b"), part("b", "a"))), (protocol.same_order, (part("a", "b"), part("a"))), (protocol.project, (part("a"), part("b"))), (protocol.project, (part("a"), part("a", "a")))):
        with pytest.raises(ValueError):
            f(*args)
    assert protocol.enrichment_gate(spark, ["/nowhere"], False) == []


def test_epochs_and_dataset(spark, tmp_path):
    q = frame(spark, [(f"q{i}",) for i in range(40)], "query_id string")
    one, two = ({r["query_id"]: r["place"] for r in features.epoch_order(q.repartition(n), 13, e).collect()} for n, e in ((2, 1), (5, 2)))
    assert sorted(one.values()) == sorted(two.values()) == list(range(1, 41)) and one != two
    assert one == {r["query_id"]: r["place"] for r in features.epoch_order(q.repartition(7), 13, 1).collect()}
    rows = q.withColumn("side", F.when(F.col("query_id") < "q2", "train").otherwise("validation")).withColumn("rank", F.lit(1))
    features.write_dataset(rows, str(tmp_path / "d"), "side", 5)
    back = spark.read.parquet(str(tmp_path / "d"))
    assert back.count() == 40 and back.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 5


def test_best_epoch_is_kept(spark):
    rows = [("q", [1.0], 1.0), ("q", [0.0], 0.0)]
    seen = []
    w = features.fit_listwise(frame(spark, rows, "query_id string, features array<double>, label double"), epochs=3, judge=lambda v: seen.append(v) or -len(seen))
    assert len(seen) == 3 and (w == seen[0]).all()


# ---- Full sizes -------------------------------------------------------------------------------------------------------


def test_queries_take_the_full_sizes():
    """All retrieval queries and their SQL take these; test_pipeline compares each query with its SQL."""
    from fathomline.operators import queries_ranking as q
    from fathomline.plans import local

    r, e = q.R, q.R.expansion
    assert (r.semantic_k, r.seeds.semantic_k, e.hops, e.nodes_per_hop, e.neighbours, e.candidates_per_node, e.graph_candidates, r.top_k, local.SEEDS) == (500, 20, 2, 500, 100, 100, 1000, 100, 8)
    assert "<= 500" in q.SQL["hybrid_rank"] and "<= 1000" in q.SQL["hybrid_rank"] and not [n for n in q.QUERIES if n.endswith("_reference")]


def test_graph_stage_is_ranked_whole(spark, tmp_path):
    """A first positive below rank 100 of the graph stage counts."""
    from pathlib import Path

    from fathomline.operators.queries_corpus import stage_metrics
    from fathomline.sources.derived import judgements, queries

    data = Path("/root/testdata/sf0.001")
    for f in data.iterdir():
        if f.name != "generated_candidates.parquet":
            (tmp_path / f.name).symlink_to(f)
    one = judgements(spark, str(data)).join(queries(spark, str(data)).select("query_id"), "query_id", "left_semi").orderBy("query_id", "candidate_id").first()
    rows = [(one["query_id"], f"x{i:03d}", 0.5, 1.0 - i / 1000) for i in range(150)] + [(one["query_id"], one["candidate_id"], 0.1, 0.01)]
    frame(spark, rows, "query_id string, candidate_id string, semantic_score double, graph_score double").write.parquet(str(tmp_path / "generated_candidates.parquet"))
    n = queries(spark, str(data)).select("query_id").distinct().count()
    got = {(r["stage"], r["metric"]): r["value"] for r in stage_metrics(spark, str(tmp_path)).collect()}
    assert got["graph", "mrr"] == round(1 / 151 / n, 9) > 0
