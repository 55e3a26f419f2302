"""Queries of search, graph expansion and ranking, with their SQL."""

from __future__ import annotations

import math
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACES, STOP_WORDS
from ..functions.vectors import unit_interval
from ..plans.retrieve import Retrieval, begin, over, walked
from ..plans.stage import stage
from ..sources.derived import DIM, corpus_vectors, graph, inputs, named_seeds, query_vectors
from ..sources.tables import table
from . import expand, features, pool, rerank
from .graph import capped_edges, capped_links
from .seeds import SeedRules, known_seeds, seeds
from .semantic import search, search_declared, top

R = Retrieval()
E = R.expansion


# ---- Search -------------------------------------------------------------------------------------------------------


def _embeddings(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (ids divisible by 50, which exclude themselves) and the whole table."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("candidate_id"), F.col("embedding").alias("vector"))
    q = table(spark, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("vector"), F.array(F.col("vec_id").cast("string")).alias("excluded"))
    return q, v


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    q, v = _embeddings(spark, d)
    return search_declared(q, v, 20)


def semantic_topk_arrow(spark: SparkSession, d: str) -> DataFrame:
    q, v = _embeddings(spark, d)
    return search(q.drop("excluded"), v, 20)


def semantic_topk_excluded(spark: SparkSession, d: str) -> DataFrame:
    q, v = _embeddings(spark, d)
    return search(q, v, 20)


def semantic_topk_allowed(spark: SparkSession, d: str) -> DataFrame:
    return search(query_vectors(spark, d), corpus_vectors(spark, d), 20)


# ---- Seeds and expansion ------------------------------------------------------------------------------------------


def _seeds(rules: SeedRules, r: Retrieval = R):
    def query(spark: SparkSession, d: str) -> DataFrame:
        i = inputs(spark, d)
        hits = search(i.vectors, i.corpus_vectors, r.semantic_k)
        named = named_seeds(spark, d).withColumn("weight", 1.5 / (F.col("pos") + 1))
        lookup = pool.pair_scores(named, i.vectors, i.corpus_vectors)
        nodes = named.join(i.graph.links.drop("weight"), "candidate_id").select("query_id", "node_id", "pos", "weight")
        return known_seeds(seeds(rules, hits, named, lookup, nodes), i.corpus).drop("pos")

    return query


def graph_links_capped(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    return capped_links(graph(spark, d).links, r.expansion.candidates_per_node)


def graph_neighbors_capped(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    return capped_edges(graph(spark, d).edges, r.expansion.neighbours)


def _expanded(hops: int, r: Retrieval = R):
    def query(spark: SparkSession, d: str) -> DataFrame:
        options = replace(r, expansion=replace(r.expansion, hops=hops))
        if w := walked(spark, d, options):
            return w.paths(9)
        f = begin(inputs(spark, d), named_seeds(spark, d), options)
        paths = expand.best_paths(expand.emissions(f.seeds, f.inputs.graph, options.expansion), r.expansion.paths_per_candidate)
        return paths.select("query_id", "candidate_id", "path_rank", F.round("score", 9).alias("score"), F.array_join("path", "|").alias("path"), F.array_join("relations", "|").alias("relations"))

    return query


def graph_expand_exact(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    options = replace(r, in_order=True)
    if w := walked(spark, d, options):
        return w.paths(9, relations=False)
    f = over(spark, d, options)
    return f.paths().select("query_id", "candidate_id", "path_rank", F.round("score", 9).alias("score"), F.array_join("path", "|").alias("path"))


def _aggregated(how: str, r: Retrieval = R):
    def query(spark: SparkSession, d: str) -> DataFrame:
        if w := walked(spark, d, r):
            return w.scores(how, 9).drop("best")
        return expand.graph_scores(over(spark, d, r).emitted, how, r.expansion.paths_per_candidate).select("query_id", "candidate_id", F.round("graph_score", 9).alias("graph_score"))

    return query


def hybrid_pool(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    if w := walked(spark, d, r):
        return w.pool(7, 9)
    return over(spark, d, r).pool.select("query_id", "candidate_id", F.round("semantic_score", 7).alias("semantic_score"), F.round("graph_score", 9).alias("graph_score"), "by_search", "by_graph")


def pool_counts(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    w = walked(spark, d, r)
    return w.counts() if w else pool.pool_counts(over(spark, d, r).pool)


def _ranked(spark: SparkSession, d: str, r: Retrieval) -> DataFrame:
    w = walked(spark, d, r)
    return w.ranked() if w else over(spark, d, r).ranked


def hybrid_rank(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    return _ranked(spark, d, r).select("query_id", "rank", "candidate_id", F.round("score", 7).alias("score"))


def _chosen(spark: SparkSession, d: str, r: Retrieval = R):
    """The plan and its ranked candidates, written: evidence is looked up for these alone."""
    f = over(spark, d, r)
    return f, stage(f.ranked, "ranked")


def evidence_nodes(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    if w := walked(spark, d, r):
        return pool.listed_nodes(w.ranked(paths=True))
    f, chosen = _chosen(spark, d, r)
    return pool.evidence_nodes(chosen, f.paths(chosen))


def evidence_edges(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    if w := walked(spark, d, r):
        return pool.listed_edges(w.ranked(paths=True))
    f, chosen = _chosen(spark, d, r)
    return pool.evidence_edges(chosen, f.paths(chosen))


def graph_features(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    if w := walked(spark, d, r):
        return w.ranked().select("query_id", "candidate_id", *pool.COUNTS)
    f, chosen = _chosen(spark, d, r)
    return pool.graph_features(chosen, stage(f.paths(chosen), "paths"))


def numeric_features(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    if w := walked(spark, d, r):
        n = features.numbers(w.ranked())
    else:
        f, chosen = _chosen(spark, d, r)
        n = features.numeric(chosen, pool.graph_features(chosen, stage(f.paths(chosen), "paths")))
    return n.select("query_id", "candidate_id", "rank", *(F.round(c, 7).alias(c) for c in features.NUMERIC))


def _full(f, chosen: DataFrame) -> DataFrame:
    n = features.numeric(chosen, pool.graph_features(chosen, stage(f.paths(chosen), "paths")))
    return features.full(n, f.inputs.vectors, f.inputs.corpus_vectors)


def pointwise_rerank_zero_head(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    model = features.PointwiseMLP(4 * DIM + 7)
    if w := walked(spark, d, r):
        out = w.ranked(model=features.by_points(model), k=10)
    else:
        out = features.score_points(_full(*_chosen(spark, d, r)), model, 10)
    return out.select("query_id", "candidate_id", F.round("neural_score", 7).alias("neural_score"), "neural_rank")


def set_transformer_rerank(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    model = features.SetTransformer(4 * DIM + 7)
    if w := walked(spark, d, r):
        return w.ranked(model=features.by_sets(model, r.top_k), k=10)
    return features.score_sets(_full(*_chosen(spark, d, r)), model, 10, r.top_k)


def _asked(spark: SparkSession, d: str, r: Retrieval, provider: rerank.Provider, name: str) -> DataFrame:
    i = inputs(spark, d)
    return rerank.rerank(stage(_ranked(spark, d, r).select("query_id", "candidate_id", "rank"), "ranked"), i.queries, i.corpus, provider, name, 10)[0]


def llm_passthrough_rerank(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    return _asked(spark, d, r, rerank.passthrough, "passthrough")


def _partial(request: dict) -> list[dict]:
    """Every second candidate from the last on, twice, and one that doesn't exist: what a careless model might reply."""
    ids = [c["candidate_id"] for c in request["candidates"]][1::2][::-1]
    return [{"candidate_id": "unknown", "score": "1"}, *({"candidate_id": i, "score": "high"} for i in ids), *({"candidate_id": i, "score": "0"} for i in ids)]


def llm_partial_response_merge(spark: SparkSession, d: str, r: Retrieval = R) -> DataFrame:
    return _asked(spark, d, r, _partial, "partial")


def instance_local_rank(spark: SparkSession, d: str) -> DataFrame:
    """Candidates of each question among themselves: cosine, and paths from the terms closest to the question."""
    from ..plans.local import local_rank

    return local_rank(spark, d).select("query_id", "candidate_id", "rank", F.round("score", 7).alias("score"))


# ---- SQL ----------------------------------------------------------------------------------------------------------

_WS = SPACES


def strip_sql(c: str) -> str:
    return f"regexp_replace({c}, '^{_WS}+|{_WS}+$', '', 'g')"


def norm_sql(c: str) -> str:
    return f"trim(regexp_replace(replace(lower({c}), 'ß', 'ss'), '{_WS}+', ' ', 'g'))"


CORPUS = f"""cs AS (SELECT {strip_sql('title')} AS title, {strip_sql('text')} AS text, sources, record_id FROM paragraphs),
    ck AS (SELECT sha1(title || chr(10) || text) AS candidate_id, * FROM cs WHERE title <> '' AND text <> ''),
    corpus AS (SELECT candidate_id, min(title) AS title, min(text) AS text FROM ck GROUP BY candidate_id)"""


def vectors_sql(name: str, rows: str) -> str:
    """Hashed vectors in long form (id, b, x) of rows (id, text)."""
    return f"""{name}_t AS (SELECT id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_''-]+') AS w FROM ({rows})),
    {name}_g AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || '::' || w[i + 1]))) AS g FROM {name}_t),
    {name}_v AS (SELECT id, ('0x' || substr(md5(g), 1, 15))::UBIGINT AS v FROM {name}_g),
    {name}_b AS (SELECT id, (v % {DIM})::INT AS b, sum(CASE WHEN v % 2 = 1 THEN 1 ELSE -1 END)::DOUBLE AS c FROM {name}_v GROUP BY ALL),
    {name} AS (SELECT id, b, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS x FROM {name}_b WHERE c <> 0)"""


_SIM = f"""{CORPUS}, {vectors_sql('qv', 'SELECT query_id AS id, text FROM queries')},
    {vectors_sql('cv', 'SELECT candidate_id AS id, title || chr(10) || text AS text FROM corpus')},
    sims AS (SELECT q.id AS query_id, c.id AS candidate_id, round(sum(q.x * c.x), 6) AS score FROM qv q JOIN cv c USING (b) GROUP BY ALL),
    open AS (SELECT s.* FROM sims s JOIN queries q USING (query_id) WHERE NOT coalesce(list_contains(excluded_candidate_ids, candidate_id), false)
        AND (allowed_candidate_ids IS NULL OR list_contains(allowed_candidate_ids, candidate_id)))"""


def hits_sql(k: int) -> str:
    return f"{_SIM}, hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM open QUALIFY rank <= {k})"


_UNIT = "greatest(0::DOUBLE, least(1::DOUBLE, (score + 1) / 2))"
_NAMED = """named AS (SELECT query_id, seed_candidate_ids[i + 1] AS candidate_id, i AS pos, greatest(0::DOUBLE, least(1::DOUBLE, 1.5::DOUBLE / (i + 1))) AS weight
        FROM (SELECT query_id, seed_candidate_ids, unnest(range(len(seed_candidate_ids))) AS i FROM queries)),
    n1 AS (SELECT query_id, candidate_id, min(pos) AS pos, max(weight) AS weight FROM named GROUP BY ALL)"""
GRAPH = f"""raw AS (SELECT DISTINCT entity_id, paragraph_id FROM entity_to_paragraphs WHERE entity_id IS NOT NULL AND paragraph_id IN (SELECT candidate_id FROM corpus)),
    links AS (SELECT DISTINCT paragraph_id AS candidate_id, {norm_sql('entity_id')} AS node_id, 'mentions' AS relation, 1::DOUBLE AS weight FROM raw),
    nxt AS (SELECT {norm_sql('entity_id')} AS s, {norm_sql('lead(entity_id) OVER (PARTITION BY paragraph_id ORDER BY entity_id)')} AS t, paragraph_id FROM raw),
    edges AS (SELECT DISTINCT * FROM (SELECT s AS source, t AS target, 'next_to' AS relation, paragraph_id FROM nxt WHERE t IS NOT NULL UNION ALL SELECT t, s, 'next_to', paragraph_id FROM nxt WHERE t IS NOT NULL)),
    cl AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY weight DESC, candidate_id, relation) AS place FROM links QUALIFY place <= {E.candidates_per_node}),
    ce AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY weight DESC, target, relation) AS place FROM (SELECT DISTINCT source, target, relation, 1::DOUBLE AS weight FROM edges) QUALIFY place <= {E.neighbours})"""


def seeds_sql(merge: str = "first", weights: bool = False, candidates: bool = True, nodes: bool = False) -> str:
    own = f"coalesce(n1.weight, {_UNIT})" if weights else _UNIT
    larger = "s IS NOT NULL AND s2 > s" if merge == "max" else "false"
    parts = [f"""s1 AS (SELECT query_id, candidate_id AS target, {_UNIT} AS s, rank AS p FROM hits WHERE rank <= {R.seeds.semantic_k})"""]
    if candidates:
        parts.append(f"s2 AS (SELECT query_id, candidate_id AS target, {own} AS s2, pos AS p2 FROM n1 JOIN sims USING (query_id, candidate_id))")
        parts.append(f"""sc AS (SELECT query_id, target, 'candidate' AS kind, CASE WHEN s IS NULL OR ({larger}) THEN s2 ELSE s END AS score,
            CASE WHEN s IS NULL THEN 'query' WHEN {larger} THEN 'semantic+query' ELSE 'semantic' END AS source, coalesce(p, p2 + 1000000) AS pos FROM s1 FULL JOIN s2 USING (query_id, target))""")
    else:
        parts.append("sc AS (SELECT query_id, target, 'candidate' AS kind, s AS score, 'semantic' AS source, p AS pos FROM s1)")
    node = "UNION ALL SELECT query_id, node_id, 'node', max(named.weight), 'query_node', min(pos) + 2000000 FROM named JOIN links USING (candidate_id) GROUP BY query_id, node_id" if nodes else ""
    parts.append(f"seeds AS (SELECT * FROM sc {node})")
    return ", ".join(parts)


def expand_sql(hops: int) -> str:
    n, step = E.nodes_per_hop, repr(expand.STEP)
    best = "QUALIFY row_number() OVER (PARTITION BY query_id, node ORDER BY score DESC, o1, o2) = 1"
    front = f"QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) <= {n}"
    numbered = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node) AS f"
    parts = [
        "al AS (SELECT *, row_number() OVER (PARTITION BY candidate_id ORDER BY weight DESC, node_id, relation) AS place FROM links)",
        f"""b0 AS (SELECT query_id, node, score, path, rels FROM (SELECT query_id, node_id AS node, score * greatest(0, weight) AS score, ['candidate::' || target, node_id] AS path, [relation] AS rels, pos AS o1, place AS o2
            FROM seeds JOIN al ON target = candidate_id WHERE kind = 'candidate') {best})""",
        f"f0 AS (SELECT *, {numbered} FROM b0 {front})",
    ]
    for h in range(hops + 1):
        parts.append(f"""e{h} AS (SELECT query_id, candidate_id, score * {math.exp(-0.5 * (h + 1))!r}::DOUBLE * greatest(0, weight) AS score, list_append(path, 'candidate::' || candidate_id) AS path, list_append(rels, relation) AS rels
            FROM f{h} JOIN cl ON node = node_id)""")
        if h == hops:
            break
        seen = " UNION ALL ".join(f"SELECT query_id, node FROM f{g}" for g in range(h + 1))
        parts += [
            f"""x{h} AS (SELECT query_id, node, score, path, rels FROM (SELECT query_id, target AS node, score * {step}::DOUBLE * greatest(0, weight) AS score, list_append(path, target) AS path, list_append(rels, relation) AS rels, f AS o1, place AS o2
                FROM f{h} JOIN ce ON node = source) {best})""",
            f"m{h} AS (SELECT query_id, node, o.score AS os, o.path AS op, o.rels AS orl, x.score AS xs, x.path AS xp, x.rels AS xr, x.score IS NOT NULL AND (o.score IS NULL OR x.score > o.score) AS up FROM b{h} o FULL JOIN x{h} x USING (query_id, node))",
            f"b{h + 1} AS (SELECT query_id, node, CASE WHEN up THEN xs ELSE os END AS score, CASE WHEN up THEN xp ELSE op END AS path, CASE WHEN up THEN xr ELSE orl END AS rels FROM m{h})",
            f"v{h} AS ({seen})",
            f"f{h + 1} AS (SELECT query_id, node, xs AS score, xp AS path, xr AS rels, row_number() OVER (PARTITION BY query_id ORDER BY xs DESC, node) AS f FROM m{h} ANTI JOIN v{h} USING (query_id, node) WHERE up QUALIFY f <= {n})",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM e{h}" for h in range(hops + 1))
    parts.append(f"paths AS (SELECT *, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY score DESC, path, rels) AS path_rank FROM ({every}) QUALIFY path_rank <= {E.paths_per_candidate})")
    return ", ".join(parts)


_BASE = f"WITH {hits_sql(R.semantic_k)}, {_NAMED}, {GRAPH}"
_AGG = {"max": "max(greatest(0, least(1, score)))", "sum": "least(1, sum(greatest(0, least(1, score))))", "noisy_or": "1 - product(1 - greatest(0, least(1, score)))"}
_PATHS = f"{_BASE}, {seeds_sql()}, {expand_sql(2)}"
_POOL = f"""{_PATHS}, gs AS (SELECT query_id, candidate_id, {_AGG['max']} AS graph_score, max(score) AS best FROM paths GROUP BY ALL),
    ge AS (SELECT * FROM gs QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best DESC, candidate_id) <= {E.graph_candidates}),
    both_ AS (SELECT query_id, candidate_id, h.score IS NOT NULL AS by_search, g.best IS NOT NULL AS by_graph FROM hits h FULL JOIN ge g USING (query_id, candidate_id)),
    pool AS (SELECT query_id, candidate_id, {_UNIT} AS semantic_score, coalesce(graph_score, 0) AS graph_score, by_search, by_graph FROM both_ JOIN open USING (query_id, candidate_id) LEFT JOIN gs USING (query_id, candidate_id))"""
_RANKED = f"""{_POOL}, ranked AS (SELECT *, (semantic_score * 0.5::DOUBLE + graph_score * 0.5::DOUBLE) / 1::DOUBLE AS fused, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, candidate_id) AS rank FROM pool QUALIFY rank <= {R.top_k})"""
_EVIDENCE = f"""{_RANKED}, cp AS (SELECT p.* FROM paths p SEMI JOIN ranked USING (query_id, candidate_id)),
    pn AS (SELECT query_id, candidate_id, path_rank, i AS p, path[i + 1] AS node_id FROM (SELECT *, unnest(range(len(path))) AS i FROM cp)),
    en AS (SELECT query_id, candidate_id, node_id, min(path_rank * 1000 + p) AS o FROM pn GROUP BY ALL),
    pe AS (SELECT query_id, candidate_id, path_rank, i AS p, path[i + 1] AS source, path[i + 2] AS target, rels[i + 1] AS relation FROM (SELECT *, unnest(range(len(rels))) AS i FROM cp)),
    ee AS (SELECT query_id, candidate_id, source, target, relation, min(path_rank * 1000 + p) AS o FROM pe GROUP BY ALL),
    gf AS (SELECT r.query_id, r.candidate_id, coalesce(n, 0) AS node_count, coalesce(m, 0) AS edge_count, coalesce(k, 0) AS path_count, coalesce(h, 0) AS best_path_hops FROM ranked r
        LEFT JOIN (SELECT query_id, candidate_id, count(*) AS n FROM en GROUP BY ALL) USING (query_id, candidate_id) LEFT JOIN (SELECT query_id, candidate_id, count(*) AS m FROM ee GROUP BY ALL) USING (query_id, candidate_id)
        LEFT JOIN (SELECT query_id, candidate_id, count(*) AS k, max(CASE WHEN path_rank = 1 THEN len(path) - 1 END) AS h FROM paths GROUP BY ALL) USING (query_id, candidate_id))"""
_VECTORS = """WITH v AS (SELECT vec_id::VARCHAR AS id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v),
    s AS (SELECT q.id AS query_id, c.id AS candidate_id, round(list_dot_product(q.e, c.e), 6) AS score FROM u q, u c WHERE q.id::BIGINT % 50 = 0)"""
_TOP20 = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM {} QUALIFY rank <= 20"
_LOCAL = f"""WITH o AS (SELECT * FROM hotpot_tiny WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST, question NULLS FIRST) = 1),
    u AS (SELECT id AS query_id, i AS pos, context.title[i + 1] AS title, {strip_sql("array_to_string(context.sentences[i + 1], chr(10))")} AS text FROM (SELECT *, unnest(range(least(len(context.title), len(context.sentences)))) AS i FROM o)),
    r AS (SELECT query_id, sha1({strip_sql('title')} || chr(10) || text) AS candidate_id, min(pos) AS pos, min(text) AS text FROM u GROUP BY ALL),
    x AS (SELECT candidate_id AS id, min(text) AS text FROM r GROUP BY candidate_id), {vectors_sql('qv', 'SELECT id, question AS text FROM o')}, {vectors_sql('cv', 'SELECT id, text FROM x')},
    dots AS (SELECT r.query_id, r.candidate_id, round(coalesce(sum(q.x * c.x), 0), 6) AS score FROM r LEFT JOIN qv q ON q.id = r.query_id LEFT JOIN cv c ON c.id = r.candidate_id AND c.b = q.b GROUP BY ALL),
    sc AS (SELECT query_id, candidate_id, {_UNIT} AS s FROM dots),
    tm AS (SELECT id, lower(unnest(regexp_extract_all(text, '[A-Za-z][A-Za-z0-9''-]{{3,}}'))) AS term FROM x),
    tf AS (SELECT id, term, count(*) AS n FROM tm WHERE term NOT IN ({', '.join("'" + w + "'" for w in STOP_WORDS)}) GROUP BY ALL),
    tl AS (SELECT id, term, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS place FROM tf QUALIFY place <= 10), {vectors_sql('tv', 'SELECT DISTINCT term AS id, term AS text FROM tl')},
    own AS (SELECT query_id, candidate_id, term, pos, place FROM r JOIN tl ON id = candidate_id), nd AS (SELECT query_id, term, min(pos * 100 + place) AS pl FROM own GROUP BY ALL),
    td AS (SELECT nd.query_id, nd.term, pl, round(coalesce(sum(q.x * t.x), 0), 6) AS score FROM nd LEFT JOIN qv q ON q.id = nd.query_id LEFT JOIN tv t ON t.id = nd.term AND t.b = q.b GROUP BY ALL),
    sd AS (SELECT query_id, term, {_UNIT} AS g FROM td QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY g DESC, pl) <= 8),
    one AS (SELECT query_id, candidate_id, term, g FROM own JOIN sd USING (query_id, term)),
    two AS (SELECT DISTINCT query_id, b.candidate_id, one.term, g FROM one JOIN own a USING (query_id, candidate_id) JOIN own b USING (query_id) WHERE a.term = b.term),
    g AS (SELECT query_id, candidate_id, max(g) AS g FROM (SELECT query_id, candidate_id, g FROM one UNION ALL SELECT query_id, candidate_id, g * exp(-2::DOUBLE) FROM two) GROUP BY ALL),
    f AS (SELECT query_id, candidate_id, (s * 0.5::DOUBLE + coalesce(g, 0) * 0.5::DOUBLE) / 1::DOUBLE AS f FROM sc LEFT JOIN g USING (query_id, candidate_id))"""
_PATH_COLUMNS = "query_id, candidate_id, path_rank, round(score, 9) AS score, array_to_string(path, '|') AS path, array_to_string(rels, '|') AS relations"

QUERIES = {
    "hybrid_rank": hybrid_rank,
    "semantic_topk": semantic_topk,
    "semantic_topk_arrow": semantic_topk_arrow,
    "semantic_topk_excluded": semantic_topk_excluded,
    "semantic_topk_allowed": semantic_topk_allowed,
    "seeds_first": _seeds(SeedRules.of(semantic_k=R.seeds.semantic_k)),
    "seeds_max": _seeds(SeedRules.of("weighted_query", semantic_k=R.seeds.semantic_k, merge="max")),
    "seeds_nodes": _seeds(SeedRules.of("graph_nodes", semantic_k=R.seeds.semantic_k)),
    "graph_links_capped": graph_links_capped,
    "graph_neighbors_capped": graph_neighbors_capped,
    "graph_expand_hop0": _expanded(0),
    "graph_expand_hop1": _expanded(1),
    "graph_expand_hop2": _expanded(2),
    "graph_expand_exact": graph_expand_exact,
    "graph_score_max": _aggregated("max"),
    "graph_score_sum": _aggregated("sum"),
    "graph_score_noisy_or": _aggregated("noisy_or"),
    "hybrid_pool": hybrid_pool,
    "pool_counts": pool_counts,
    "evidence_nodes": evidence_nodes,
    "evidence_edges": evidence_edges,
    "graph_features": graph_features,
    "numeric_features": numeric_features,
    "pointwise_rerank_zero_head": pointwise_rerank_zero_head,
    "set_transformer_rerank": set_transformer_rerank,
    "llm_passthrough_rerank": llm_passthrough_rerank,
    "llm_partial_response_merge": llm_partial_response_merge,
    "instance_local_rank": instance_local_rank,
}
SQL = {
    "hybrid_rank": f"{_RANKED} SELECT query_id, rank, candidate_id, round(fused, 7) AS score FROM ranked",
    "semantic_topk": f"{_VECTORS} {_TOP20.format('s')}",
    "semantic_topk_arrow": f"{_VECTORS} {_TOP20.format('s')}",
    "semantic_topk_excluded": f"{_VECTORS} {_TOP20.format('(SELECT * FROM s WHERE query_id <> candidate_id)')}",
    "semantic_topk_allowed": f"WITH {hits_sql(20)} SELECT * FROM hits",
    "seeds_first": f"{_BASE}, {seeds_sql()} SELECT query_id, target, kind, score, source FROM seeds",
    "seeds_max": f"{_BASE}, {seeds_sql('max', True)} SELECT query_id, target, kind, score, source FROM seeds",
    "seeds_nodes": f"{_BASE}, {seeds_sql(candidates=False, nodes=True)} SELECT query_id, target, kind, score, source FROM seeds",
    "graph_links_capped": f"WITH {CORPUS}, {GRAPH} SELECT * FROM cl",
    "graph_neighbors_capped": f"WITH {CORPUS}, {GRAPH} SELECT * FROM ce",
    **{f"graph_expand_hop{h}": f"{_BASE}, {seeds_sql()}, {expand_sql(h)} SELECT {_PATH_COLUMNS} FROM paths" for h in range(3)},
    **{f"graph_score_{a}": f"{_PATHS} SELECT query_id, candidate_id, round({x}, 9) AS graph_score FROM paths GROUP BY query_id, candidate_id" for a, x in _AGG.items()},
    "hybrid_pool": f"{_POOL} SELECT query_id, candidate_id, round(semantic_score, 7) AS semantic_score, round(graph_score, 9) AS graph_score, by_search, by_graph FROM pool",
    "pool_counts": f"{_POOL} SELECT query_id, count(*) AS pool_size, count(*) FILTER (by_search) AS semantic, count(*) FILTER (by_graph AND NOT by_search) AS graph_only FROM pool GROUP BY query_id",
    "evidence_nodes": f"{_EVIDENCE} SELECT query_id, candidate_id, node_id, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY o) AS place FROM en",
    "evidence_edges": f"{_EVIDENCE} SELECT query_id, candidate_id, source, target, relation, row_number() OVER (PARTITION BY query_id, candidate_id ORDER BY o) AS place FROM ee",
    "graph_features": f"{_EVIDENCE} SELECT * FROM gf",
    "numeric_features": f"""{_EVIDENCE} SELECT query_id, candidate_id, rank, round(semantic_score, 7) AS f_semantic, round(graph_score, 7) AS f_graph, round(fused, 7) AS f_score, round(ln(1 + node_count) / 5, 7) AS f_nodes,
        round(ln(1 + edge_count) / 5, 7) AS f_edges, round(ln(1 + path_count) / 3, 7) AS f_paths, round(best_path_hops / 10, 7) AS f_hops FROM ranked JOIN gf USING (query_id, candidate_id)""",
    "pointwise_rerank_zero_head": f"{_RANKED} SELECT query_id, candidate_id, round(fused, 7) AS neural_score, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, candidate_id) AS neural_rank FROM ranked QUALIFY neural_rank <= 10",
    "instance_local_rank": f"{_LOCAL} SELECT query_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, candidate_id) AS rank, round(f, 7) AS score FROM f",
    "llm_passthrough_rerank": f"{_RANKED} SELECT query_id, candidate_id, (count(*) OVER (PARTITION BY query_id) - rank + 1)::DOUBLE AS llm_score, rank AS llm_rank FROM ranked QUALIFY llm_rank <= 10",
    "llm_partial_response_merge": f"""{_RANKED}, o AS (SELECT query_id, candidate_id, count(*) OVER (PARTITION BY query_id) AS n, row_number() OVER (PARTITION BY query_id ORDER BY rank % 2, CASE WHEN rank % 2 = 0 THEN -rank ELSE rank END) AS llm_rank FROM ranked)
        SELECT query_id, candidate_id, (n - llm_rank + 1)::DOUBLE AS llm_score, llm_rank FROM o WHERE llm_rank <= 10""",
}
