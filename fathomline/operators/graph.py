"""Knowledge and citation graphs as tables of nodes, links (candidate to node) and edges (node to node)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize_entity, terms

MENTIONS, RELATED = "mentions", "related_to"


@dataclass
class Graph:
    """nodes: node_id, node_type, text.  links: candidate_id, node_id, relation, weight.  edges: source, target, relation, weight."""

    nodes: DataFrame
    links: DataFrame
    edges: DataFrame


def first_wins(df: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One row a key: that which came first."""
    rest = [c for c in df.columns if c not in (*keys, seq)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), seq).alias("_r")).select(*keys, "_r.*") if rest else df.select(*keys).distinct()


def mapped_records(records: DataFrame, corpus: DataFrame) -> DataFrame:
    """Records with the paragraphs they belong to: by id, else by normalised title (to every paragraph of that title)."""
    ids = corpus.select(F.col("candidate_id").alias("_c"))
    by_id = records.join(ids, F.col("id") == F.col("_c")).withColumnRenamed("_c", "candidate_id")
    rest = records.join(ids, F.col("id") == F.col("_c"), "left_anti")
    titles = corpus.select("candidate_id", normalize_entity(F.col("title")).alias("_t"))
    by_title = rest.withColumn("_t", normalize_entity(F.coalesce("title", "id"))).join(titles, "_t").drop("_t")
    return by_id.unionByName(by_title, allowMissingColumns=True)


def knowledge_graph(records: DataFrame, corpus: DataFrame, seq: str) -> Graph:
    """Graph of extracted records: id, title, entities (entity_name, entity_type, description), relationships (src_id,
    tgt_id, keywords, description).

    Records without a paragraph are skipped; the first description of an entity wins; an entity is linked to each
    paragraph once; a relation holds if both ends are among the record's own entities, is stored in both directions
    with the paragraph in its key, and has the keywords as its name (``related_to`` where they are empty).
    """
    rows = mapped_records(records, corpus)
    entities = rows.select("candidate_id", F.col(seq).alias("_seq"), F.posexplode("entities").alias("_p", "e"))
    entities = entities.select("candidate_id", normalize_entity(F.col("e.entity_name")).alias("node_id"), F.col("e.entity_type").alias("node_type"), F.col("e.description").alias("text"), F.struct("_seq", "candidate_id", "_p").alias("_at")).where("node_id <> ''")
    nodes = first_wins(entities.select("node_id", "node_type", "text", "_at"), ["node_id"], "_at")
    links = entities.select("candidate_id", "node_id").distinct().select("candidate_id", "node_id", F.lit(MENTIONS).alias("relation"), F.lit(1.0).alias("weight"))
    own = F.transform("entities", lambda e: normalize_entity(e["entity_name"]))
    rel = rows.select("candidate_id", "id", "title", own.alias("_own"), F.explode("relationships").alias("r"))
    end = lambda c: normalize_entity(F.when(F.col(c) == F.col("id"), F.col("title")).otherwise(F.col(c)))
    rel = rel.select("candidate_id", "_own", end("r.src_id").alias("source"), end("r.tgt_id").alias("target"), F.coalesce(F.nullif(F.trim("r.keywords"), F.lit("")), F.lit(RELATED)).alias("relation"))
    rel = rel.where(F.array_contains("_own", F.col("source")) & F.array_contains("_own", F.col("target"))).drop("_own")
    edges = rel.unionByName(rel.select("candidate_id", F.col("target").alias("source"), F.col("source").alias("target"), "relation")).distinct()
    return Graph(nodes, links, edges.select("source", "target", "relation", F.col("candidate_id").alias("paragraph_id"), F.lit(1.0).alias("weight")))


def citation_graph(papers: DataFrame, corpus: DataFrame, forbidden: DataFrame, reverse: bool = True) -> Graph:
    """Papers as proxy nodes with their authors, fields and references.

    papers: paper_id, authors, fields, references (arrays of strings).  Every candidate is represented by a node of its
    own (weight 1).  A reference counts if its target is in the corpus and another paper; a forbidden paper keeps its
    authors and fields but not its outgoing references; ``cited_by`` is the reverse of every reference that counts.
    """
    cand = lambda c: F.concat(F.lit("candidate::"), c)
    ids = corpus.select(F.col("candidate_id").cast("string").alias("candidate_id"))
    held = papers.withColumn("candidate_id", F.col("paper_id").cast("string")).join(ids, "candidate_id", "left_semi")
    link = lambda node, relation: (F.col("candidate_id"), node.alias("node_id"), F.lit(relation).alias("relation"), F.lit(1.0).alias("weight"))
    represents = ids.select(*link(cand(F.col("candidate_id")), "represents"))
    authors = held.select("candidate_id", F.explode("authors").alias("a")).where("trim(a) <> ''").select(*link(F.concat(F.lit("author::"), F.trim("a")), "authored_by"))
    fields = held.select("candidate_id", F.explode("fields").alias("f")).where("trim(f) <> ''").select(*link(F.concat(F.lit("field::"), F.lower(F.trim("f"))), "has_field"))
    refs = held.join(forbidden.select(F.col("candidate_id").cast("string")).distinct(), "candidate_id", "left_anti").select("candidate_id", F.explode("references").alias("t"))
    refs = refs.join(ids.withColumnRenamed("candidate_id", "t"), "t", "left_semi").where("t <> candidate_id").distinct()
    edges = refs.select(cand(F.col("candidate_id")).alias("source"), cand(F.col("t")).alias("target"), F.lit("cites").alias("relation"), F.lit(1.0).alias("weight"))
    if reverse:
        edges = edges.unionByName(edges.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("cited_by").alias("relation"), "weight"))
    links = represents.unionByName(authors).unionByName(fields).distinct()
    nodes = links.select("node_id").distinct().select("node_id", F.substring_index("node_id", "::", 1).alias("node_type"), F.substring_index("node_id", "::", -1).alias("text"))
    return Graph(nodes, links, edges)


def citation_counts(papers: DataFrame, corpus: DataFrame, forbidden: DataFrame) -> DataFrame:
    """One row of counters of a citation graph's build: papers inside and outside the corpus, links that were found
    (repeats included), references that count, and papers and references that were skipped as forbidden."""
    ids = corpus.select(F.col("candidate_id").cast("string").alias("paper_id")).distinct().withColumn("_in", F.lit(True))
    no = forbidden.select(F.col("candidate_id").cast("string").alias("paper_id")).distinct().withColumn("_no", F.lit(True))
    rows = papers.join(ids, "paper_id", "left").join(no, "paper_id", "left")
    size = lambda c: F.coalesce(F.sum(F.when(F.col("_in"), F.size(F.filter(c, lambda x: F.trim(x) != "")))), F.lit(0))
    flags = F.col("_in") & F.col("_no")
    own = rows.agg(
        F.count_if("_in").alias("papers_in_corpus"), F.count_if(F.col("_in").isNull()).alias("papers_outside_corpus"), size("authors").alias("author_links"), size("fields").alias("field_links"),
        F.count_if(flags).alias("forbidden_papers"), F.coalesce(F.sum(F.when(flags, F.size("references"))), F.lit(0)).alias("skipped_references"),
    )
    refs = rows.where("_in and _no is null").select("paper_id", F.explode("references").alias("t"))
    cited = refs.join(ids.select(F.col("paper_id").alias("t")), "t", "left_semi").where("t <> paper_id").agg(F.count("*").alias("citations"))
    return own.crossJoin(F.broadcast(cited))  # one row each


def lexical_links(df: DataFrame, item: str, text: str, limit: int = 10, stop_words: list[str] | None = None) -> DataFrame:
    """The ``limit`` most frequent terms of every text as nodes: (candidate_id, node_id, tf, rank), by -tf, then term."""
    rows = df.select(F.col(item).alias("candidate_id"), F.explode(terms(F.col(text), stop_words)).alias("term")).groupBy("candidate_id", "term").agg(F.count("*").alias("tf"))
    by = Window.partitionBy("candidate_id").orderBy(F.desc("tf"), "term")
    ranked = rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)
    return ranked.select("candidate_id", F.concat(F.lit("lexical::"), "term").alias("node_id"), "tf", "rank")


def capped(df: DataFrame, key: str, order: list[Column], limit: int, position: str = "place") -> DataFrame:
    """The first ``limit`` rows of every key: applied once to the static graph, so that no hub is ever walked whole."""
    by = Window.partitionBy(key).orderBy(*order)
    return df.withColumn(position, F.row_number().over(by)).where(F.col(position) <= limit)


def capped_links(links: DataFrame, limit: int) -> DataFrame:
    """Candidates of every node, heaviest first."""
    return capped(links, "node_id", [F.desc("weight"), F.col("candidate_id"), F.col("relation")], limit)


def capped_edges(edges: DataFrame, limit: int) -> DataFrame:
    """Neighbours of every node, heaviest first; the same pair and relation from several paragraphs counts once."""
    once = edges.groupBy("source", "target", "relation").agg(F.max("weight").alias("weight"))
    return capped(once, "source", [F.desc("weight"), F.col("target"), F.col("relation")], limit)


def undirected(edges: DataFrame, seq: str) -> DataFrame:
    """One edge a pair of nodes, in both directions; of several the last payload wins."""
    a, b = F.least("source", "target"), F.greatest("source", "target")
    one = edges.groupBy(a.alias("source"), b.alias("target")).agg(F.max_by("relation", seq).alias("relation"))
    return one.unionByName(one.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation").where("source <> target"))


def shortest_paths(seeds: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(query_id, source, node, distance): fewest steps, at most ``hops``, within a query's own graph.

    edges: query_id, source, target (both directions).  Where several paths are shortest, only their length is defined.
    """
    found = seeds.select("query_id", F.col("node").alias("source"), "node", F.lit(0).alias("distance"))
    front = found
    for d in range(1, hops + 1):
        step = front.join(edges.select("query_id", F.col("source").alias("node"), F.col("target").alias("_n")), ["query_id", "node"]).select("query_id", "source", F.col("_n").alias("node"), F.lit(d).alias("distance")).distinct()
        front = step.join(found.select("query_id", "source", "node"), ["query_id", "source", "node"], "left_anti")
        found = found.unionByName(front)
    return found


def names_by_id(ids: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes' types and texts; ids without a node get the id as text and the type ``graph_node``."""
    out = ids.join(nodes.select("node_id", F.col("node_type").alias("_k"), F.col("text").alias("_t")), "node_id", "left")
    return out.withColumn("node_type", F.coalesce("_k", F.lit("graph_node"))).withColumn("text", F.coalesce(F.nullif("_t", F.lit("")), F.col("node_id"))).drop("_k", "_t")
