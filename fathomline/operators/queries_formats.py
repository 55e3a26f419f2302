"""Queries that go through the raw formats and the small parts of the pipeline, with their SQL.

Formats are checked by a round trip: a table is written in the raw form, in the folder shared by the cluster, and read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..plans import local
from ..plans.datasets import ParquetStore
from ..plans.stage import new_path, stage
from ..sources import derived, protocol, readers, resume, sinks
from ..sources.tables import table
from . import corpus as cp
from . import embedders, extract, pool, rankers, rerank
from .graph import citation_counts, knowledge_graph, names_by_id, undirected
from .queries_ranking import CORPUS, GRAPH, norm_sql, strip_sql


def _array(df: DataFrame, keyed: str | None = None) -> str:
    """One file that holds a JSON array of the rows, or a map by ``keyed``.  The format makes it one task."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "array.json")
    body = df.select(F.col(keyed).alias("k") if keyed else F.lit(None).cast("string").alias("k"), F.to_json(F.struct(*df.columns)).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        first = True
        for b in batches:
            text = [("" if k is None else json.dumps(k) + ": ") + v for k, v in zip(b.column("k").to_pylist(), b.column("v").to_pylist())]
            text = [("" if first and i == 0 else ",") + t for i, t in enumerate(text)]
            if first and text:
                text[0] = ("{" if keyed else "[") + "\n" + text[0]
                first = False
            yield pa.RecordBatch.from_arrays([pa.array(text, pa.string())], names=["value"])
        yield pa.RecordBatch.from_arrays([pa.array([("" if not first else "{" if keyed else "[") + ("}" if keyed else "]")])], names=["value"])

    body.coalesce(1).mapInArrow(run, "value string").write.text(path)
    return next(f for f in spark.read.text(path).inputFiles())


def _lines(df: DataFrame) -> str:
    path = new_path(df.sparkSession, "lines.jsonl")
    df.write.json(path)
    return path


def _text(df: DataFrame, *columns, sep: str) -> str:
    path = new_path(df.sparkSession, "text")
    df.select(F.concat_ws(sep, *columns)).write.text(path)
    return path


# ---- Readers and sinks -----------------------------------------------------------------------------------------------


def read_json_array(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "hotpot_tiny").select("id", "question", "answer", "type", "level", "supporting_facts", "context")
    return readers.questions(spark, _array(rows)).select("id", "question", "answer", "level", F.size("context.title").alias("titles"), F.size("supporting_facts.title").alias("supporting"))


def read_results(spark: SparkSession, d: str) -> DataFrame:
    ranked = derived.ranking(spark, d).withColumnRenamed("score", "semantic_score").withColumn("evidence_nodes", F.array(F.struct(F.col("candidate_id").alias("node_id"), F.lit("candidate").alias("node_type"), F.lit("t").alias("text"))))
    asked = ranked.select("query_id", F.col("query_id").alias("text")).distinct()
    path = _lines(sinks.nested_results(ranked, asked, derived.judgements(spark, d), "retrieval"))
    rows = readers.results(spark, path).select("query_id", "stage", F.size("positive_ids").alias("positives"), F.explode("candidates").alias("c"))
    return rows.select("query_id", "stage", "positives", "c.candidate_id", "c.rank", "c.semantic_score", F.col("c.evidence_nodes")[0]["node_id"].alias("first_node"))


def read_corpus_v2(spark: SparkSession, d: str) -> DataFrame:
    c = derived.corpus(spark, d).select("candidate_id", "text", F.when(F.length("title") % 2 == 0, F.col("title")).alias("embedding_text"), F.struct("title").alias("metadata"), "sources")
    return readers.corpus(spark, _lines(c)).select("candidate_id", "title", F.md5("text").alias("text_md5"), F.md5("embedding_text").alias("embedded_md5"))


def read_corpus_v1(spark: SparkSession, d: str) -> DataFrame:
    c = derived.corpus(spark, d).select(F.col("candidate_id").alias("paragraph_id"), "title", "text", "sources")
    return readers.corpus(spark, _lines(c)).select("candidate_id", "title", F.md5("text").alias("text_md5"), F.md5("embedding_text").alias("embedded_md5"))


def read_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("candidate_id", "text", "sources", F.struct(F.size("embedding").alias("n")).alias("metadata"))
    return readers.candidates(spark, _lines(rows)).select("candidate_id", F.md5("text").alias("text_md5"), F.size("sources").alias("n_sources"), F.get_json_object("metadata", "$.n").cast("int").alias("n"))


def read_beir_queries(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "queries")
    rows = q.select(F.when(F.col("user_id").isNull(), F.col("query_id")).alias("_id"), F.when(F.col("user_id").isNotNull(), F.col("query_id")).alias("query_id"), F.when(F.length("text") % 3 > 0, F.col("text")).alias("text"))
    return readers.beir_queries(spark, _lines(rows)).select("query_id", "text")


def _judged(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "generated_candidates").where("query_id is not null and candidate_id is not null and graph_score is not null and not isnan(graph_score)")
    return g.select("query_id", "candidate_id", F.floor("graph_score").cast("string").alias("score"))


def read_beir_qrels(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "qrels.tsv")
    _judged(spark, d).select(F.col("query_id").alias("query-id"), F.col("candidate_id").alias("corpus-id"), "score").write.option("sep", "\t").option("header", True).csv(path)
    return cp.qrels(readers.beir_qrels(spark, path), "query_id", "candidate_id", F.col("score"), "seq").select("query_id", "candidate_id")


def read_trec_qrels(spark: SparkSession, d: str) -> DataFrame:
    rows = _judged(spark, d)
    path = _text(rows, F.col("query_id"), F.lit("0"), F.col("candidate_id"), F.when(F.col("score") == "0", F.lit("none")).otherwise(F.col("score")), sep=" \t")
    return readers.trec_qrels(spark, path).groupBy("query_id", "candidate_id").agg(F.max("score").alias("score"))


def read_clicks(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark, "clicks.csv")
    _judged(spark, d).select("query_id", F.col("candidate_id").alias("clicked_id"), "score").write.option("header", True).csv(path)
    return readers.clicks(spark, path).groupBy("query_id", "candidate_id").agg(F.count("*").alias("clicks"))


def read_paper_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Papers of two files, a list and lines, merged in their order."""
    rows = table(spark, d, "paragraphs").where("title is not null").select(tx.normalize_entity(F.col("title")).alias("paper_id"), F.col("text").alias("abstract"), "title", "record_id", "split")
    cut = stage(rows, "papers")
    one = _array(cut.where("split = 'train'").repartition(1).sortWithinPartitions("record_id"))
    two = _lines(cut.where("split is null or split <> 'train'").repartition(1).sortWithinPartitions("record_id"))
    return readers.paper_metadata(spark, [one, two]).select("paper_id", F.md5("text").alias("text_md5"))


def read_enrichment(spark: SparkSession, d: str) -> DataFrame:
    q = derived.queries(spark, d)
    path = _array(q.select(F.col("query_id").alias("key"), F.array(F.struct(F.col("user_id").alias("authorId"))).alias("authors"), F.col("user_id").alias("topics"), F.col("seeds").alias("references")), "key")
    return readers.enrichment(spark, [path]).select("paper_id", F.array_join("authors", "|").alias("authors"), F.array_join("fields", "|").alias("fields"), F.size("references").alias("n_references"))


def _extraction_lines(spark: SparkSession, d: str) -> str:
    return _lines(derived.kg_records(spark, d).drop("seq").repartition(1).sortWithinPartitions("id"))


def read_extractions(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each title (the first entity's name), in the order of the files."""
    titles = table(spark, d, "entities").select(F.col("entity_id").alias("title"))
    return readers.extractions(spark, _extraction_lines(spark, d), titles).select("id", F.size("entities").alias("n_entities"))


def merge_extraction_shards(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.kg_records(spark, d).drop("seq")
    path = new_path(spark, "shards")
    rows.withColumn("part", resume.shard(F.col("id"), 5)).write.partitionBy("part").json(path)
    merged = sinks.merge_extractions(spark, f"{path}/part=*", readers.EXTRACTION, rows.count())
    return merged.select("id", F.size("relationships").alias("n_relationships"))


def read_beir_corpus(spark: SparkSession, d: str) -> DataFrame:
    path = _lines(table(spark, d, "paragraphs").select(F.col("record_id").alias("_id"), "title", "text"))
    rows = readers.json_lines(spark, path, "_id string, title string, text string")
    return cp.corpus_texts(rows, "_id", "title", "text").select("candidate_id", F.md5("text").alias("text_md5"))


def corpus_write_digest(spark: SparkSession, d: str) -> DataFrame:
    """The digest of a written corpus is that of its rows, in any order and partitioning, and of no other rows."""
    c = stage(derived.corpus(spark, d), "corpus")
    path = new_path(spark, "corpus")
    first = sinks.write_corpus(c, path)
    again, other = sinks.digest(spark.read.parquet(path).repartition(7)), sinks.digest(c.withColumn("text", F.upper("text")))
    return spark.read.parquet(path).agg(F.count("*").alias("candidates")).select("candidates", F.lit(first == again).alias("same"), F.lit(first == other).alias("other"))


def append_resume(spark: SparkSession, d: str) -> DataFrame:
    """Deliveries by split, one after another: a record that is there is not appended again."""
    rows = table(spark, d, "hotpot_tiny").where("id is not null").select("id", "split")
    path, n = new_path(spark, "appended"), []
    for s in ("train", "validation", "test", "train"):
        n.append(sinks.append_missing(rows.where(F.col("split") == s).select("id").distinct(), path, "id"))
    return spark.read.parquet(path).groupBy("id").agg(F.count("*").alias("times")).withColumn("repeated", F.lit(n[-1]))


def resumed_shards(spark: SparkSession, d: str) -> DataFrame:
    """Half of the queries are written first; the rest of the shards' queries are asked again, and none is lost."""
    rows = table(spark, d, "queries").select("query_id", "text")
    path = new_path(spark, "shards")
    sinks.write_shards(rows.where("user_id is null"), path, "query_id", 8)
    sinks.write_shards(sinks.resume(spark, rows, path, "query_id", 8).drop("shard"), path, "query_id", 8)
    return spark.read.parquet(path).select("query_id", "shard")


def graph_store_counts(spark: SparkSession, d: str) -> DataFrame:
    store = ParquetStore(spark, new_path(spark, "store"))
    counts = store.write(derived.graph(spark, d))
    return store.open().nodes.agg(F.count("*").alias("nodes")).select("nodes", *(F.lit(counts[c]).cast("long").alias(c) for c in ("links", "edges")))


# ---- Functions -------------------------------------------------------------------------------------------------------


def id_prefixes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "entities").select("entity_id", F.when(F.length("entity_id") % 2 == 0, F.concat(F.lit("entity::"), "entity_id")).otherwise(F.col("entity_id")).alias("x"))
    return e.select("entity_id", tx.with_prefix("entity", F.col("x")).alias("prefixed"), tx.without_prefix("entity", F.col("x")).alias("bare"))


def payload_identifiers(spark: SparkSession, d: str) -> DataFrame:
    v = F.try_parse_json("payload")
    rows = table(spark, d, "paragraph_raw").select("record_id", v.alias("v"))
    return rows.where("v is not null").select("record_id", tx.identifier(F.col("v"), ["nothing", "title"]).alias("identifier"), tx.label(F.col("v"), ["title"]).alias("label"), F.size(tx.as_list(F.try_variant_get("v", "$.source", "variant"))).alias("n_sources"))


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paragraphs").where("text is not null")
    return rows.select("record_id", F.md5(tx.context(F.col("text"), F.lit(100), F.lit(120), 30)).alias("window_md5"), F.md5(tx.context(F.col("text"), F.lit(5), F.lit(9), 30)).alias("start_md5"))


def generated_triplets(spark: SparkSession, d: str) -> DataFrame:
    rows = derived.kg_records(spark, d).select("id", F.explode("relationships").alias("r")).groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("<triplet> "), "r.src_id", F.lit(" <subj> "), "r.keywords", F.lit(" <obj> "), "r.tgt_id"))), " ").alias("text")
    )
    return rows.select("id", F.explode(tx.triplets(F.col("text"))).alias("t")).select("id", "t.subject", "t.relation", "t.object")


def canonical_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "generated_candidates").select("query_id", "candidate_id").where("query_id is not null and candidate_id is not null").distinct()
    return rows.select("query_id", "candidate_id", tx.canonical_key(F.col("query_id"), F.col("candidate_id")).alias("key"))


def parsed_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies that are fenced, plain or cut off."""
    q = table(spark, d, "queries").select("query_id", F.length("text").alias("n"))
    body = F.concat(F.lit('{"ranking": [{"candidate_id": "'), "query_id", F.lit('"}]}'))
    reply = F.when(F.col("n") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(F.col("n") % 3 == 1, body).otherwise(F.expr("concat('```', query_id)"))
    return q.select("query_id", tx.parse_reply(reply, "ranking array<struct<candidate_id string>>")["ranking"][0]["candidate_id"].alias("first"))


def text_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "paragraphs").select("record_id", tx.first_text(F.col("title"), F.col("text"), F.col("record_id")).alias("text"), tx.joined(F.col("title"), F.col("source")).alias("joined"))
    return rows


# ---- Graph, evidence, ranking parts -------------------------------------------------------------------------------------


def kg_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Records whose id is no paragraph's are joined by their title, to every paragraph of it."""
    c = derived.corpus(spark, d)
    titles = c.select(tx.normalize_entity(F.col("title")).alias("title")).distinct()
    entity = F.struct(F.concat(F.lit("Entity Of "), "title").alias("entity_name"), F.lit("t").alias("entity_type"), F.lit("d").alias("description"))
    none = F.array().cast("array<struct<src_id: string, tgt_id: string, keywords: string, description: string>>")
    records = titles.select(F.concat(F.lit("unknown "), "title").alias("id"), F.upper("title").alias("title"), F.array(entity).alias("entities"), none.alias("relationships"), F.col("title").alias("seq"))
    return knowledge_graph(records, c, "seq").links.select("candidate_id", "node_id")


def node_names(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "entity_to_paragraphs").select(F.col("entity_id").alias("node_id")).unionByName(table(spark, d, "queries").select(F.col("query_id").alias("node_id"))).where("node_id is not null").distinct()
    nodes = table(spark, d, "entities").select(F.col("entity_id").alias("node_id"), F.col("entity_type").alias("node_type"), F.col("description").alias("text"))
    return names_by_id(ids, nodes)


def undirected_edges(spark: SparkSession, d: str) -> DataFrame:
    e = derived.graph(spark, d).edges.select("source", "target", F.concat_ws("|", "paragraph_id", F.least("source", "target")).alias("relation"))
    return undirected(e, "relation")


def citation_build_counts(spark: SparkSession, d: str) -> DataFrame:
    q = derived.queries(spark, d)
    papers = q.select(F.col("query_id").alias("paper_id"), F.when(F.col("user_id").isNotNull(), F.array("user_id")).otherwise(F.array().cast("array<string>")).alias("authors"), F.array().cast("array<string>").alias("fields"), F.coalesce("seeds", F.array().cast("array<string>")).alias("references"))
    held = q.where("user_id is not null").select(F.col("query_id").alias("candidate_id")).unionByName(derived.corpus(spark, d).select("candidate_id"))
    return citation_counts(papers, held, table(spark, d, "hotpot_tiny").where("split = 'test'").select(F.col("id").alias("candidate_id")))


def strict_lookup(spark: SparkSession, d: str) -> DataFrame:
    v = derived.corpus_vectors(spark, d)
    ids = derived.corpus(spark, d).select("candidate_id")
    got = embedders.strict_vectors(ids, v, "candidate_id")
    return got.agg(F.count("*").alias("candidates"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most"))


def split_projection(spark: SparkSession, d: str) -> DataFrame:
    """The ranking of the queries of one split; none may be missing."""
    r = derived.ranking(spark, d)
    ids = table(spark, d, "hotpot_tiny").where("split <> 'train'").select(F.col("id").alias("query_id"), F.col("id").alias("seq")).distinct().join(r.select("query_id").distinct(), "query_id", "left_semi")
    return protocol.project(r, ids).select("query_id", "candidate_id", "rank")


def llm_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    """Requests that the cache lacks after half of them were answered, and replies there are in the end."""
    r = derived.ranking(spark, d).where("rank <= 5")
    asked = stage(rerank.requests(r, table(spark, d, "queries"), derived.corpus(spark, d), "passthrough"), "requests")
    cache = stage(rerank.replies(asked.where(F.length("query_id") + F.ascii(F.substring("query_id", -1, 1)) > 0).where(F.substring("query_id", -1, 1) < "8"), rerank.passthrough)[1], "cache")
    got, misses = rerank.replies(asked, rerank.passthrough, cache)
    return got.agg(F.count("*").alias("replies"), F.sum(F.size("ranking")).alias("candidates")).crossJoin(F.broadcast(misses.agg(F.count("*").alias("misses"))))  # one row each


def _small_pool(spark: SparkSession, d: str) -> DataFrame:
    return derived.ranking(spark, d).select("query_id", "candidate_id", (F.col("rank") % 2 == 1).alias("by_search"), (F.col("rank") % 3 == 0).alias("by_graph"))


def pool_recall(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of each query's pool, and the share of its positives that the pool holds."""
    out = pool.pool_counts(_small_pool(spark, d), derived.judgements(spark, d))
    return out.withColumn("pool_recall", F.round("pool_recall", 9))


def retrieval_means(spark: SparkSession, d: str) -> DataFrame:
    p = stage(_small_pool(spark, d), "pool")
    out = pool.retrieval_stats(p, derived.ranking(spark, d).where("rank <= 5"), None, derived.judgements(spark, d))
    return out.select("queries", *(F.round(c, 7).alias(c) for c in out.columns if c != "queries"))


def pool_positives(spark: SparkSession, d: str) -> DataFrame:
    """What pool and judgements have in common."""
    return _small_pool(spark, d).select("query_id", "candidate_id").intersect(derived.judgements(spark, d))


def protocol_splits(spark: SparkSession, d: str) -> DataFrame:
    """Instances of the development protocol, train before validation, without forbidden queries, to a limit."""
    h = table(spark, d, "hotpot_tiny").where("id is not null").select(F.col("id").alias("query_id"), F.col("id").alias("seq"), F.col("split").alias("s")).distinct()
    parts = {s: h.where(F.col("s") == s).drop("s") for s in ("train", "validation", "test")}
    forbidden = protocol.forbidden_ids(parts["test"], table(spark, d, "queries").where("user_id is null").select("query_id"))
    return protocol.select("development", "all", parts, forbidden, 10_000_000).select("query_id", "split")


def limited_instances(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred instances of the protocol: the limit is the feature."""
    h = table(spark, d, "hotpot_tiny").where("id is not null").select(F.col("id").alias("query_id"), F.col("id").alias("seq"), F.col("split").alias("s")).distinct()
    parts = {s: h.where(F.col("s") == s).drop("s") for s in ("train", "validation", "test")}
    return protocol.select("development", "all", parts, None, 100).select("query_id", "split")


def forbidden_set(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hotpot_tiny")
    return protocol.forbidden_ids(h.where("split = 'test'").select(F.col("id").alias("query_id")), None, table(spark, d, "queries").where("user_id is null").select("query_id"))


def positive_coverage_by_split(spark: SparkSession, d: str) -> DataFrame:
    """By split: questions, and those without a supporting title in their own context (a test protocol may have none)."""
    q = table(spark, d, "hotpot_tiny").where("id is not null").groupBy("id").agg(F.min("split").alias("split")).withColumnRenamed("id", "query_id")
    with_one = cp.instances(table(spark, d, "hotpot_tiny")).where("positive").select("query_id").distinct().withColumn("has", F.lit(True))
    return q.join(with_one, "query_id", "left").groupBy("split").agg(F.count("*").alias("queries"), F.count_if(F.col("has").isNull()).alias("without_positive"))


def local_graph_titles(spark: SparkSession, d: str) -> DataFrame:
    """Each question's graph where titles stand in for missing records."""
    return local.local_graph(local.project_rows(spark, d)[0], None, lexical=False)[1]


def local_graph_records(spark: SparkSession, d: str) -> DataFrame:
    """Each question's graph of records made by rule from its paragraphs: mentions only."""
    rows, _ = local.project_rows(spark, d)
    once = rows.groupBy(tx.normalize_entity(F.col("title")).alias("t")).agg(F.min_by(F.struct("title", "text"), F.struct("candidate_id", "query_id")).alias("r")).select("t", "r.*")
    made = extract.records(extract.by_rule(once, "t", "title", "text"))
    return local.local_graph(rows, made)[1].where("relation = 'mentions'").groupBy("query_id").agg(F.count("*").alias("mentions"))


def _ranker_rows(spark: SparkSession, d: str) -> DataFrame:
    """Seven numbers a candidate; the score is a multiple of 1/1024, so that single precision keeps it."""
    r = derived.ranking(spark, d).withColumn("s", F.floor(F.col("score") * 1024) / 1024)
    y = derived.judgements(spark, d).withColumn("label", F.lit(1.0))
    r = r.join(y, ["query_id", "candidate_id"], "left").na.fill(0.0, ["label"])
    zero = F.lit(0.0)
    return r.select("query_id", "candidate_id", "rank", F.array(zero, zero, F.col("s"), zero, zero, zero, zero).alias("features"), "label", rankers.hash_side(F.col("query_id"), 0.25, 13).alias("side"))


def ranker_dataset(spark: SparkSession, d: str) -> DataFrame:
    """What a ranker's dataset holds of each query: side, candidates, positives, sum of the features."""
    path = new_path(spark, "ranker")
    rankers.prepare(_ranker_rows(spark, d), path, k=50, dtype="float32")
    out = None
    for side in ("train", "validation"):
        part = rankers.dataset(spark, path, side).select("query_id", F.lit(side).alias("side"), F.size("candidate_ids").alias("candidates"), F.aggregate("labels", F.lit(0.0), lambda s, x: s + x).alias("positives"), (F.length("features") / 4).cast("int").alias("numbers"))
        out = part if out is None else out.unionByName(part)
    return out


def ranker_inference(spark: SparkSession, d: str) -> DataFrame:
    """The untrained pointwise model, through dataset and inference: its order is that of the score."""
    path = new_path(spark, "ranker")
    rankers.prepare(_ranker_rows(spark, d), path, k=50, dtype="float32")
    model = rankers.Ranker(7, "mlp", hidden=16)
    one, two = (rankers.rank_dataset(spark, path, s, model, 10) for s in ("train", "validation"))
    return one.unionByName(two).select("query_id", "candidate_id", "neural_score", "neural_rank", F.size("representation").alias("representation"))


def dense_places(spark: SparkSession, d: str) -> DataFrame:
    """The row of each candidate in the order of the ids, and back: addressable rows."""
    from ..plans.skew import ranked

    c = derived.corpus(spark, d).select("candidate_id").withColumn("g", F.lit(0))
    return ranked(c, ["g"], [F.col("candidate_id")], "place").select("candidate_id", "place")


_Q = "WITH o AS (SELECT id, min(split) AS split FROM hotpot_tiny WHERE id IS NOT NULL GROUP BY id)"
_J = f"""{CORPUS}, qrels AS (SELECT DISTINCT id AS query_id, candidate_id FROM (SELECT id, unnest(supporting_facts.title) AS title FROM hotpot_tiny WHERE id IS NOT NULL) JOIN corpus USING (title)),
    b AS (SELECT query_id, candidate_id, max(semantic_score) AS score FROM generated_candidates WHERE semantic_score IS NOT NULL AND CAST(semantic_score AS VARCHAR) <> 'nan' GROUP BY ALL),
    ranking AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, candidate_id) AS rank FROM b),
    p AS (SELECT query_id, candidate_id, rank % 2 = 1 AS by_search, rank % 3 = 0 AS by_graph FROM ranking)"""
_G = "g AS (SELECT query_id, candidate_id, floor(graph_score)::BIGINT AS score FROM generated_candidates WHERE query_id IS NOT NULL AND candidate_id IS NOT NULL AND graph_score IS NOT NULL AND CAST(graph_score AS VARCHAR) <> 'nan')"
_R = "r AS (SELECT DISTINCT entity_id, paragraph_id FROM entity_to_paragraphs WHERE entity_id IS NOT NULL AND paragraph_id IS NOT NULL)"
_INSTANCES = f"""o AS (SELECT * FROM hotpot_tiny WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at NULLS FIRST, question NULLS FIRST) = 1),
    u AS (SELECT id AS query_id, i AS pos, context.title[i + 1] AS title, {strip_sql("array_to_string(context.sentences[i + 1], chr(10))")} AS text, supporting_facts.title AS s FROM (SELECT *, unnest(range(least(len(context.title), len(context.sentences)))) AS i FROM o)),
    i AS (SELECT query_id, sha1({strip_sql('title')} || chr(10) || text) AS candidate_id, min(title) AS title, min(text) AS text, bool_or(coalesce(list_contains(s, title), false)) AS positive FROM u GROUP BY ALL)"""
_SIDE = "CASE WHEN ('0x' || substr(sha1('13:' || query_id), 1, 16))::UBIGINT < 4611686018427387904 THEN 'validation' ELSE 'train' END"
_TESTS = "SELECT id FROM hotpot_tiny WHERE split = 'test'"

QUERIES = {
    f.__name__: f
    for f in (
        read_json_array, read_results, read_corpus_v2, read_corpus_v1, read_candidates, read_beir_queries, read_beir_qrels, read_trec_qrels, read_clicks, read_paper_metadata, read_enrichment, read_extractions,
        merge_extraction_shards, read_beir_corpus, corpus_write_digest, append_resume, resumed_shards, graph_store_counts, id_prefixes, payload_identifiers, context_windows, generated_triplets, canonical_keys,
        parsed_replies, text_fallbacks, kg_by_title, node_names, undirected_edges, citation_build_counts, strict_lookup, split_projection, llm_cache_misses, pool_recall, retrieval_means, pool_positives, protocol_splits,
        limited_instances, forbidden_set, positive_coverage_by_split, local_graph_titles, local_graph_records, ranker_dataset, ranker_inference, dense_places,
    )
}
SQL = {
    "read_json_array": "SELECT id, question, answer, level, len(context.title) AS titles, len(supporting_facts.title) AS supporting FROM hotpot_tiny",
    "read_results": f"WITH {_J}, n AS (SELECT query_id, count(*) AS n FROM qrels GROUP BY query_id) SELECT query_id, 'retrieval' AS stage, coalesce(n, 0) AS positives, candidate_id, rank, score AS semantic_score, candidate_id AS first_node FROM ranking LEFT JOIN n USING (query_id)",
    "read_corpus_v2": f"WITH {CORPUS} SELECT candidate_id, title, md5(text) AS text_md5, md5(CASE WHEN length(title) % 2 = 0 THEN title ELSE text END) AS embedded_md5 FROM corpus",
    "read_corpus_v1": f"WITH {CORPUS} SELECT candidate_id, title, md5(text) AS text_md5, md5({strip_sql('title || chr(10) || text')}) AS embedded_md5 FROM corpus",
    "read_candidates": "SELECT candidate_id, md5(text) AS text_md5, len(sources) AS n_sources, len(embedding) AS n FROM candidates",
    "read_beir_queries": f"SELECT query_id, CASE WHEN length(text) % 3 > 0 AND {strip_sql('text')} <> '' THEN {strip_sql('text')} ELSE query_id END AS text FROM queries",
    "read_beir_qrels": f"WITH {_G} SELECT DISTINCT query_id, candidate_id FROM g WHERE score > 0",
    "read_trec_qrels": f"WITH {_G} SELECT query_id, candidate_id, max(score)::INT AS score FROM g WHERE score <> 0 GROUP BY ALL",
    "read_clicks": f"WITH {_G} SELECT query_id, candidate_id, count(*) AS clicks FROM g GROUP BY ALL",
    "read_paper_metadata": f"""WITH k AS (SELECT {norm_sql('title')} AS key, (CASE WHEN split = 'train' THEN '0' ELSE '1' END) || record_id AS record_id, {strip_sql('text')} AS text FROM paragraphs WHERE title IS NOT NULL),
        l AS (SELECT key, record_id, nullif(text, '') AS text, coalesce(length(nullif(text, '')), 0) AS n FROM k WHERE key <> ''),
        m AS (SELECT *, max(n) OVER (PARTITION BY key ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM l)
        SELECT key AS paper_id, md5(arg_max(text, record_id) FILTER (text IS NOT NULL)) AS text_md5 FROM m WHERE most IS NULL OR n > most GROUP BY key""",
    "read_enrichment": "SELECT query_id AS paper_id, coalesce(user_id, '') AS authors, coalesce(user_id, '') AS fields, len(coalesce(seed_candidate_ids, [])) AS n_references FROM queries",
    "read_extractions": f"WITH {_R}, f AS (SELECT paragraph_id, {norm_sql('min(entity_id)')} AS t, count(*) AS n FROM r GROUP BY paragraph_id), k AS (SELECT DISTINCT {norm_sql('entity_id')} AS t FROM entities) SELECT arg_max(paragraph_id, paragraph_id) AS id, arg_max(n, paragraph_id) AS n_entities FROM f SEMI JOIN k USING (t) GROUP BY t",
    "merge_extraction_shards": f"WITH {_R} SELECT paragraph_id AS id, count(*) - 1 AS n_relationships FROM r GROUP BY paragraph_id",
    "read_beir_corpus": f"SELECT record_id AS candidate_id, md5(concat_ws(chr(10), nullif({strip_sql('title')}, ''), nullif({strip_sql('text')}, ''))) AS text_md5 FROM paragraphs",
    "corpus_write_digest": f"WITH {CORPUS} SELECT count(*) AS candidates, true AS same, false AS other FROM corpus",
    "append_resume": "SELECT DISTINCT id, 1 AS times, 0 AS repeated FROM hotpot_tiny WHERE id IS NOT NULL AND split IN ('train', 'validation', 'test')",
    "resumed_shards": "SELECT query_id, (('0x' || substr(md5(query_id), 1, 15))::UBIGINT % 8)::INT AS shard FROM queries",
    "graph_store_counts": f"WITH {CORPUS}, {GRAPH} SELECT (SELECT count(DISTINCT node_id) FROM links) AS nodes, (SELECT count(*) FROM links) AS links, (SELECT count(*) FROM edges) AS edges",
    "id_prefixes": "SELECT entity_id, 'entity::' || entity_id AS prefixed, entity_id AS bare FROM entities",
    "payload_identifiers": """WITH v AS (SELECT record_id, payload FROM paragraph_raw WHERE json_valid(payload))
        SELECT record_id, nullif(trim(payload->>'$.title'), '') AS identifier, coalesce(nullif(trim(payload->>'$.name'), ''), nullif(trim(payload->>'$.label'), ''), nullif(trim(payload->>'$.title'), '')) AS label,
            CASE WHEN json_type(payload, '$.source') IS NULL OR json_type(payload, '$.source') = 'NULL' THEN 0 WHEN json_type(payload, '$.source') = 'ARRAY' THEN json_array_length(payload, '$.source') ELSE 1 END AS n_sources FROM v""",
    "context_windows": "SELECT record_id, md5(substr(text, 71, 80)) AS window_md5, md5(substr(text, 1, 39)) AS start_md5 FROM paragraphs WHERE text IS NOT NULL",
    "generated_triplets": f"WITH {_R} SELECT id, subject, 'next_to' AS relation, object FROM (SELECT paragraph_id AS id, trim(entity_id) AS subject, trim(lead(entity_id) OVER (PARTITION BY paragraph_id ORDER BY entity_id)) AS object FROM r) WHERE object IS NOT NULL",
    "canonical_keys": """SELECT DISTINCT query_id, candidate_id, sha256('{"k00":"' || query_id || '","k01":"' || candidate_id || '"}') AS key FROM generated_candidates WHERE query_id IS NOT NULL AND candidate_id IS NOT NULL""",
    "parsed_replies": "SELECT query_id, CASE WHEN length(text) % 3 < 2 THEN query_id END AS first FROM queries",
    "text_fallbacks": f"SELECT record_id, coalesce(nullif({strip_sql('title')}, ''), nullif({strip_sql('text')}, ''), nullif({strip_sql('record_id')}, '')) AS text, concat_ws(chr(10), nullif({strip_sql('title')}, ''), nullif({strip_sql('source')}, '')) AS joined FROM paragraphs",
    "kg_by_title": f"WITH {CORPUS} SELECT candidate_id, 'entity of ' || {norm_sql('title')} AS node_id FROM corpus",
    "node_names": "WITH i AS (SELECT entity_id AS node_id FROM entity_to_paragraphs WHERE entity_id IS NOT NULL UNION SELECT query_id FROM queries) SELECT node_id, coalesce(entity_type, 'graph_node') AS node_type, coalesce(nullif(description, ''), node_id) AS text FROM i LEFT JOIN entities ON entity_id = node_id",
    "undirected_edges": f"""WITH {CORPUS}, {GRAPH}, e AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(paragraph_id || '|' || least(source, target)) AS relation FROM edges GROUP BY ALL)
        SELECT a AS source, b AS target, relation FROM e UNION ALL SELECT b, a, relation FROM e WHERE a <> b""",
    "citation_build_counts": f"""WITH {CORPUS}, held AS (SELECT query_id AS c FROM queries WHERE user_id IS NOT NULL UNION SELECT candidate_id FROM corpus), x AS (SELECT *, query_id IN (SELECT c FROM held) AS inside, query_id IN ({_TESTS}) AS no FROM queries)
        SELECT count(*) FILTER (inside) AS papers_in_corpus, count(*) FILTER (NOT inside) AS papers_outside_corpus, count(*) FILTER (inside AND trim(user_id) <> '') AS author_links, 0 AS field_links, count(*) FILTER (inside AND no) AS forbidden_papers,
            coalesce(sum(len(seed_candidate_ids)) FILTER (inside AND no), 0)::BIGINT AS skipped_references, (SELECT count(*) FROM (SELECT query_id, unnest(seed_candidate_ids) AS t FROM x WHERE inside AND NOT no) WHERE t IN (SELECT c FROM held) AND t <> query_id) AS citations FROM x""",
    "strict_lookup": f"WITH {CORPUS} SELECT count(*) AS candidates, {derived.DIM} AS least, {derived.DIM} AS most FROM corpus",
    "split_projection": f"WITH {_J} SELECT query_id, candidate_id, rank FROM ranking WHERE query_id IN (SELECT id FROM hotpot_tiny WHERE split <> 'train')",
    "llm_cache_misses": f"WITH {_J}, t AS (SELECT query_id, count(*) AS n FROM ranking WHERE rank <= 5 GROUP BY query_id) SELECT count(*) AS replies, sum(n)::BIGINT AS candidates, count(*) FILTER (NOT right(query_id, 1) < '8') AS misses FROM t",
    "pool_recall": f"""WITH {_J}, c AS (SELECT query_id, count(*) AS pool_size, count(*) FILTER (by_search) AS semantic, count(*) FILTER (by_graph AND NOT by_search) AS graph_only FROM p GROUP BY query_id),
        t AS (SELECT q.query_id, count(p.candidate_id) / count(*) AS r FROM qrels q LEFT JOIN p USING (query_id, candidate_id) GROUP BY q.query_id) SELECT c.*, round(coalesce(r, 0), 9) AS pool_recall FROM c LEFT JOIN t USING (query_id)""",
    "retrieval_means": f"""WITH {_J}, c AS (SELECT query_id, count(*) AS pool_size, count(*) FILTER (by_search) AS semantic, count(*) FILTER (by_graph AND NOT by_search) AS graph_only FROM p GROUP BY query_id),
        t AS (SELECT q.query_id, count(p.candidate_id) / count(*) AS r FROM qrels q LEFT JOIN p USING (query_id, candidate_id) GROUP BY q.query_id), k AS (SELECT q.query_id, count(x.candidate_id) / count(*) AS r FROM qrels q LEFT JOIN (SELECT * FROM ranking WHERE rank <= 5) x USING (query_id, candidate_id) GROUP BY q.query_id)
        SELECT count(*) AS queries, round(avg(pool_size), 7) AS mean_pool_size, round(avg(semantic), 7) AS mean_semantic, round(avg(graph_only), 7) AS mean_graph_only, round(avg(coalesce(r, 0)), 7) AS mean_pool_recall, round((SELECT avg(r) FROM k), 7) AS mean_ranked_recall FROM c LEFT JOIN t USING (query_id)""",
    "pool_positives": f"WITH {_J} SELECT query_id, candidate_id FROM ranking INTERSECT SELECT query_id, candidate_id FROM qrels",
    "protocol_splits": f"WITH h AS (SELECT DISTINCT id AS query_id, split FROM hotpot_tiny WHERE id IS NOT NULL) SELECT query_id, split FROM h WHERE split IN ('train', 'validation') AND query_id NOT IN ({_TESTS}) AND query_id NOT IN (SELECT query_id FROM queries WHERE user_id IS NULL)",
    "limited_instances": "WITH h AS (SELECT DISTINCT id AS query_id, split FROM hotpot_tiny WHERE id IS NOT NULL AND split IN ('train', 'validation')) SELECT query_id, split FROM h ORDER BY split, query_id LIMIT 100",
    "forbidden_set": f"SELECT id AS query_id FROM ({_TESTS}) WHERE id <> '' UNION SELECT query_id FROM queries WHERE user_id IS NULL AND query_id <> ''",
    "positive_coverage_by_split": f"WITH {_INSTANCES}, q AS (SELECT id AS query_id, min(split) AS split FROM hotpot_tiny WHERE id IS NOT NULL GROUP BY id) SELECT split, count(*) AS queries, count(*) FILTER (query_id NOT IN (SELECT query_id FROM i WHERE positive)) AS without_positive FROM q GROUP BY split",
    "local_graph_titles": f"WITH {_INSTANCES} SELECT DISTINCT query_id, 'candidate::' || candidate_id AS source, 'entity::' || coalesce(title, candidate_id) AS target, 'has_title' AS relation FROM i",
    "ranker_dataset": f"""WITH {_J} SELECT query_id, {_SIDE} AS side, count(*) AS candidates, count(q.candidate_id)::DOUBLE AS positives, 7 * count(*) AS numbers FROM ranking LEFT JOIN qrels q USING (query_id, candidate_id) WHERE rank <= 50 GROUP BY query_id""",
    "ranker_inference": f"""WITH {_J}, s AS (SELECT query_id, candidate_id, floor(score * 1024) / 1024 AS s FROM ranking WHERE rank <= 50)
        SELECT query_id, candidate_id, s AS neural_score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, candidate_id) AS neural_rank, 16 AS representation FROM s QUALIFY neural_rank <= 10""",
    "dense_places": f"WITH {CORPUS} SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) AS place FROM corpus",
}
