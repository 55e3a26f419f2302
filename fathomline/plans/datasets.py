"""Datasets that a pipeline can run on: the project's tables, or raw files of the two public collections."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import joined, strip
from ..operators import corpus as cp
from ..operators.graph import Graph, citation_graph, knowledge_graph
from ..sources import derived, protocol, readers
from . import files
from .registry import DATASETS, GRAPHS, STORES
from .stage import stage

_IDS = "array<string>"


def _plain(queries: DataFrame) -> DataFrame:
    """Queries that name no seeds and exclude nothing."""
    none = F.array().cast(_IDS)
    return queries.withColumns({"user_id": F.lit(None).cast("string"), "seeds": none, "excluded": none, "allowed": F.lit(None).cast(_IDS)})


@DATASETS.register("tables")
@dataclass
class Tables:
    """A folder of the project's Parquet tables."""

    spark: SparkSession
    path: str

    def inputs(self) -> list[str]:
        return [self.path]

    def corpus(self) -> DataFrame:
        return derived.corpus(self.spark, self.path)

    def queries(self) -> DataFrame:
        return derived.queries(self.spark, self.path)

    def judgements(self) -> DataFrame:
        return derived.judgements(self.spark, self.path)

    def records(self, corpus: DataFrame) -> DataFrame:
        return derived.kg_records(self.spark, self.path)


@DATASETS.register("hotpotqa")
@dataclass
class Hotpot:
    """Question files (JSON arrays), and extraction records of their paragraphs (JSON lines).

    The corpus is what the questions' contexts hold; of a question delivered twice the first counts.
    """

    spark: SparkSession
    questions: list[str]
    extractions: str | None = None
    _rows: DataFrame | None = field(default=None, repr=False)

    def inputs(self) -> list[str]:
        return [*self.questions, *([self.extractions] if self.extractions else [])]

    def rows(self) -> DataFrame:
        if self._rows is None:
            parts = [readers.questions(self.spark, p).withColumn("source", F.lit(p.rsplit("/", 1)[-1])).withColumn("part", F.lit(i)) for i, p in enumerate(self.questions)]
            every = parts[0]
            for p in parts[1:]:
                every = every.unionByName(p)
            self._rows = stage(every.withColumn("n", F.monotonically_increasing_id()), "questions")
        return self._rows

    def instances(self) -> DataFrame:
        return cp.instances(self.rows())

    def corpus(self) -> DataFrame:
        rows = self.rows()
        n = F.least(F.size("context.title"), F.size("context.sentences"))
        pairs = F.arrays_zip(F.slice("context.title", F.lit(1), n).alias("title"), F.slice("context.sentences", F.lit(1), n).alias("sentences"))
        each = rows.where(n > 0).select("part", "n", "source", F.posexplode(pairs).alias("pos", "c"))
        each = each.select(F.struct("part", "n", "pos").alias("seq"), F.col("c.title").alias("title"), F.array_join("c.sentences", "\n").alias("text"), F.array("source").alias("sources"))
        return cp.paragraph_corpus(each, "seq")

    def queries(self) -> DataFrame:
        rows = self.rows().where("id is not null and trim(question) <> ''")
        return _plain(rows.groupBy(F.col("id").alias("query_id")).agg(F.min_by("question", F.struct("part", "n")).alias("text")))

    def judgements(self) -> DataFrame:
        return self.instances().where("positive").select("query_id", "candidate_id").distinct()

    def records(self, corpus: DataFrame) -> DataFrame:
        if self.extractions is None:
            raise ValueError("the dataset names no extraction records")
        return readers.extractions(self.spark, self.extractions)


@DATASETS.register("scidocs")
@dataclass
class Scidocs:
    """Raw files of a scientific-document collection.

    protocol ``development``: click pairs train, citation judgements validate, metadata files are the corpus;
    ``beir_test``: the official queries, judgements and corpus.  Judgements are no input of corpus or graph.
    """

    spark: SparkSession
    protocol: str = "beir_test"
    split: str = "all"
    beir_corpus: str | None = None
    beir_queries: str | None = None
    beir_qrels: str | None = None
    metadata: list[str] = field(default_factory=list)
    train_clicks: str | None = None
    validation_qrels: str | None = None
    forbidden_queries: str | None = None
    enrichment: list[str] = field(default_factory=list)
    require_enrichment: bool = False
    reverse_citations: bool = True
    missing_positives: str = "drop"
    expected: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.protocol not in ("development", "beir_test"):
            raise ValueError(f"unknown protocol: {self.protocol}")
        if any("qrel" in p.lower() for p in self.enrichment):
            raise ValueError("the graph must not be made of judgements")

    def inputs(self) -> list[str]:
        named = [self.beir_corpus, self.beir_queries, self.beir_qrels, self.train_clicks, self.validation_qrels, self.forbidden_queries]
        return [*self.metadata, *self.enrichment, *(p for p in named if p)]

    def corpus(self) -> DataFrame:
        if self.protocol == "beir_test":
            if not self.beir_corpus or not files.exists(self.spark, self.beir_corpus):
                raise FileNotFoundError(f"no corpus: {self.beir_corpus}")
            raw = readers.json_lines(self.spark, self.beir_corpus, "_id string, title string, text string").select(F.col("_id").alias("candidate_id"), "title", "text")
            sources = [self.beir_corpus]
        else:
            if not self.metadata:
                raise ValueError("a development corpus needs metadata files")
            raw = readers.paper_metadata(self.spark, self.metadata).select(F.col("paper_id").alias("candidate_id"), "title", "text")
            sources = self.metadata
        title = strip(F.coalesce("title", F.lit("")))
        rows = raw.select("candidate_id", title.alias("title"), joined(F.col("title"), F.col("text")).alias("text"), F.array(*(F.lit(s) for s in sources)).alias("sources"))
        return cp.require_unique(rows, "candidate_id", "candidate id")

    def forbidden(self) -> DataFrame:
        """Ids whose own references may not enter the graph: those held out, and under the test protocol its queries."""
        named = [self.forbidden_queries, self.beir_queries if self.protocol == "beir_test" else None]
        found = protocol.forbidden_ids(*(readers.beir_queries(self.spark, p) if p else None for p in named))
        return found if found is not None else self.spark.createDataFrame([], "query_id string")

    def _parts(self) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
        if self.protocol == "beir_test":
            asked = readers.beir_queries(self.spark, self.beir_queries).withColumn("source", F.lit("beir_scidocs"))
            judged = cp.qrels(readers.beir_qrels(self.spark, self.beir_qrels), "query_id", "candidate_id", F.col("score"), "seq")
            protocol.require_positives(asked, judged)
            return {"test": asked}, {"test": judged.select("query_id", "candidate_id")}
        titles = readers.paper_metadata(self.spark, self.metadata).select("paper_id", F.coalesce(F.nullif(strip(F.coalesce("title", "text")), F.lit("")), F.col("paper_id")).alias("text"))
        named = lambda rows, source: rows.join(titles, rows["query_id"] == titles["paper_id"], "left").select("query_id", "seq", F.coalesce("text", "query_id").alias("text"), F.lit(source).alias("source"))
        queries, positives = {}, {}
        if self.train_clicks:
            clicks = readers.clicks(self.spark, self.train_clicks).where("trim(query_id) <> '' and trim(candidate_id) <> ''")
            positives["train"] = clicks.select("query_id", "candidate_id").distinct()
            queries["train"] = named(clicks.groupBy("query_id").agg(F.min("seq").alias("seq")), "clicks")
        if self.validation_qrels:
            judged = cp.qrels(readers.trec_qrels(self.spark, self.validation_qrels), "query_id", "candidate_id", F.col("score"), "seq")
            positives["validation"] = judged.select("query_id", "candidate_id")
            queries["validation"] = named(judged.groupBy("query_id").agg(F.min("pos").alias("seq")), "citations")
        wanted = [s for s in protocol.PROTOCOLS["development"] if self.split in ("all", s)]
        if missing := [s for s in wanted if s not in queries]:
            raise ValueError(f"the dataset names no file for {missing}")
        return queries, positives

    def _selected(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(queries, positives in the corpus, dropped positives); queries that keep no positive are left out."""
        parts, judged = self._parts()
        name = "test" if self.protocol == "beir_test" else "development"
        asked = protocol.select(name, self.split, parts, self.forbidden() if self.protocol == "development" else None)
        every = None
        for split, p in judged.items():
            p = p.withColumn("split", F.lit(split))
            every = p if every is None else every.unionByName(p)
        every = every.join(asked.select("query_id", "split").distinct(), ["query_id", "split"], "left_semi")
        kept, dropped = cp.audited_positives(every, self.corpus(), self.missing_positives)
        return asked.join(kept.select("query_id", "split").distinct(), ["query_id", "split"], "left_semi"), kept, dropped

    def queries(self) -> DataFrame:
        asked, _, _ = self._selected()
        once = asked.groupBy("query_id").agg(F.min_by(F.struct("text", "split"), "split_at").alias("r")).select("query_id", "r.*")
        own = F.array("query_id")  # a paper is a seed of its own graph, and never its own answer
        return _plain(once).withColumn("seeds", own).withColumn("excluded", own)

    def judgements(self) -> DataFrame:
        return self._selected()[1].select("query_id", "candidate_id").distinct()

    def papers(self) -> DataFrame:
        there = protocol.enrichment_gate(self.spark, self.enrichment, self.require_enrichment)
        if not there:
            return self.spark.createDataFrame([], f"paper_id string, authors {_IDS}, fields {_IDS}, references {_IDS}")
        return readers.enrichment(self.spark, there)

    def records(self, corpus: DataFrame) -> DataFrame:
        raise ValueError("the dataset has no extraction records; its graph is made of citations")

    def audit(self) -> dict:
        """Counts of the protocol; a count that isn't the expected one, or a positive outside the corpus, is an error."""
        asked, kept, dropped = self._selected()
        corpus = self.corpus().select("candidate_id")
        inside = lambda df, c: df.join(corpus, df[c] == corpus["candidate_id"], "left_semi").count()
        n, ids = asked.agg(F.count("*"), F.count_distinct("query_id", "split")).first()
        positives, lost = kept.count(), dropped.count()
        judged = kept.select("query_id", F.col("candidate_id").alias("positive"))
        report = {
            "protocol": self.protocol, "candidates": corpus.count(), "empty_texts": self.corpus().where("text = ''").count(), "queries": n, "unique_queries": ids, "duplicate_queries": n - ids,
            "splits": {r["split"]: r["n"] for r in asked.groupBy("split").agg(F.count("*").alias("n")).collect()},
            "queries_in_corpus": inside(asked.select("query_id"), "query_id"), "positives": positives, "positives_in_corpus": inside(judged, "positive"),
            "dropped_positives": lost, "dropped_examples": [r.asDict() for r in dropped.select("query_id", "candidate_id", "split").orderBy("query_id", "candidate_id").limit(20).collect()],
            "raw_positives": positives + lost, "raw_positive_in_corpus_rate": positives / (positives + lost) if positives + lost else 0.0, "forbidden_queries": self.forbidden().count(),
        }
        for what, want in self.expected.items():
            if report[what] != want:
                raise ValueError(f"{what}: {report[what]}, expected {want}")
        if report["positives_in_corpus"] != positives:
            raise ValueError(f"only {report['positives_in_corpus']} of {positives} positives are in the corpus")
        return report


# ---- Graphs ----------------------------------------------------------------------------------------------------------


@GRAPHS.register("knowledge")
def _knowledge(data, corpus: DataFrame) -> Graph:
    return knowledge_graph(data.records(corpus), corpus, "seq")


@GRAPHS.register("citations")
def _citations(data, corpus: DataFrame) -> Graph:
    return citation_graph(data.papers(), corpus, data.forbidden().withColumnRenamed("query_id", "candidate_id"), data.reverse_citations)


@STORES.register("parquet")
class ParquetStore:
    """A graph as three tables in a folder; it knows which nodes stand for candidates."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, g: Graph) -> dict:
        for name in ("nodes", "links", "edges"):
            getattr(g, name).write.mode("overwrite").parquet(f"{self.folder}/{name}")
        counts = {n: getattr(self.open(), n).count() for n in ("nodes", "links", "edges")}
        files.write_json(self.spark, f"{self.folder}/counts.json", counts)
        return counts

    def open(self) -> Graph:
        return Graph(*(self.spark.read.parquet(f"{self.folder}/{n}") for n in ("nodes", "links", "edges")))


@STORES.register("memory")
class MemoryStore:
    """A graph that is made anew each time it is asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.kept: Graph | None = None

    def write(self, g: Graph) -> dict:
        self.kept = g
        return {n: getattr(g, n).count() for n in ("nodes", "links", "edges")}

    def open(self) -> Graph:
        if self.kept is None:
            raise ValueError("no graph was made")
        return self.kept

