"""Readers of the raw formats: nested JSON, JSON lines, TSV, whitespace-separated judgements, click CSV."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_list, first_text, identifier, normalize_entity, strip
from ..operators.corpus import fold_merge, require_unique

QUESTION = "id string, _id string, question string, answer string, type string, level string, supporting_facts struct<title: array<string>, sent_id: array<bigint>>, context struct<title: array<string>, sentences: array<array<string>>>"
PARAGRAPH = "paragraph_id string, title string, text string, sources array<string>"
CANDIDATE = "candidate_id string, text string, embedding_text string, metadata string, sources array<string>"
EXTRACTION = "id string, title string, entities array<struct<entity_name: string, entity_type: string, description: string>>, relationships array<struct<src_id: string, tgt_id: string, keywords: string, description: string>>"
CANDIDATE_RESULT = "candidate_id string, text string, metadata string, evidence_nodes array<struct<node_id: string, node_type: string, text: string>>, evidence_edges array<struct<source: string, relation: string, target: string>>, semantic_score double, graph_score double, rag_score double, paths array<array<string>>, graph_features map<string, double>, rank int, neural_score double, neural_rank int, intermediate_representation array<float>, llm_score double, llm_rank int"


def _result_schema() -> T.StructType:
    one = T.StructType.fromDDL(CANDIDATE_RESULT)
    fields = T.StructType.fromDDL("schema_version int, query_id string, query_text string, stage string, metadata string, positive_ids array<string>")
    return fields.add("candidates", T.ArrayType(one))


def numbered(df: DataFrame, name: str = "seq") -> DataFrame:
    """Rows of a file scan with their place: file (by path), block in the file, row in the block.

    A row number alone would follow the splits, which Spark packs by size.
    """
    return df.withColumn(name, F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of a file whose top level is a JSON array; anything else is an error.

    Such a file is one task; ``sinks.as_lines`` turns a large one into lines once.
    """
    head = spark.read.text(path).where(F.trim("value") != "").head(1)
    if not head or not head[0][0].lstrip().startswith("["):
        raise ValueError(f"not a JSON array: {path}")
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Unknown fields are dropped, missing ones null; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, _result_schema())


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Candidate records as they are, with the metadata as JSON text."""
    return json_lines(spark, path, CANDIDATE)


def questions(spark: SparkSession, path: str) -> DataFrame:
    rows = json_array(spark, path, QUESTION)
    return rows.withColumn("id", F.coalesce("id", "_id")).drop("_id").withColumn("created_at", F.lit(None).cast("timestamp"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """candidate_id, title, text, embedding_text, metadata (JSON text), sources of either corpus format, told by its first record.

    Duplicate ids and an empty file are errors.
    """
    head = spark.read.text(path).where(F.trim("value") != "").select(F.try_parse_json("value").alias("v")).select(*(F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in ("candidate_id", "paragraph_id"))).head(1)
    if not head:
        raise ValueError(f"empty corpus: {path}")
    if head[0]["candidate_id"] is not None:
        rows = candidates(spark, path).select("candidate_id", F.get_json_object("metadata", "$.title").alias("title"), "text", F.coalesce("embedding_text", "text", F.lit("")).alias("embedding_text"), "metadata", "sources")
    elif head[0]["paragraph_id"] is not None:
        rows = json_lines(spark, path, PARAGRAPH).select(F.col("paragraph_id").alias("candidate_id"), "title", "text", strip(F.concat_ws("\n", "title", "text")).alias("embedding_text"), F.to_json(F.struct("title")).alias("metadata"), "sources")
    else:
        raise ValueError(f"neither candidate_id nor paragraph_id: {path}")
    return require_unique(rows, "candidate_id", "candidate id")


def beir_queries(spark: SparkSession, path: str) -> DataFrame:
    rows = numbered(json_lines(spark, path, "_id string, query_id string, text string, title string"))
    key = F.coalesce("_id", "query_id")
    key = F.when(key.isNull(), F.raise_error(F.lit("query without an id"))).otherwise(key)
    return rows.select(key.alias("query_id"), first_text(F.col("text"), F.col("title"), key).alias("text"), "seq")


def beir_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, candidate_id, score, seq) with a header of either spelling; a score that is no number is an error."""
    rows = numbered(spark.read.csv(path, sep="\t", header=True))
    name = lambda *names: next(F.col(f"`{n}`") for n in names if n in rows.columns)
    return rows.select(name("query-id", "query_id").alias("query_id"), name("corpus-id", "corpus_id").alias("candidate_id"), name("score").cast("int").alias("score"), "seq")


def trec_qrels(spark: SparkSession, path: str) -> DataFrame:
    """White space between four columns or more (fewer: error); rows whose score is no integer are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = numbered(spark.read.text(path).where(F.trim("value") != "")).select(parts.alias("p"), "seq")
    ok = F.when(F.size("p") < 4, F.raise_error(F.lit("a judgement needs four columns"))).otherwise(F.col("p"))
    rows = rows.select(ok.alias("p"), "seq").select(F.col("p")[0].alias("query_id"), F.col("p")[2].alias("candidate_id"), F.expr("try_cast(p[3] as int)").alias("score"), "seq")
    return rows.where("score is not null")


def clicks(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, candidate_id, seq) of a CSV with or without a header; rows with fewer than two columns are skipped."""
    rows = numbered(spark.read.csv(path, header=False, schema="query_id string, candidate_id string"))
    header = (F.lower(F.trim("query_id")) == "query_id") & (F.lower(F.trim("candidate_id")) == "clicked_id")
    return rows.where("query_id is not null and candidate_id is not null").where(~header)


_SPACE = re.compile(r"\s*")


def top_level(read, size: int = 4 << 20) -> Iterator[tuple[str | None, str]]:
    """(key, text) of every value of a JSON list (key: null) or map, read in parts: the whole is never held."""
    decoder, decode = json.JSONDecoder(), codecs.getincrementaldecoder("utf-8-sig")()
    buffer, at, ended = "", 0, False

    def more() -> None:
        nonlocal buffer, at, ended
        part = read(max(size, len(buffer) - at))  # a value that fills the buffer doubles it
        ended = not part
        buffer, at = buffer[at:] + decode.decode(part, ended), 0

    def skip() -> str:
        nonlocal at
        while True:
            at = _SPACE.match(buffer, at).end()
            if at < len(buffer) or ended:
                return buffer[at : at + 1]
            more()

    def value() -> tuple[object, str]:
        nonlocal at
        while True:
            try:
                got, end = decoder.raw_decode(buffer, at)
                if end < len(buffer) or ended:  # else a number may go on
                    text, at = buffer[at:end], end
                    return got, text
            except json.JSONDecodeError:
                if ended:
                    raise
            more()

    first = skip()
    if first not in ("[", "{"):
        raise ValueError("neither a JSON list nor a map")
    at += 1
    close = "]" if first == "[" else "}"
    while (c := skip()) != close:
        if c == ",":
            at += 1
            skip()
        key = None
        if first == "{":
            key = value()[0]
            if skip() != ":":
                raise ValueError("a key without a value")
            at += 1
            skip()
        yield key, value()[1]
        if skip() not in (",", close):
            raise ValueError("a list or map that is cut off")


def _top_level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    kinds = [pa.string(), pa.string(), pa.int64()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            system, where = fs.FileSystem.from_uri(re.sub("^file:/+", "/", path))
            with system.open_input_stream(where) as f:
                held, size = [], 0
                for at, (key, text) in enumerate(top_level(f.read)):
                    held.append((key, text, at))
                    size += len(text)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["k", "value", "line"])
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=["k", "value", "line"])


def _papers(spark: SparkSession, path: str, at: int) -> DataFrame:
    """(id, paper, order) of a JSON map from id to paper, a JSON list of papers, or JSON lines, of any size."""
    if path.endswith("l"):
        lines = numbered(spark.read.text(path).where(F.trim("value") != ""), "line").withColumn("k", F.lit(None).cast("string"))
    else:
        lines = spark.createDataFrame([(path,)], "path string").mapInArrow(_top_level, "k string, value string, line long")
        lines = lines.withColumn("line", F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.col("line").alias("row")))
    rows = lines.select("k", F.parse_json("value").alias("v"), "line")
    own = F.coalesce(*(F.try_variant_get("v", f"$.{k}", "string") for k in ("paper_id", "_id", "id")))
    return rows.select(F.coalesce(own, F.col("k")).alias("id"), F.col("v").alias("paper"), F.struct(F.lit(at).alias("file"), F.col("line").alias("o")).alias("order"))


def paper_metadata(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(paper_id, title, text) merged over files in order: a later record counts only if its text is longer."""
    rows = None
    for i, path in enumerate(paths):
        part = _papers(spark, path, i)
        rows = part if rows is None else rows.unionByName(part)
    get = lambda k: F.try_variant_get("paper", f"$.{k}", "string")
    flat = rows.select(F.col("id").alias("paper_id"), get("title").alias("title"), first_text(get("abstract"), get("text")).alias("text"), "order")
    return fold_merge(flat, "paper_id", "order", "text", ["title", "text"])


def _identifiers(raw: Column, keys: list[str]) -> Column:
    return F.filter(F.transform(as_list(raw), lambda v: identifier(v, keys)), lambda x: x.isNotNull())


def enrichment(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(paper_id, authors, fields, references): within a file the last record wins, over files the last to have a key."""
    rows = None
    for i, path in enumerate(paths):
        part = _papers(spark, path, i)
        last = part.groupBy("id").agg(F.max_by("paper", "order").alias("paper"), F.max("order").alias("order"))
        rows = last if rows is None else rows.unionByName(last)
    names = {"authors": ("authors", ["authorId", "author_id", "id", "name"]), "fields": ("fields", ["field_id", "topic_id", "id", "name"]), "references": ("references", ["paperId", "paper_id", "corpus_id", "id"])}
    other = {"fields": ("fieldsOfStudy", "topics"), "references": ("outbound_citations",)}
    cols = []
    for out, (key, ids) in names.items():
        raw = F.coalesce(*(F.try_variant_get("paper", f"$.{k}", "variant") for k in (key, *other.get(out, ()))))
        cols.append(F.when(raw.isNotNull(), _identifiers(raw, ids)).alias(out))
    flat = rows.select(F.col("id").alias("paper_id"), "order", *cols)
    return flat.groupBy("paper_id").agg(*(F.coalesce(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))), F.array().cast("array<string>")).alias(c) for c in names))


def extractions(spark: SparkSession, path: str, titles: DataFrame | None = None) -> DataFrame:
    """Extraction records; with ``titles`` only the last record of each wanted title (by the first entity's name)."""
    rows = numbered(json_lines(spark, path, EXTRACTION))
    if titles is None:
        return rows
    named = rows.withColumn("_t", normalize_entity(F.col("entities")[0]["entity_name"]))
    wanted = named.join(titles.select(normalize_entity(F.col("title")).alias("_t")).distinct(), "_t", "left_semi")
    return wanted.groupBy("_t").agg(F.max_by(F.struct(*rows.columns), "seq").alias("r")).select("r.*")
