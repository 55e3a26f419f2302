"""Corpora, instances and relevance judgements from raw records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import joined, paragraph_id, strip


def paragraph_corpus(df: DataFrame, seq: str, title: str = "title", text: str = "text", sources: str = "sources") -> DataFrame:
    """One row a paragraph id: first record wins (by ``seq``), sources are the distinct ones in order of arrival.

    Records with a blank title or text are left out.  Values are kept stripped.
    """
    rows = df.select(strip(F.col(title)).alias("title"), strip(F.col(text)).alias("text"), F.col(sources).alias("sources"), F.col(seq).alias("_seq")).where("title <> '' and text <> ''")
    rows = rows.withColumn("candidate_id", paragraph_id(F.col("title"), F.col("text")))
    # A source is kept with its first arrival, so a paragraph with very many records holds one entry a source.
    first = rows.groupBy("candidate_id").agg(F.min_by(F.struct("title", "text"), "_seq").alias("one"))
    each = rows.select("candidate_id", "_seq", F.posexplode("sources").alias("_p", "source")).groupBy("candidate_id", "source").agg(F.min(F.struct("_seq", "_p")).alias("at"))
    listed = each.groupBy("candidate_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "source"))), lambda x: x["source"]).alias("sources"))
    return first.join(listed, "candidate_id", "left").select("candidate_id", "one.title", "one.text", F.coalesce("sources", F.array().cast("array<string>")).alias("sources"))


def corpus_stats(df: DataFrame, title: str = "title", text: str = "text") -> DataFrame:
    """input_records, paragraphs, duplicates_removed (input less paragraphs, blank records included) and blank records."""
    ok = (F.coalesce(strip(F.col(title)), F.lit("")) != "") & (F.coalesce(strip(F.col(text)), F.lit("")) != "")
    rows = df.select(F.when(ok, paragraph_id(F.col(title), F.col(text))).alias("id"), ok.alias("ok"))
    out = rows.agg(F.count("*").alias("input_records"), F.count_distinct("id").alias("paragraphs"), F.count_if(~F.col("ok")).alias("blank"))
    return out.withColumn("duplicates_removed", F.col("input_records") - F.col("paragraphs"))


def corpus_texts(df: DataFrame, item: str, title: str, abstract: str) -> DataFrame:
    """(candidate_id, text): title and abstract on lines of their own, blanks dropped, in id order."""
    return df.select(F.col(item).cast("string").alias("candidate_id"), joined(F.col(title), F.col(abstract)).alias("text")).orderBy("candidate_id")


def require_unique(df: DataFrame, key: str, what: str) -> DataFrame:
    """Fails at run time, in the plan itself, where a key occurs twice."""
    checked = df.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    twice = checked.limit(1).collect()
    if twice:
        raise ValueError(f"duplicate {what}: {twice[0][0]}")
    return df


def instances(df: DataFrame) -> DataFrame:
    """Candidates of every question: titles zipped with sentence groups (the shorter list ends it), in context order.

    Columns: query_id, pos, candidate_id, title, text, positive (its title is a supporting one).  Of several deliveries
    of an id the first (by created_at, then question) counts.
    """
    rows = df.where("id is not null").groupBy("id").agg(F.min_by(F.struct("context", "supporting_facts"), F.struct("created_at", "question")).alias("r")).select("id", "r.*")
    n = F.least(F.size("context.title"), F.size("context.sentences"))
    pairs = F.arrays_zip(F.slice("context.title", F.lit(1), n).alias("title"), F.slice("context.sentences", F.lit(1), n).alias("sentences"))
    out = rows.where(n > 0).select(F.col("id").alias("query_id"), F.col("supporting_facts.title").alias("_s"), F.posexplode(pairs).alias("pos", "c"))
    text = strip(F.array_join("c.sentences", "\n"))
    return out.select("query_id", "pos", paragraph_id(F.col("c.title"), text).alias("candidate_id"), F.col("c.title").alias("title"), text.alias("text"), F.coalesce(F.array_contains("_s", F.col("c.title")), F.lit(False)).alias("positive"))


def missing_titles(df: DataFrame) -> DataFrame:
    """(query_id, missing): supporting titles that are not in the context, sorted."""
    rows = df.where("id is not null").groupBy("id").agg(F.min_by(F.struct("context", "supporting_facts"), F.struct("created_at", "question")).alias("r"))
    gone = F.array_sort(F.array_except("r.supporting_facts.title", "r.context.title"))
    return rows.select(F.col("id").alias("query_id"), gone.alias("missing")).where(F.size("missing") > 0)


def qrels(df: DataFrame, query: str, candidate: str, score: Column, seq: str) -> DataFrame:
    """(query_id, candidate_id, pos): judgements above 0, repeats once, in order of first appearance."""
    rows = df.where(score > 0).groupBy(F.col(query).alias("query_id"), F.col(candidate).alias("candidate_id")).agg(F.min(seq).alias("pos"))
    return rows


def audited_positives(positives: DataFrame, corpus: DataFrame | None, mode: str = "drop") -> tuple[DataFrame, DataFrame]:
    """(kept, dropped) positives by whether the corpus has them; ``strict`` fails where one is missing.

    Without a corpus there is nothing to check; empty ids of the corpus match nothing.
    """
    if corpus is None:
        return positives, positives.limit(0)
    corpus = corpus.where("candidate_id <> ''")
    ids = corpus.select("candidate_id").distinct()
    kept, dropped = positives.join(ids, "candidate_id", "left_semi"), positives.join(ids, "candidate_id", "left_anti")
    if mode == "strict" and dropped.head(1):
        raise ValueError("positives are missing from the corpus")
    return kept, dropped


def fold_merge(df: DataFrame, key: str, order: str, length: str, fields: list[str]) -> DataFrame:
    """Records of one key merged in order: a later one replaces field by field, but only if its text is strictly longer
    than the text held so far.

    A record takes effect exactly where it exceeds all before it, so its effect needs a running maximum, no fold.
    """
    from pyspark.sql import Window

    by = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    size = F.coalesce(F.length(length), F.lit(0))
    kept = df.withColumn("_most", F.max(size).over(by)).where(F.col("_most").isNull() | (size > F.col("_most")))
    return kept.groupBy(key).agg(*(F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields))


def protocol_audit(queries: DataFrame, positives: DataFrame, corpus: DataFrame, split: str) -> DataFrame:
    """One row: queries, distinct and duplicate ids, positives, those in the corpus, queries without one."""
    q = queries.agg(F.count("*").alias("queries"), F.count_distinct("query_id").alias("distinct_queries"), F.count_if(F.col(split) == "train").alias("train_queries"))
    p = positives.join(corpus.select("candidate_id").distinct().withColumn("_in", F.lit(1)), "candidate_id", "left").agg(F.count("*").alias("positives"), F.count("_in").alias("positives_in_corpus"))
    without = queries.select("query_id").distinct().join(positives.select("query_id").distinct(), "query_id", "left_anti").agg(F.count("*").alias("queries_without_positive"))
    both = q.withColumn("_j", F.lit(1)).join(p.withColumn("_j", F.lit(1)), "_j").join(without.withColumn("_j", F.lit(1)), "_j").drop("_j")
    return both.withColumn("duplicate_queries", F.col("queries") - F.col("distinct_queries"))
