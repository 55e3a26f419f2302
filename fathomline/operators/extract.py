"""Extraction records from what a recogniser found, and a recogniser by rule that needs no model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import context, normalize_entity

#: Names by rule: two capitalised words or more in a row.
NAME = r"\p{Lu}[\p{L}\p{N}'-]+(?: \p{Lu}[\p{L}\p{N}'-]+)+"
DOCUMENT, UNKNOWN = "document", "unknown"
FOUND = "id string, title string, text string, found array<struct<name: string, type: string>>, related array<struct<subject: string, relation: string, object: string>>"


def by_rule(df: DataFrame, item: str, title: str, text: str) -> DataFrame:
    """Names of a text, each related to the next one in it; no model, no Python."""
    names = F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(NAME), F.lit(0)))
    n = F.greatest(F.size("_n") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_n", F.lit(1), n), F.slice("_n", F.lit(2), n), lambda a, b: F.struct(a.alias("subject"), F.lit("next_to").alias("relation"), b.alias("object")))
    rows = df.select(F.col(item).cast("string").alias("id"), F.col(title).alias("title"), F.col(text).alias("text"), names.alias("_n"))
    return rows.withColumn("found", F.transform("_n", lambda x: F.struct(x.alias("name"), F.lit("name").alias("type")))).withColumn("related", pairs).drop("_n")


def by_model(df: DataFrame, item: str, title: str, text: str, model: Callable[[list[str]], list[tuple[list, list]]]) -> DataFrame:
    """Names and relations by a model, called on batches of texts in the workers: [(names with types, triples)]."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = model([t or "" for t in b["text"]])
            found = [[{"name": n, "type": k} for n, k in names] for names, _ in got]
            related = [[{"subject": s, "relation": r, "object": o} for s, r, o in triples] for _, triples in got]
            yield b.assign(found=found, related=related)

    rows = df.select(F.col(item).cast("string").alias("id"), F.col(title).alias("title"), F.col(text).alias("text"))
    return rows.mapInPandas(run, FOUND)


def _first_by_name(entities: Column) -> Column:
    """Entities of different normal names, the first of each; blank ones are left out."""
    named = F.filter(entities, lambda e: normalize_entity(e["entity_name"]) != "")
    keys = F.transform(named, lambda e: normalize_entity(e["entity_name"]))
    return F.filter(named, lambda e, i: F.array_position(keys, normalize_entity(e["entity_name"])) == i + 1)


def records(found: DataFrame, around: int = 80, longest: int = 500) -> DataFrame:
    """Extraction records: the title first, as the document, then the names found, then ends of relations.

    Of equal names (normalised) the first counts.  A name is described by the text around its first place, the document
    by the beginning of its text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    entity = lambda n, t, d: F.struct(n.alias("entity_name"), t.alias("entity_type"), d.alias("description"))

    def around_name(n: Column) -> Column:
        at = F.instr(text, n)
        return F.when(at > 0, context(text, at - 1, at - 1 + F.length(n), around)).otherwise(F.lit(""))

    first = F.array(entity(F.coalesce("title", "id"), F.lit(DOCUMENT), F.substring(text, 1, longest)))
    names = F.transform("found", lambda x: entity(x["name"], x["type"], around_name(x["name"])))
    ends = F.flatten(F.transform("related", lambda r: F.array(entity(r["subject"], F.lit(UNKNOWN), F.lit("")), entity(r["object"], F.lit(UNKNOWN), F.lit("")))))
    relations = F.transform("related", lambda r: F.struct(r["subject"].alias("src_id"), r["object"].alias("tgt_id"), r["relation"].alias("keywords"), F.lit("").alias("description")))
    return found.select("id", "title", _first_by_name(F.concat(first, names, ends)).alias("entities"), relations.alias("relationships"))
