"""Duplicates that differ only in writing: an incremental ledger of canonical keys."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import files
from ..plans.skew import join_by_key
from ..plans.stage import new_path, stage

#: Keys that one bucket holds before the ledger gets twice as many, and buckets that it begins with.
BUCKET_KEYS, BUCKETS = 2_000_000, 8


def canonical(c: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def record_key(*fields: Column) -> Column:
    """Digest of the canonical fields in a fixed order; null where any field is null or has no visible character.

    A field without a letter or digit but with other marks is kept: its canonical form is empty.
    """
    visible = None
    for f in fields:
        ok = F.coalesce(f.rlike(r"(?U)\S"), F.lit(False))
        visible = ok if visible is None else visible & ok
    return F.when(visible, F.unhex(F.sha2(F.concat_ws("\x1f", *(canonical(f) for f in fields)), 256)))


def read_payloads(df: DataFrame, payload: str, keep: list[str], fields: list[str]) -> DataFrame:
    """``fields`` of JSON objects as strings, whatever their order and layout; unreadable payloads give no row."""
    parsed = df.select(*keep, F.try_parse_json(F.col(payload)).alias("_v")).where(F.col("_v").isNotNull())
    parsed = parsed.where(F.schema_of_variant("_v").startswith("OBJECT"))
    return parsed.select(*keep, *(F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in fields))


class Ledger:
    """Counts of canonical keys in buckets, kept in a folder: another session goes on where the last one ended.

    Each batch makes a new version beside the old one and then a manifest that names it, so a batch that fails leaves
    the ledger as it was.  A version is stored by hash of the key, a file a bucket: the outer join with a batch moves
    the batch only.  When the buckets grow beyond BUCKET_KEYS, the next version has twice as many.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.folder = spark, folder or new_path(spark, "ledger")
        made = [n for n in files.names(spark, f"{self.folder}/manifest") if n.endswith(".json")]
        self.state = files.read_json(spark, f"{self.folder}/manifest/{made[-1]}") if made else {"version": 0, "buckets": BUCKETS, "keys": 0, "path": None, "applied": []}

    def _table(self) -> DataFrame:
        """The newest version, registered by its place so that its buckets are known."""
        name = f"ledger_{uuid.uuid4().hex}"
        n = self.state["buckets"]
        self.spark.sql(f"CREATE TABLE {name} (key BINARY, copies BIGINT, first_id STRING) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {n} BUCKETS LOCATION '{self.state['path']}'")
        return self.spark.table(name)

    def read(self) -> DataFrame:
        schema = "key binary, copies bigint, first_id string"
        if not self.state["path"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self.state["path"])

    def apply(self, batch: DataFrame, record_id: str, name: str | None = None) -> None:
        """Add a batch of (key, record id): the batch is aggregated first (a hot key leaves one row a task), then
        outer-joined with its buckets; counts are added and the smaller record id stays the representative.

        A batch of a ``name`` that the ledger has applied already changes nothing, so a run may be repeated.
        """
        if name is not None and name in self.state["applied"]:
            return
        new = batch.where(F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("n"), F.min(record_id).alias("i"))
        new, state = stage(new, "batch"), dict(self.state)
        added = new.count()
        if added:
            while state["keys"] + added > state["buckets"] * BUCKET_KEYS:
                state["buckets"] *= 2
            merged = new.select("key", F.col("n").alias("copies"), F.col("i").alias("first_id"))
            if state["path"]:
                both = new.repartition(self.state["buckets"], "key").join(self._table(), "key", "full_outer")
                merged = both.select("key", (F.coalesce("n", F.lit(0)) + F.coalesce("copies", F.lit(0))).alias("copies"), F.least("i", "first_id").alias("first_id"))
            if not state["path"] or state["buckets"] != self.state["buckets"]:
                merged = merged.repartition(state["buckets"], "key")
            state["path"] = f"{self.folder}/{uuid.uuid4().hex}"
            table = f"ledger_{uuid.uuid4().hex}"
            merged.write.bucketBy(state["buckets"], "key").sortBy("key").format("parquet").option("path", state["path"]).saveAsTable(table)
        state["version"] += 1
        state["applied"] = [*state["applied"], *([name] if name is not None else [])]
        before, self.state = self.state["path"], state
        self.state["keys"] = self.read().count()
        files.write_json(self.spark, f"{self.folder}/manifest/{state['version']:012d}.json", self.state)
        if before and before != state["path"]:
            files.delete(self.spark, before)


def collapse(batches: list[DataFrame], record_id: str, fields: list[str], folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(ledger, members) of records delivered in batches, added to the ledger in ``folder`` (a new one, if none is named).

    ledger: key, copies, first_id (smallest record id).  members: key, record id of every row that has a key.  Records
    with a null or blank field are no cases; null record ids count as copies but are never the representative; repeated
    rows count; empty batches change nothing; other columns are ignored.
    """
    ledger = Ledger(batches[0].sparkSession, folder)
    kept = []
    for b in batches:
        keyed = stage(b.select(F.col(record_id).cast("string").alias(record_id), record_key(*(F.col(f) for f in fields)).alias("key")).where("key is not null"), "keys")
        ledger.apply(keyed, record_id)
        kept.append(keyed)
    members = kept[0]
    for k in kept[1:]:
        members = members.unionByName(k)
    return ledger.read(), members


def copies_of(ledger: DataFrame, members: DataFrame, record_id: str) -> DataFrame:
    """(first_id, record id) of every copy but the representative; a hot key's rows are not moved."""
    several = stage(ledger.where((F.col("copies") > 1) & F.col("first_id").isNotNull()), "several")
    total = members.count()
    pairs = join_by_key(members, several, "key", "copies", total)
    return pairs.where(F.col(record_id) != F.col("first_id")).select("first_id", record_id).distinct()
