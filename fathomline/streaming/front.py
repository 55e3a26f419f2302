"""Queries that arrive as files: the retrieval plan on every micro-batch, against a static corpus and graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.retrieve import Retrieval, retrieve
from ..sources import derived

SCHEMA = "query_id string, text string, seeds array<string>, excluded array<string>, allowed array<string>"


def answer(static: derived.Inputs, options: Retrieval = Retrieval()):
    """Ranked candidates of a batch of queries (of repeated ids, the smallest text counts)."""

    def run(batch: DataFrame) -> DataFrame:
        q = batch.where("query_id is not null").groupBy("query_id").agg(F.min_by(F.struct("text", "seeds", "excluded", "allowed"), F.coalesce("text", F.lit(""))).alias("r")).select("query_id", "r.*")
        v = derived.hashed(q, "query_id", "text").join(q.select("query_id", "excluded", "allowed"), "query_id")
        named = q.select("query_id", F.posexplode("seeds").alias("pos", "candidate_id"))
        i = derived.Inputs(q, v, static.corpus, static.corpus_vectors, static.graph)
        return retrieve(i, named, options).ranked

    return run


def serve(spark: SparkSession, folder: str, static: derived.Inputs, out: str, checkpoint: str, options: Retrieval = Retrieval()):
    """Answer all query files that are there, each once; the checkpoint remembers which, so a rerun goes on from there.

    A batch that is repeated after a failure replaces its own rows: results are partitioned by batch.
    """
    answered = answer(static, options)

    def write(batch: DataFrame, number: int) -> None:
        rows = answered(batch).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(out)

    stream = spark.readStream.schema(SCHEMA).json(folder)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Windowed counts of a stream of load times, with a watermark for rows that are late."""
    return events.withWatermark(at, late).groupBy(F.window(at, window), F.col(kind)).agg(F.count("*").alias("n"))


