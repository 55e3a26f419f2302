"""Embedders that a configuration can choose; each is a function (rows, item, text) -> (item, vector)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import embed
from ..plans.registry import EMBEDDERS

Embedder = Callable[[DataFrame, str, str], DataFrame]


@EMBEDDERS.register("hashing")
def hashing(dimension: int = 64, ngrams: int = 2, digest: str = "md5") -> Embedder:
    return lambda df, item, text: embed(df, item, text, dimension, ngrams, digest, double=True)


@EMBEDDERS.register("table")
def from_table(path: str, key: str = "item", vector: str = "vector") -> Embedder:
    """Vectors made elsewhere, by item; an item without one is an error when the rows are read."""

    def run(df: DataFrame, item: str, text: str) -> DataFrame:
        made = df.sparkSession.read.parquet(path).select(F.col(key).alias(item), F.col(vector).cast("array<double>").alias("vector"))
        return strict_vectors(df.select(item), made, item)

    return run


@EMBEDDERS.register("model")
def by_model(model: Callable[[list[str]], np.ndarray], batch: int = 256) -> Embedder:
    """A model that is called on batches of texts in the workers, and gives a row of numbers for each text."""

    def run(df: DataFrame, item: str, text: str) -> DataFrame:
        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, batch):
                    some = b.slice(a, batch)
                    x = np.asarray(model([t or "" for t in some.column(1).to_pylist()]), np.float64)
                    yield pa.RecordBatch.from_arrays([some.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=[item, "vector"])

        return df.select(F.col(item), F.col(text)).mapInArrow(encode, T.StructType([df.schema[item], T.StructField("vector", T.ArrayType(T.DoubleType()))]))

    return run


def strict_vectors(ids: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """The vectors of given ids; the plan fails at run time where one has none."""
    got = ids.join(vectors.select(key, "vector"), key, "left")
    missing = F.raise_error(F.concat(F.lit("no vector for "), F.col(key).cast("string")))
    return got.withColumn("vector", F.when(F.col("vector").isNull(), missing).otherwise(F.col("vector")))
