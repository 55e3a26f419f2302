"""Functions on vectors, and the hashing embedder."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import BIGRAM

#: Fixed value: the embedder's tokens.
WORD = re.compile(r"[\w'-]+", re.UNICODE)
TINY = 1e-12


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; null where a vector is null or lengths differ."""
    both = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.when(F.size(a) == F.size(b), F.aggregate(both, F.lit(0.0), lambda s, x: s + x))


def l2(v: Column) -> Column:
    """Scaled to length one; a zero vector stays zero."""
    d = v.cast("array<double>")
    norm = F.sqrt(F.aggregate(d, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(d, lambda x: x / F.greatest(norm, F.lit(TINY)))


def unit_interval(score: Column) -> Column:
    """A cosine in [-1, 1] as a score in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (score + 1) / 2))


def pair_features(q: Column, c: Column) -> Column:
    """Query vector, candidate vector, their product and their absolute difference, one after another."""
    q, c = q.cast("array<double>"), c.cast("array<double>")
    return F.concat(q, c, F.zip_with(q, c, lambda x, y: x * y), F.zip_with(q, c, lambda x, y: F.abs(x - y)))


#: Hashes of grams that a task keeps, as most grams of a batch are frequent ones.
KEPT = 200_000


def feature_hash(text: str | None, dim: int, ngrams: int, digest: str, known: dict[str, tuple[int, int]] | None = None) -> np.ndarray:
    """Signed counts of hashed tokens and n-grams, scaled to length one.  ``known``: hashes made before."""
    known = {} if known is None else known
    out = [0] * dim
    words = WORD.findall((text or "").lower())
    grams = list(words)
    for n in range(2, ngrams + 1):
        grams += [BIGRAM.join(words[i : i + n]) for i in range(len(words) - n + 1)]
    for g in grams:
        at = known.get(g)
        if at is None:
            raw = g.encode()
            if digest == "blake2b":
                v = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
            else:  # 60 bits, which any SQL engine can take from the hexadecimal digits
                v = int(hashlib.md5(raw).hexdigest()[:15], 16)
            if len(known) >= KEPT:
                known.clear()
            at = known[g] = v % dim, 1 if v & 1 else -1
        out[at[0]] += at[1]
    x = np.array(out, np.float64)
    norm = np.linalg.norm(x)
    return x / norm if norm else x


def embed(df: DataFrame, item: str, text: str, dim: int = 256, ngrams: int = 2, digest: str = "blake2b", double: bool = False) -> DataFrame:
    """(item, vector): hashing embedder, one pass without an exchange; null text gives the zero vector.

    With an odd number of dimensions sign and bucket are independent; with an even one the sign follows the bucket.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, int]] = {}
        for batch in batches:
            vectors = [feature_hash(t, dim, ngrams, digest, known) for t in batch.column(1).to_pylist()]
            kind = pa.float64() if double else pa.float32()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.astype(kind.to_pandas_dtype()) for v in vectors], pa.list_(kind))], names=["item", "vector"])

    schema = T.StructType([T.StructField("item", df.schema[item].dataType), T.StructField("vector", T.ArrayType(T.DoubleType() if double else T.FloatType()))])
    return df.select(F.col(item), F.col(text)).mapInArrow(run, schema).withColumnRenamed("item", item)


def split_side(seed: int, query_id: Column, fraction: float) -> Column:
    """``validation`` for a fixed share of the queries by the hash of seed and id, else ``train``."""
    top = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), query_id)), 1, 16), 16, 10).cast("decimal(20,0)")
    return F.when(top < F.lit(str(int(fraction * 2**64))).cast("decimal(20,0)"), F.lit("validation")).otherwise(F.lit("train"))
