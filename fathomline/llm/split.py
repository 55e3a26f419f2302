"""Cutting long documents at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import chunks
from .tokens import Tokens


def successors(natural: np.ndarray, space: np.ndarray, ends: np.ndarray, reach: int) -> np.ndarray:
    """For every place c: the farthest legal cut in (c, c + reach], or the end of its text where that is in reach.

    ``ends`` holds, for every place, the end of its text.  A natural boundary is taken if there is one in reach, else
    the last white space, else c + reach.  Arrays cover all places, the end of the last text included.
    """
    n = len(ends)
    at = np.arange(n, dtype=np.int64)
    last_natural = np.maximum.accumulate(np.where(natural, at, -1))
    last_space = np.maximum.accumulate(np.where(space, at, -1))
    far = np.minimum(at + reach, ends)
    out = last_natural[far]
    out = np.where(out > at, out, last_space[far])
    out = np.where(out > at, out, far)
    return np.where(at + reach >= ends, ends, out)


def doubled(first: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """All places reached from ``first`` by following ``successor``, sorted: after r rounds, 2**r steps are known.

    Each round joins the places found so far to their successors' table and squares that table.
    """
    found = np.unique(first)
    table = successor
    while True:
        more = table[found]
        grown = np.union1d(found, more)
        if len(grown) == len(found):
            return found
        found, table = grown, table[table]


def cut_points(t: Tokens, size: int, overlap: int) -> list[np.ndarray]:
    """For each text, the ascending ends of its pieces in tokens of the batch (none for an empty text)."""
    natural, space = t.breaks()
    counts = np.diff(t.bounds)
    # Each text gets one place more than it has tokens: its end.
    offsets = np.append(0, np.cumsum(counts + 1))
    places = np.arange(len(t.starts)) + np.repeat(np.arange(len(counts)), counts)
    total = int(offsets[-1])
    nat, spc = np.zeros(total, bool), np.zeros(total, bool)
    nat[places], spc[places] = natural, space
    begins = offsets[:-1]
    nat[begins] = spc[begins] = False
    ends = np.repeat(offsets[1:] - 1, counts + 1)
    first = successors(nat, spc, ends, size)[begins]
    found = doubled(first, successors(nat, spc, ends, size - overlap))
    text = np.searchsorted(offsets, found, side="right") - 1
    local = found - text  # back to tokens of the batch
    return np.split(local, np.searchsorted(text, np.arange(1, len(counts))))


def _cut(size: int, overlap: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at, some in chunks(texts):
                t = Tokens(some)
                rows: list[tuple] = []
                for i, ends in enumerate(cut_points(t, size, overlap)):
                    lo, hi, char = int(t.bounds[i]), int(t.bounds[i + 1]), int(t.chars[i])
                    if lo == hi:
                        continue
                    starts = [lo, *(int(e) - overlap for e in ends[:-1])]
                    for k, (a, b) in enumerate(zip(starts, ends)):
                        b = int(b)
                        ca = int(t.starts[a]) - char if k else 0
                        cb = int(t.starts[b]) - char if b < hi else len(some[i])
                        rows.append((at + i, k, a - lo, b - lo, ca, cb, some[i][ca:cb] if with_text else None))
                if rows:
                    row, *columns = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row, pa.int64())), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string())],
                        names=["doc", "piece", "first_token", "end_token", "first_char", "end_char", "piece_text"],
                    )

    return run


def split_documents(df: DataFrame, doc: str, text: str, size: int = 512, overlap: int = 64, with_text: bool = True) -> DataFrame:
    """Pieces of at most ``size`` tokens, each but the first beginning ``overlap`` tokens before the end of the last.

    Columns: doc, piece (from 0), first_token, end_token (exclusive), first_char, end_char, piece_text.  A text of at
    most ``size`` tokens is one piece; null and empty texts, and such without a token, give none.  Cuts are the greedy
    ones: each as far on as possible, at a natural boundary where one is in reach, else at white space, else between
    tokens.  Null ids and repeated rows are documents like others; an empty table gives no rows.

    All cuts of a batch follow from one table of successors by pointer doubling.  A document is one row, so its
    boundaries are in one place already, and joining them needs no exchange.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and less than size")
    schema = T.StructType([T.StructField("doc", df.schema[doc].dataType), *(T.StructField(n, T.LongType()) for n in ("piece", "first_token", "end_token", "first_char", "end_char")), T.StructField("piece_text", T.StringType())])
    out = df.select(F.col(doc), F.col(text)).mapInArrow(_cut(size, overlap, with_text), schema)
    return out.withColumnRenamed("doc", doc)
