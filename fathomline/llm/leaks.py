"""Evaluation passages inside a training corpus: SimHash windows, Hamming blocks, weighted shingles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import chunks, mixed, words

#: Fixed values of the task: markup tags and named entities count as a space.
TAG, ENTITY = re.compile(r"<[^<>]{0,40}>"), re.compile(r"&[a-z]{2,6};")
#: Words in a window: the shortest run that counts as a passage.
RUN = 8
#: Fingerprints within this Hamming distance are compared; RADIUS + 1 blocks find all of them.
RADIUS = 3
#: Windows of evaluation texts that one pass over the corpus carries (some 100 bytes each).
PASS_WINDOWS = 200_000
#: Bits of a block, and (window, fingerprint) or (pair, shingle) rows that are compared at a time.
_BITS, _AT_ONCE = 64 // (RADIUS + 1), 1 << 20


def plain(text: str) -> str:
    """Without markup tags and named entities."""
    if "<" in text:
        text = TAG.sub(" ", text)
    return ENTITY.sub(" ", text) if "&" in text else text


def simhashes(hashes: np.ndarray) -> np.ndarray:
    """64-bit SimHash of every window of RUN successive words: the majority of the words' bits (ties: 0)."""
    n = len(hashes) - RUN + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    two = bits[:-1] + bits[1:]
    four = two[:-2] + two[2:]
    return np.packbits(four[:n] + four[4:] > RUN // 2, axis=1).view(np.uint64).ravel()


def exact(hashes: np.ndarray) -> np.ndarray:
    """Hash of every window of RUN successive words, in order."""
    n = len(hashes) - RUN + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(RUN):
        out = mixed(out + hashes[k : k + n]) if n > 0 else out
    return out


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, n of them."""
    return np.repeat(first - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())


def _slices(n: np.ndarray) -> Iterator[slice]:
    """Slices of successive entries of about _AT_ONCE in sum, one entry at least."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + _AT_ONCE, "right")))
        yield slice(a, b)
        a = b


@dataclass
class Index:
    """Evaluation texts: their shingles in order, those of item i from first[i] on, and which fingerprints have which items.

    simhash: distinct fingerprints; items: those with fingerprint f from of[f] on; blocks: fingerprints by the value of
    each of their RADIUS + 1 blocks.
    """

    n_words: np.ndarray
    exact: np.ndarray
    place: np.ndarray
    first: np.ndarray
    simhash: np.ndarray
    items: np.ndarray
    of: np.ndarray
    blocks: list[tuple[np.ndarray, np.ndarray]]

    @staticmethod
    def of_texts(texts: list[str | None]) -> Index:
        hashes, bounds = words([plain(t or "") for t in texts], accents=False)
        n_words = np.diff(bounds)
        sim, ex = simhashes(hashes), exact(hashes)
        item = np.repeat(np.arange(len(texts)), n_words)[: len(sim)]
        place = np.arange(len(sim)) - bounds[item] if len(sim) else np.zeros(0, np.int64)
        whole = place + RUN <= n_words[item] if len(sim) else np.zeros(0, bool)
        sim, ex, item, place = sim[whole], ex[whole], item[whole], place[whole]
        prints, at = np.unique(sim, return_inverse=True)
        both = np.unique(at * len(texts) + item)
        blocks = []
        for b in range(RADIUS + 1):
            part = _block(prints, b)
            order = np.argsort(part, kind="stable")
            blocks.append((order, np.searchsorted(part[order], np.arange((1 << _BITS) + 1))))
        first = np.searchsorted(item, np.arange(len(texts) + 1))
        return Index(n_words, ex, place, first, prints, both % max(1, len(texts)), np.searchsorted(both // max(1, len(texts)), np.arange(len(prints) + 1)), blocks)

    def near(self, sim: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window of the document, fingerprint of the index) wherever the fingerprints are within RADIUS.

        Two fingerprints that differ in at most RADIUS bits agree in one of RADIUS + 1 blocks.
        """
        windows, prints = [], []
        for b, (order, start) in enumerate(self.blocks):
            mine = _block(sim, b)
            lo, n = start[mine], start[mine + 1] - start[mine]
            maybe = np.flatnonzero(n)
            lo, n = lo[maybe], n[maybe]
            for s in _slices(n):
                left, right = np.repeat(maybe[s], n[s]), order[_spread(lo[s], n[s])]
                close = np.bitwise_count(sim[left] ^ self.simhash[right]) <= RADIUS
                windows.append(left[close])
                prints.append(right[close])
        if not sum(map(len, windows)):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        both = np.unique(np.concatenate(windows) * len(self.simhash) + np.concatenate(prints))
        return both // len(self.simhash), both % len(self.simhash)

    def proposed(self, hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """document * items + item of all that have windows whose fingerprints are near."""
        found = [np.zeros(0, np.int64)]
        # Fingerprints take 64 bytes a word: a long text is taken in parts that overlap by a window.
        for a in range(0, max(0, len(hashes) - RUN + 1), 1 << 16):
            window, fp = self.near(simhashes(hashes[a : a + (1 << 16) + RUN - 1]))
            doc = np.searchsorted(bounds, window + a, side="right") - 1
            ok = window + a + RUN <= bounds[doc + 1]
            both = np.unique(doc[ok] * len(self.simhash) + fp[ok])
            doc, fp = both // max(1, len(self.simhash)), both % max(1, len(self.simhash))
            n = self.of[fp + 1] - self.of[fp]
            found += [np.unique(np.repeat(doc[s], n[s]) * len(self.n_words) + self.items[_spread(self.of[fp[s]], n[s])]) for s in _slices(n)]
        return np.unique(np.concatenate(found))

    def contained(self, hashes: np.ndarray, bounds: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of proposed pairs those that share shingles, and the weight of these.

        A shingle (RUN successive words) of the item weighs the words that no shared one before it covers, so the weights
        add up to the words in shared runs.
        """
        docs = np.unique(pairs // len(self.n_words))
        n = np.maximum(bounds[docs + 1] - bounds[docs] - RUN + 1, 0)
        shingles = np.sort(mixed(exact(hashes)[_spread(bounds[docs], n)] + mixed(np.repeat(docs, n).astype(np.uint64) + np.uint64(1))))
        keys, weights = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        item = pairs % len(self.n_words)
        n = self.first[item + 1] - self.first[item]
        for s in _slices(n):
            pair, own = np.repeat(pairs[s], n[s]), _spread(self.first[item[s]], n[s])
            want = mixed(self.exact[own] + mixed((pair // len(self.n_words)).astype(np.uint64) + np.uint64(1)))
            at = np.searchsorted(shingles, want)
            shared = at < len(shingles)
            shared[shared] = shingles[at[shared]] == want[shared]
            if shared.any():
                key, weight = covered(pair[shared], self.place[own[shared]])
                keys.append(key)
                weights.append(weight)
        return np.concatenate(keys), np.concatenate(weights)


def _block(sim: np.ndarray, b: int) -> np.ndarray:
    return ((sim >> np.uint64(b * _BITS)) & np.uint64((1 << _BITS) - 1)).astype(np.int64)


def covered(key: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words covered by the windows at ``place`` of each key: distinct keys and the size of the windows' union."""
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    step = np.full(len(key), RUN)
    same = key[1:] == key[:-1]
    step[:-1][same] = np.minimum(RUN, place[1:] - place[:-1])[same]
    keys, at = np.unique(key, return_index=True)
    return keys, np.add.reduceat(step, at)


def _scan(index: Index, share: tuple[int, int], names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            found: list[tuple] = []
            for at, some in chunks(texts, 1 << 19):
                hashes, bounds = words([plain(t) for t in some], accents=False)
                pairs = index.proposed(hashes, bounds)
                if len(pairs):
                    keys, weight = index.contained(hashes, bounds, pairs)
                    n = len(index.n_words)
                    enough = weight * share[1] >= index.n_words[keys % n] * share[0]
                    found += zip((at + keys[enough] // n).tolist(), (keys[enough] % n).tolist(), weight[enough].tolist())
            if found:
                doc, item, n = zip(*found)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc, pa.int64())), pa.array([names[i] for i in item], pa.string()), pa.array(n, pa.int64())], names=["doc", "item", "words"])

    return run


def leaks(docs: DataFrame, doc: str, text: str, items: DataFrame, item: str, item_text: str, share: tuple[int, int] = (2, 5)) -> DataFrame:
    """(doc, item, words): documents in which runs of at least RUN successive words of an item hold ``share`` of its words.

    Case, accents, markup tags and named entities are disregarded.  Null or blank texts, and items of fewer than RUN
    words, have no window and so no row; null item ids are left out, a repeated item counts once; repeated documents
    give repeated rows; an empty table on either side gives no rows; other columns are ignored.

    A window of a whole item cannot be found by its fingerprint when 60% of the item is missing (the expected distance
    is near that of unrelated texts), so windows have the length of the shortest run that counts.  Every window that
    two texts share has distance 0, which the blocks guarantee to find, so no leak is lost.  Fingerprints within RADIUS
    propose a document and an item; the weighted shingles of the whole item, looked up in the document, decide.

    The held-out items are a table of fixed, small size.  It is carried to the workers in passes of at most
    PASS_WINDOWS windows; a larger one takes more passes.  The corpus is scanned once a pass and never moved.
    """
    held = items.select(F.col(item).cast("string").alias("i"), F.col(item_text).alias("t")).where(F.col("i").isNotNull()).groupBy("i").agg(F.min("t").alias("t"))
    schema = T.StructType([T.StructField("doc", docs.schema[doc].dataType), T.StructField("item", T.StringType()), T.StructField("words", T.LongType())])
    rows = docs.select(F.col(doc), F.col(text))
    out = None
    for names, texts in _passes(held):
        part = rows.mapInArrow(_scan(Index.of_texts(texts), share, names), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _passes(held: DataFrame) -> Iterator[tuple[list[str], list[str]]]:
    """Items in passes that hold at most PASS_WINDOWS windows each (one text at least)."""
    names, texts, size = [], [], 0
    for r in held.orderBy("i").toLocalIterator():
        n = len(r["t"] or "") // 2 + 1  # no more windows than half the letters
        if names and size + n > PASS_WINDOWS:
            yield names, texts
            names, texts, size = [], [], 0
        names.append(r["i"])
        texts.append(r["t"] or "")
        size += n
    if names:
        yield names, texts
