"""Whole batches of texts as arrays of code points."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Classes of code points.  SPACE is what Java's \s matches: tab, line feed, vertical tab, form feed, return, space.
SPACE, WORD, HAN, OTHER, MARK = 0, 1, 2, 3, 4


def _class(cp: int) -> int:
    if cp in (9, 10, 11, 12, 13, 32):
        return SPACE
    if 0x4E00 <= cp <= 0x9FFF:
        return HAN
    kind = unicodedata.category(chr(cp))[0]
    return WORD if kind in "LN" else MARK if kind == "M" else OTHER


def _fold(cp: int) -> int:
    """Lower case without accents: the first code point of the lower-cased canonical decomposition."""
    return ord(unicodedata.normalize("NFD", chr(cp).lower())[0])


def _lower(cp: int) -> int:
    return ord(chr(cp).lower()[0])


@lru_cache(maxsize=None)
def _plane(name: str) -> np.ndarray:
    """The table of the first 65,536 code points."""
    rule = {"class": _class, "fold": _fold, "lower": _lower}[name]
    return np.fromiter((rule(c) if not 0xD800 <= c <= 0xDFFF else (OTHER if name == "class" else c) for c in range(0x10000)), np.uint32 if name != "class" else np.uint8, 0x10000)


def mapped(cps: np.ndarray, name: str) -> np.ndarray:
    """Look code points up; those beyond the first plane are rare and looked up one by one."""
    table = _plane(name)
    high = cps > 0xFFFF
    if not high.any():
        return table[cps]
    out = table[np.where(high, 0, cps)]
    rule = {"class": _class, "fold": _fold, "lower": _lower}[name]
    values, where = np.unique(cps[high], return_inverse=True)
    out[high] = np.array([rule(int(v)) for v in values])[where]
    return out


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points one after another, and where each text begins (one entry more than texts)."""
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.append(0, np.cumsum(lengths))


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of runs of about ``most`` code points; a longer text is a run by itself.  Null is empty."""
    first, held, size = 0, [], 0
    for i, t in enumerate(texts):
        t = t or ""
        if held and size + len(t) > most:
            yield first, held
            first, held, size = i, [], 0
        held.append(t)
        size += len(t)
    if held:
        yield first, held


_MULT, _INV = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.full(n, _MULT, np.uint64), np.full(n, _INV, np.uint64)
    a[0] = b[0] = 1
    return np.cumprod(a, dtype=np.uint64), np.cumprod(b, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(texts: list[str], accents: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and where each text's words begin (one entry more than texts).

    A word is a longest run of letters and digits in lower case; without ``accents``, letters lose theirs and combining
    marks are passed over.
    """
    cps, starts = code_points(texts)
    if not len(cps):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    kind = mapped(cps, "class")
    text = None
    if not accents and (kind == MARK).any():
        keep = kind != MARK
        starts = np.append(0, np.cumsum(keep))[starts]
        cps, kind = cps[keep], kind[keep]
    inside = (kind == WORD) | (kind == HAN)
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = starts[:-1][starts[:-1] < len(cps)]
    begin[first] = inside[first]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | begin[1:]
    a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
    n = max(1 << 20, 1 << int(len(cps) + 1).bit_length())
    up, down = _powers(n)
    letters = mapped(cps, "lower" if accents else "fold").astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(letters * up[: len(cps)], out=total[1:])
    hashes = mixed((total[b] - total[a]) * down[a])
    return hashes, np.searchsorted(a, starts)
