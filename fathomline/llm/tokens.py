"""The project's tokens, counted in the JVM or located in arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import HAN, OTHER, SPACE, WORD, code_points, mapped

#: Fixed value: the token pattern of the test data (Java syntax).
PATTERN = r"[\x{4e00}-\x{9fff}]|[\p{L}\p{N}&&[^\x{4e00}-\x{9fff}]]{1,8}|[^\s\p{L}\p{N}]"
#: Letters and digits in one token at most.
LONGEST = 8


def count(text: Column) -> Column:
    """Number of tokens; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(PATTERN)), F.lit(0)).cast("long")


class Tokens:
    """Where the tokens of a batch of texts begin, as arrays.

    starts: position of each token's first code point, for all texts one after another; bounds: index of each text's
    first token (one entry more than texts); chars: where each text begins.
    """

    def __init__(self, texts: list[str]):
        self.cps, self.chars = code_points(texts)
        kind = mapped(self.cps, "class")
        kind[kind > OTHER] = OTHER
        self.kind = kind
        word = kind == WORD
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        first = self.chars[:-1][self.chars[:-1] < len(kind)]
        begin[first] = word[first]
        at = np.arange(len(kind), dtype=np.int32)
        run = np.maximum.accumulate(np.where(begin, at, 0).astype(np.int32)) if len(kind) else at
        token = (kind == HAN) | (kind == OTHER) | (word & ((at - run) % LONGEST == 0))
        self.starts = np.flatnonzero(token)
        self.bounds = np.searchsorted(self.starts, self.chars)

    def breaks(self) -> tuple[np.ndarray, np.ndarray]:
        """For the place before each token: whether it is a natural boundary, and whether there is white space.

        Natural: a line end in the gap; or a full stop, question or exclamation mark, semicolon or ellipsis before it,
        followed by white space (for those of Chinese print, by anything).
        """
        s = self.starts
        space = np.zeros(len(s), bool)
        natural = np.zeros(len(s), bool)
        if len(s) > 1:
            space[1:] = self.kind[s[1:] - 1] == SPACE
            lines = np.append(0, np.cumsum((self.cps == 10) | (self.cps == 13)))
            natural[1:] = lines[s[1:]] > lines[s[:-1]]
            before = self.cps[s[:-1]]
            natural[1:] |= space[1:] & np.isin(before, [ord(c) for c in ".!?;…"])
            natural[1:] |= np.isin(before, [ord(c) for c in "。！？；"])
        return natural, space
