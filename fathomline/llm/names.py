"""Spellings of names that mean the same person or organisation."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.skew import join_by_key, join_salted
from ..plans.stage import stage, width

# Words that are no part of a name proper.
TITLES = "author ba bsc dame dr editor frau herr hon jr lady lord ma mba md messrs miss mlle mme mr mrs ms msc mx org phd prof professor rev sir sr".split()
LINKS = "a an and at by de der die for in la le of on the to von".split()
LEGAL = "ag co company corp corporation ev gmbh inc incorporated kg limited llc ltd plc sa".split()
NUMBERS = "no nr num number".split()
#: Fixed value: a role that is noted in brackets (elsewhere "Ed" is a name).
ROLE = re.compile(r"[(\[]\s*(?:ed|eds)\.?\s*[)\]]", re.IGNORECASE)
#: Short forms of given names in common use.
NICKNAMES = {
    "alexander": "alec alex sandy sascha sasha xander",
    "anastasia": "ana anya nastya stacy stasia",
    "andrew": "andy drew",
    "anthony": "tony",
    "barbara": "babs barb",
    "benjamin": "ben benji benny",
    "caroline": "carrie caro",
    "catherine": "cathy cate kate kathy kitty",
    "charles": "carl charlie chuck",
    "christopher": "chris kit",
    "daniel": "dan danny",
    "david": "dave davy",
    "dolores": "lola lolita",
    "dorothea": "dora dorothy dot dotty thea",
    "edward": "ed eddie ned ted teddy",
    "elisabeth": "bess beth betty ella elsa elsie liesl lisa liz lizzie",
    "elizabeth": "bess beth betty ella elsa elsie eliza libby lisa liz lizzie",
    "francesca": "cesca fran franca frankie",
    "francis": "frank",
    "frederick": "fred freddie freddy fritz rick",
    "gabriela": "gabi gaby ella",
    "george": "georgie",
    "giuseppe": "beppe peppe pino",
    "gregory": "greg",
    "harold": "hal harry",
    "henry": "hal hank harry",
    "ignacio": "iggy nacho",
    "ingrid": "inga inge",
    "james": "jack jamie jim jimmy",
    "johannes": "hannes hans jan johan john",
    "john": "jack johnny jon",
    "joseph": "joe joey",
    "katherine": "kate kathy katie kat kit kitty",
    "lawrence": "larry laurie lars",
    "leopold": "leo poldi",
    "margaret": "greta maggie marge meg megan peg peggy",
    "matthew": "matt",
    "matthias": "hias matt matze",
    "michael": "mick mike",
    "mireille": "mimi",
    "nathaniel": "nat nate nathan",
    "nicholas": "nick nico",
    "oskar": "ossi oscar",
    "patricia": "pat patty trish",
    "penelope": "nell pen penny",
    "peter": "pete",
    "philip": "phil pip",
    "quentin": "quin quinn",
    "rebecca": "becca becky",
    "richard": "dick rich rick ricky",
    "robert": "bert bob bobby rob robbie",
    "samuel": "sam sammy",
    "stephen": "steph steve steven",
    "susanna": "sanna sue susan susie suzy",
    "tadeusz": "tad tadek",
    "theodore": "ted teddy theo",
    "thomas": "tom tommy",
    "ulrike": "rike uli ulli",
    "valerie": "val",
    "victoria": "tori vicky vic",
    "william": "bill billy liam will willy",
    "xavier": "javi xavi",
    "yusuf": "joseph yus",
    "zacharias": "zach zack",
}
_DROP = {*TITLES, *LINKS, *LEGAL, *NUMBERS}
_FORMS = {*TITLES, *LEGAL}


class Lexicon:
    """Short forms of given names; another table than NICKNAMES may be given."""

    def __init__(self, nicknames: dict[str, str]):
        self.full: dict[str, set[str]] = {}
        self.short = {name: set(short.split()) for name, short in nicknames.items()}
        for name, short in self.short.items():
            for s in short:
                self.full.setdefault(s, set()).add(name)

    def same(self, a: str, b: str) -> bool:
        fa, fb = self.full.get(a, set()), self.full.get(b, set())
        return b in fa or a in fb or bool(fa & fb)

    def others(self, word: str) -> set[str]:
        """All words that may stand for the same given name."""
        full = self.full.get(word, set())
        return full.union(self.short.get(word, ()), *(self.short[f] for f in full))


USUAL = Lexicon(NICKNAMES)

#: Shared words of this length come before shorter ones; shortest word for which two edits count as a misspelling.
FULL, LONG = 5, 8
#: Longest word that may abbreviate another.
ABBREVIATION = 7
#: A longer name is linked to names of the same words only.
MOST_WORDS = 40


def folded(name: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", name.casefold()) if not unicodedata.combining(c))


@dataclass(frozen=True)
class Name:
    """words: tokens but titles, link words, legal forms and numbers; numbers; acronyms: letters of dotted or capital forms."""

    words: tuple[str, ...]
    numbers: tuple[str, ...]
    acronyms: tuple[str, ...]


@lru_cache(maxsize=10_000)
def parse(name: str) -> Name:
    """Tokens of a name: accents, case, and hyphens or apostrophes within a word don't count.

    "A." and a capital A behind another word are initials, any other "a" is a link word.
    """
    text = re.sub(r"(?<=\w)['’`\-‐](?=\w)", "", ROLE.sub(" ", name))
    acronyms = []

    def dotted(m: re.Match) -> str:
        letters = folded(m.group(0).replace(".", ""))
        if letters not in _FORMS:  # "I.N." is no "in"
            acronyms.append(letters)
        return " "

    text = re.sub(r"\b(?:\w\.){2,}(?!\w)", dotted, text)
    plain = text.upper() == text
    words, numbers = [], []
    for m in re.finditer(r"[^\W_]+", text):
        token, low = m.group(0), folded(m.group(0))
        initial = len(low) == 1 and (text[m.end() : m.end() + 1] == "." or (token.isupper() and (words or acronyms)))
        if low in _DROP and not initial:
            continue
        if low.isdigit():
            numbers.append(low)
        elif not plain and 2 <= len(token) <= 4 and token.isupper() and token.isalpha():
            acronyms.append(low)
        else:
            words.append(low)
    return Name(tuple(words), tuple(sorted(numbers)), tuple(sorted(acronyms)))


def edits(a: str, b: str, most: int = 2) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; ``most + 1`` where it would be more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, before2, row = row, before, [i]
        for j, y in enumerate(b, 1):
            v = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before2[j - 2] + 1)
            row.append(v)
        before = last
        if min(row) > most:
            return most + 1
    return min(row[-1], most + 1)


def _short_of(a: str, b: str) -> bool:
    """Whether a is an abbreviation of b: a prefix, or letters of it in order that keep its first and last."""
    if not 2 <= len(a) < len(b) or a[0] != b[0] or len(b) < 5 or len(a) > ABBREVIATION:
        return False
    if b.startswith(a):
        return len(a) >= 3
    if len(a) > 5:
        return False
    rest = iter(b)
    return all(c in rest for c in a) and (a[-1] == b[-1] or len(a) == 3)


#: Kinds of agreement between two tokens.
EQUAL, NICK, TYPO, SHORT, INITIAL = 0, 1, 2, 3, 4


@lru_cache(maxsize=50_000)
def agreement(a: str, b: str, lexicon: Lexicon = USUAL) -> tuple[int, int] | None:
    """(kind, cost) of two tokens that may be one word, else None."""
    if a == b:
        return (INITIAL if len(a) == 1 else EQUAL), 0
    if len(a) == 1 or len(b) == 1:
        return (INITIAL, 3) if a[0] == b[0] else None
    if lexicon.same(a, b):
        return NICK, 1
    most = _tolerance(a, b)
    if most and (d := edits(a, b, most)) <= most:
        return TYPO, d
    if _short_of(a, b) or _short_of(b, a):
        return SHORT, 2
    return None


def _tolerance(a: str, b: str) -> int:
    return 0 if min(len(a), len(b)) < 4 else 1 if max(len(a), len(b)) < LONG else 2


def _hungarian(small: list[int], large: list[int], cost: dict) -> list[tuple[int, int]]:
    """Optimal assignment: as many pairs as possible, then least cost, then few changes of order."""
    n, m = len(small), len(large)
    step = n * (max(small + large) + 1) + 1  # more than all changes of order together
    none = step * (4 * n + 1)
    weights = [[cost[i, j] * step + abs(i - j) - none if (i, j) in cost else 0 for j in large] for i in small]
    rows, columns, of, back = [0] * (n + 1), [0] * (m + 1), [0] * (m + 1), [0] * (m + 1)
    for i in range(1, n + 1):
        of[0], at = i, 0
        least, used = [float("inf")] * (m + 1), [False] * (m + 1)
        while of[at] or not at:
            used[at], row, delta, to = True, of[at], float("inf"), 0
            for j in range(1, m + 1):
                if not used[j]:
                    w = weights[row - 1][j - 1] - rows[row] - columns[j]
                    if w < least[j]:
                        least[j], back[j] = w, at
                    if least[j] < delta:
                        delta, to = least[j], j
            for j in range(m + 1):
                if used[j]:
                    rows[of[j]] += delta
                    columns[j] -= delta
                else:
                    least[j] -= delta
            at = to
            if not of[at]:
                break
        while at:
            of[at], at = of[back[at]], back[at]
    return [(small[of[j] - 1], large[j - 1]) for j in range(1, m + 1) if of[j] and (small[of[j] - 1], large[j - 1]) in cost]


def _assign(a: tuple[str, ...], b: tuple[str, ...], lexicon: Lexicon = USUAL) -> list[tuple[int, int, int]]:
    """Optimal assignment of tokens: as many pairs as possible, then least cost, then few changes of order."""
    kinds = {(i, j): k for i, x in enumerate(a) for j, y in enumerate(b) if (k := agreement(x, y, lexicon))}
    rows, columns = Counter(i for i, _ in kinds), Counter(j for _, j in kinds)
    pairs = [(i, j) for i, j in kinds if rows[i] == columns[j] == 1]  # no other way
    cost = {(i, j): k[1] for (i, j), k in kinds.items() if rows[i] > 1 or columns[j] > 1}
    left, right = sorted({i for i, _ in cost}), sorted({j for _, j in cost})
    if len(left) > len(right):
        pairs += [(i, j) for j, i in _hungarian(right, left, {(j, i): c for (i, j), c in cost.items()})]
    elif left:
        pairs += _hungarian(left, right, cost)
    return [(i, j, kinds[i, j][0]) for i, j in sorted(pairs)]


def _joined(words: tuple[str, ...], others: tuple[str, ...], lexicon: Lexicon) -> list[tuple[tuple[str, ...], int]]:
    """The words, and with each pair of neighbours written as one that is a word of the others; with the place of that one."""
    same = lambda w: any(k and k[0] in (EQUAL, TYPO) for k in (agreement(w, o, lexicon) for o in others))
    return [(words, -1), *(((*words[:i], w, *words[i + 2 :]), i) for i, w in _neighbours(words) if same(w))]


#: Links: two names that say the same (STRONG), or one that says less and might mean others too (the a or the b name).
STRONG, LESS_A, LESS_B = "s", "a", "b"


def compare(a: str, b: str, lexicon: Lexicon = USUAL) -> str | None:
    """How two names are linked, if at all.  The same letters are the same name, however they are spaced or dotted."""
    x, y = parse(a), parse(b)
    if x.numbers != y.numbers:
        return None
    if _letters(x) == _letters(y):
        return STRONG if x.numbers or _letters(x) else None
    if _sole(x) and _sole(y) and min(len(x.words[0]), len(y.words[0])) >= LONG and (agreement(x.words[0], y.words[0], lexicon) or (None,))[0] == TYPO:
        return STRONG
    best = None
    for wx, jx in _joined(x.words, y.words, lexicon):
        for wy, jy in _joined(y.words, x.words, lexicon):
            got = _compare(wx, wy, x, y, jx, jy, lexicon)
            if got == STRONG:
                return STRONG
            best = best or got
    return best


def _letters(p: Name) -> str:
    return "".join((*p.words, *p.acronyms))


def _sole(p: Name) -> bool:
    return len(p.words) == 1 and not p.acronyms


def _compare(wx: tuple[str, ...], wy: tuple[str, ...], x: Name, y: Name, jx: int, jy: int, lexicon: Lexicon) -> str | None:
    pairs = _assign(wx, wy, lexicon)
    # A word that was made of two must be the other's word, not an abbreviation of it.
    if (jx >= 0 and not any(i == jx and k in (EQUAL, TYPO) for i, _, k in pairs)) or (jy >= 0 and not any(j == jy and k in (EQUAL, TYPO) for _, j, k in pairs)):
        return None
    anchor = [(i, j) for i, j, k in pairs if k in (EQUAL, TYPO)]
    if not anchor:
        return None
    full = [(i, j) for i, j in anchor if min(len(wx[i]), len(wy[j])) >= FULL]
    restx, resty = [i for i in range(len(wx)) if i not in {p[0] for p in pairs}], [j for j in range(len(wy)) if j not in {p[1] for p in pairs}]
    # "Noor" and an abbreviation say too little of a name that goes on.
    if not full and any(k == SHORT for _, _, k in pairs) and any(len(w) > 1 for w in [wx[i] for i in restx] + [wy[j] for j in resty]):
        return None
    anchor = full or anchor
    acx, acy = list(x.acronyms), list(y.acronyms)
    for t in list(acx):
        if t in acy:
            acx.remove(t)
            acy.remove(t)
    weak = None
    # An acronym stands for the words that are left on the other side: all of them, in any order.
    if acx and not acy and not restx and Counter("".join(acx)) == Counter(wy[j][0] for j in resty):
        weak, resty, acx, spelled = LESS_A, [], [], True
    elif acy and not acx and not resty and Counter("".join(acy)) == Counter(wx[i][0] for i in restx):
        weak, restx, acy, spelled = LESS_B, [], [], True
    else:
        spelled = bool(x.acronyms) and x.acronyms == y.acronyms
    if acx or acy or (restx and resty) or (len(pairs) < 2 and not spelled and not x.numbers):
        return None
    if any(k == INITIAL for _, _, k in pairs):
        found = [_with_initials(wx, wy, pairs, restx, resty, i, j) for i, j in anchor]
        return STRONG if STRONG in found else next((f for f in found if f), None)
    # First given names must be partners of each other: the first words beside a shared one.
    if not x.numbers and not x.acronyms and not y.acronyms and not any(_same_head(wx, wy, pairs, i, j) for i, j in anchor):
        return None
    fullx, fully = [i for i in restx if len(wx[i]) > 1], [j for j in resty if len(wy[j]) > 1]
    return weak or (LESS_B if fullx else LESS_A if fully else STRONG)


def _given(words: tuple[str, ...], at: int) -> list[int]:
    return [i for i in range(len(words)) if i != at]


def _same_head(wx: tuple[str, ...], wy: tuple[str, ...], pairs: list[tuple[int, int, int]], i: int, j: int) -> bool:
    """Whether, beside the shared word at (i, j), the first words are partners, or no word is left over."""
    gx, gy = _given(wx, i), _given(wy, j)
    if not gx or not gy or len(gx) == len(gy):
        return True
    return {p[0]: p[1] for p in pairs}.get(gx[0]) == gy[0] or len(pairs) > 2


def _with_initials(wx, wy, pairs, restx, resty, i: int, j: int) -> str | None:
    """Names with initials: a full given name on both sides, or initials that may mean several people (weak)."""
    fullx, fully = any(len(wx[i]) > 1 for i in restx), any(len(wy[j]) > 1 for j in resty)
    # An initial stands for a given name: it is no partner while its own name has a word that the other lacks.
    for a, b, k in pairs:
        if k == INITIAL and ((fullx and len(wx[a]) == 1 < len(wy[b])) or (fully and len(wy[b]) == 1 < len(wx[a]))):
            return None
    less = LESS_B if fullx else LESS_A if fully else None
    gx, gy = _given(wx, i), _given(wy, j)
    to = {p[0]: p for p in pairs}
    head = to.get(gx[0]) if gx else None
    if head is None or not gy or head[1] != gy[0]:
        return None
    if head[2] != INITIAL:
        return less or STRONG
    one, two = len(wx[gx[0]]) == 1, len(wy[gy[0]]) == 1
    if one and two:
        return less or STRONG
    return LESS_A if one else LESS_B


# ---- Index and pairs ------------------------------------------------------------------------------------------------


def deletes(token: str, most: int) -> set[str]:
    out, edge = {token}, {token}
    for _ in range(most):
        edge = {t[:i] + t[i + 1 :] for t in edge for i in range(len(t))}
        out |= edge
    return out


def _reach(token: str) -> int:
    return 0 if len(token) < 4 else 1 if len(token) < LONG - 1 else 2


def _neighbours(words: tuple[str, ...]) -> list[tuple[int, str]]:
    """(place, word) of every two neighbours written as one."""
    return [(i, words[i] + words[i + 1]) for i in range(len(words) - 1)] if len(words) > 2 else []


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, token, written): the words of a name, and neighbours that are written as one."""
    for batch in batches:
        at, tokens, written = [], [], []
        for row, name in enumerate(batch.column("name").to_pylist()):
            words = parse(name).words
            if len(words) <= MOST_WORDS:
                own = {w for w in words if len(w) > 1}
                both = {w for _, w in _neighbours(words)} - own
                at += [row] * (len(own) + len(both))
                tokens += [*own, *both]
                written += [True] * len(own) + [False] * len(both)
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), pa.array(tokens, pa.string()), pa.array(written, pa.bool_())], names=["id", "token", "written"])


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, token, written) of the symmetric-delete index: the token without up to one or two letters."""
    for batch in batches:
        keys, at = [], []
        for row, t in enumerate(batch.column("token").to_pylist()):
            some = deletes(t, _reach(t))
            keys += some
            at += [row] * len(some)
        at = pa.array(at, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column("token").take(at), batch.column("written").take(at)], names=["key", "token", "written"])


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = [bool(most := _tolerance(a, b)) and edits(a, b, most) <= most for a, b in zip(batch.column("token").to_pylist(), batch.column("other").to_pylist())]
        yield batch.filter(pa.array(near, pa.bool_()))


def _as_short(w: str) -> set[str]:
    """What a word shares with all that it may abbreviate (``_as_long``); see ``_short_of``."""
    n = len(w)
    return {x for x, holds in (("p" + w[:3], 3 <= n <= ABBREVIATION), ("q" + w[0] + w[-1], 2 <= n <= 5), ("t" + w[0], n == 3)) if holds}


def _as_long(w: str) -> set[str]:
    return {"p" + w[:3], "q" + w[0] + w[-1], "t" + w[0]} if len(w) >= 5 else set()


def _asked(w: str, near: list[str], lexicon: Lexicon) -> set[str]:
    """What a partner of ``w`` in another name must show (``_shown``); ``near``: words that count as equal."""
    if len(w) == 1:
        return {"i" + w, "j" + w}
    return {"w" + t for t in {*near, *lexicon.others(w)}} | {"i" + w[0]} | {"<" + f for f in _as_short(w)} | {">" + f for f in _as_long(w)}


def _shown(w: str) -> set[str]:
    if len(w) == 1:
        return {"i" + w}
    return {"w" + w, "j" + w[0]} | {"<" + f for f in _as_long(w)} | {">" + f for f in _as_short(w)}


def _keys_of(p: Name, known: dict[str, tuple[int, bool, list[str]]], lexicon: Lexicon) -> tuple[set[str], set[str]]:
    """Keys that a name shows, and keys that it asks others for: a word of theirs, and what another of theirs must show.

    Of two linked names one, the asking, has a partner for each of its words, and one of these pairs, the anchor, is
    equal or misspelt and has two letters or more.  So it asks for its rarest word as the anchor, with its second
    rarest, and for each other word as the anchor with the rarest, which then is no anchor.  Names of the same letters
    meet under these.  known: names with a token, whether it links names at all, and tokens near it.
    """
    lead, words = ",".join(p.numbers) + "|", p.words
    if len(words) > MOST_WORDS:
        return set(), set()
    joined = [(i, w) for i, w in _neighbours(words) if w in known and known[w][1]]
    near = lambda w: [w, *(known[w][2] if w in known else ())]
    alone = lambda w: known[w][0] == 1 and not known[w][2]
    order = lambda w: (len(w) == 1, known[w][0] if w in known else 0, w)
    # What a name of one word shows besides it.
    other = {""} if p.numbers else {k + p.acronyms[0][0] for k in "ij"} if p.acronyms else set()
    shown, asked = {f"{lead}={_letters(p)}"}, {f"{lead}={t}" for t in ({_letters(p), *near(words[0])} if _sole(p) else {_letters(p)})}

    def show(token: str, marks: set[str]) -> None:
        marks |= {"j" + a[0] for a in p.acronyms} | ({""} if p.numbers else set())
        shown.update(f"{lead}{token}|{m}" for m in marks)

    def ask(token: str, marks: set[str]) -> None:
        asked.update(f"{lead}{t}|{m}" for t in near(token) for m in marks)

    rarest = min(range(len(words)), key=lambda i: order(words[i])) if words else -1
    for i, w in enumerate(words):
        if len(w) > 1 and not alone(w):
            others = [*words[:i], *words[i + 1 :]]
            show(w, {m for x in others for m in _shown(x)} | {"w" + x for k, x in joined if i not in (k, k + 1)})
            if not others:
                ask(w, other)
            elif i == rarest:
                second = min(others, key=order)
                ask(w, _asked(second, near(second), lexicon))
            else:
                ask(w, _asked(words[rarest], [], lexicon))
    for k, w in joined:
        others = [*words[:k], *words[k + 2 :]]
        show(w, {m for x in others for m in _shown(x)} | {"w" + x for i, x in joined if abs(i - k) > 1})
        second = min(others, key=order)
        ask(w, _asked(second, near(second), lexicon))
    return shown, asked


def _keys(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, asks = [], [], []
            for row, (name, tokens) in enumerate(zip(batch.column("name").to_pylist(), batch.column("tokens").to_pylist())):
                known = {t["token"]: (t["n"], t["some"], t["near"] or []) for t in tokens or []}
                shown, asked = _keys_of(parse(name), known, lexicon)
                keys += [*shown, *asked]
                at += [row] * (len(shown) + len(asked))
                asks += [False] * len(shown) + [True] * len(asked)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), pa.array(keys, pa.string()), pa.array(asks, pa.bool_())], names=["id", "key", "asks"])

    return run


def candidate_pairs(names: DataFrame, lexicon: Lexicon = USUAL) -> DataFrame:
    """(a, b), a < b: names that may be linked; see ``_keys_of`` for why none is missed.

    names: id (unique, any type), name.  The symmetric-delete index holds each distinct token once, however many names
    have it.  A pair meets under two shared features, of which one is the asking name's rarest word: no common token,
    nor pair of common tokens, has all its names paired.
    """
    kind = names.schema["id"].dataType.simpleString()
    tokens = stage(names.mapInArrow(_tokens, f"id {kind}, token string, written boolean"), "tokens")
    vocabulary = stage(tokens.groupBy("token").agg(F.count("*").alias("n"), F.max("written").alias("written")), "vocabulary")
    some = vocabulary.where(F.length("token") >= 4)
    posted = stage(some.mapInArrow(_postings, "key string, token string, written boolean").withColumn("key", F.xxhash64("key")), "postings")
    other = posted.select("key", F.col("token").alias("other"), F.col("written").alias("whole"))
    met = posted.join(other, "key").where("token < other and (written or whole)").select("token", "other", "written", "whole").distinct()
    found = stage(met.mapInArrow(_near, met.schema), "near")
    both = found.select("token", "other", "whole").unionByName(found.select(F.col("other").alias("token"), F.col("token").alias("other"), F.col("written").alias("whole")))
    near = both.groupBy("token").agg(F.collect_list("other").alias("near"), F.max("whole").alias("by"))
    # A joined token that no written one equals or resembles links nothing.
    known = stage(vocabulary.join(near, "token", "left").select("token", "n", (F.col("written") | F.coalesce("by", F.lit(False))).alias("some"), "near").where("some"), "known")
    total = tokens.count()
    told = join_by_key(tokens.select("id", "token"), known, "token", "n", total)
    of = told.groupBy("id").agg(F.collect_list(F.struct("token", "n", "some", "near")).alias("tokens"))
    keys = stage(names.join(of, "id", "left").mapInArrow(_keys(lexicon), f"id {kind}, key string, asks boolean").withColumn("key", F.xxhash64("key")), "keys")
    asking, showing = keys.where("asks").select("key", F.col("id").alias("x")), keys.where("not asks").select("key", F.col("id").alias("y"))
    pairs = join_salted(asking, showing, "key", "y").where("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds what a name says, as text: names that say the same are compared once."""
    for batch in batches:
        said = ["|".join((" ".join(p.words), " ".join(p.numbers), " ".join(p.acronyms))) for p in map(parse, batch.column("name").to_pylist())]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string())], names=[*batch.schema.names, "said"])


def _selves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds whether two entities of one name are linked."""
    for batch in batches:
        linked = [n > 1 and kind != "o" and (len(parse(name).words) > MOST_WORDS or compare(name, name) == STRONG) for name, n, kind in zip(*(batch.column(c).to_pylist() for c in ("name", "n", "kind")))]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(linked, pa.bool_())], names=[*batch.schema.names, "linked"])


def _linked(lexicon: Lexicon):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [compare(a, b, lexicon) for a, b in zip(batch.column("name_a").to_pylist(), batch.column("name_b").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(kinds, pa.string())], names=["a", "b", "link"])

    return run


def variants(df: DataFrame, entity: str, name: str, kind: str, kinds: tuple[str, ...], others: tuple[str, ...], lexicon: Lexicon = USUAL) -> DataFrame:
    """(entity, cluster) of every entity that has other spellings; a cluster is named by its smallest id.

    Pairs whose kinds are both of ``others``, or one of those and one unknown, are no case; a wrong or null kind on one
    side does not hinder a link to one of ``kinds``.  Null or empty ids and names are left out; of a repeated id the
    smallest name counts; an empty table gives no rows; other columns are ignored.  A name of more than MOST_WORDS
    words is linked to names of the same words only.

    A name that says less than another (initials, an acronym, a missing part) joins only if all fuller names that it
    fits belong together; otherwise it stays by itself.
    """
    rows = df.select(F.col(entity).cast("string").alias("id"), F.col(name).cast("string").alias("name"), F.lower(F.col(kind)).alias("kind")).where("id is not null and trim(name) <> ''")
    rows = rows.groupBy("id").agg(F.min("name").alias("name"), F.min("kind").alias("kind"))
    rows = rows.withColumn("kind", F.when(F.col("kind").isin(*kinds), "k").when(F.col("kind").isin(*others), "o").otherwise("u"))
    rows = stage(rows.mapInArrow(_parsed, "id string, name string, kind string, said string").withColumn("said", F.concat_ws("|", "kind", "said")), "names")
    nodes = rows.groupBy("said").agg(F.min("name").alias("name"), F.first("kind").alias("kind"), F.min("id").alias("least"), F.count("*").alias("n"))
    nodes = nodes.mapInArrow(_selves, "said string, name string, kind string, least string, n long, linked boolean")
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")  # fixed from here on, as it is written
    pairs = candidate_pairs(nodes.select(F.col("node").alias("id"), "name"), lexicon)
    end = lambda s: nodes.select(F.col("node").alias(s), F.col("name").alias(f"name_{s}"), F.col("kind").alias(f"kind_{s}"))
    both = pairs.join(end("a"), "a").join(end("b"), "b")
    both = both.where("not ((kind_a = 'o' and kind_b <> 'k') or (kind_b = 'o' and kind_a <> 'k'))")
    even = both.select("a", "b", "name_a", "name_b").repartition(width(df.sparkSession))  # few bytes, much work
    links = stage(even.mapInArrow(_linked(lexicon), "a long, b long, link string").where("link is not null"), "links")
    found = clusters(links)
    of = nodes.join(found, "node", "left").where("component is not null or linked")
    of = stage(of.select("said", "n", "least", F.coalesce("component", "node").alias("component")), "clustered")
    called = of.groupBy("component").agg(F.min("least").alias("cluster"))
    return join_by_key(rows.select(F.col("id").alias(entity), "said"), of.join(called, "component").select("said", "n", "cluster"), "said", "n", rows.count()).select(entity, "cluster")


def clusters(links: DataFrame) -> DataFrame:
    """(node, component) by links (a, b, link): names that say less join where all fuller names are one cluster."""
    strong = links.where(F.col("link") == STRONG)
    fuller = F.when(F.col("link") == LESS_A, F.col("b")).otherwise(F.col("a"))
    weak = links.where(F.col("link") != STRONG).select(F.when(F.col("link") == LESS_A, F.col("a")).otherwise(F.col("b")).alias("x"), fuller.alias("y"))
    found = stage(components(strong, "a", "b"), "clusters")
    left = weak
    of = lambda found, s: found.select(F.col("node").alias(s), F.col("component").alias(f"c{s}"))
    while True:  # a name that joined may leave another only one way to go; every round merges clusters
        left = left.join(of(found, "x"), "x", "left").join(of(found, "y"), "y", "left").select(F.coalesce("cx", "x").alias("x"), F.coalesce("cy", "y").alias("y")).where("x <> y").distinct()
        left = stage(left, "weak")
        sole = stage(left.groupBy("x").agg(F.min("y").alias("y"), F.count("*").alias("n")).where("n = 1").select("x", "y"), "sole")
        if not sole.head(1):
            return found
        merged = stage(components(sole, "x", "y"), "merged")
        moved = found.join(merged.select(F.col("node").alias("component"), F.col("component").alias("now")), "component", "left").select("node", F.coalesce("now", "component").alias("component"))
        fresh = merged.join(found.select("node"), "node", "left_anti")
        found = stage(moved.unionByName(fresh), "clusters")
