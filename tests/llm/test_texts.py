import collections
import random
import re
import unicodedata

import numpy as np
import pytest

from fathomline.llm.chars import words
from fathomline.llm.leaks import RADIUS, RUN, Index, leaks, simhashes
from fathomline.llm.overlap import overlaps, record_pairs, report, shared_words
from fathomline.llm.pack import pack, plan
from fathomline.llm.split import doubled, split_documents
from fathomline.llm.tokens import Tokens, count

TOKEN = re.compile("[一-鿿]|(?:(?![一-鿿])[^\\W_]){1,8}|[^ \t\n\x0b\f\r]")
TEXTS = [None, "", " \n ", "one", "a" * 17, "Hello, world! Wie geht's?\nNew line", "桥梁狭窄。山谷x村庄", "x_y z", "tabs\tand  spaces;", "😀 emoji 12345678901"]


def tokens_of(t):
    return TOKEN.findall(t or "")


def test_tokens_agree(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    jvm = [r[0] for r in df.orderBy("i").select(count(df["t"])).collect()]
    assert jvm == [len(tokens_of(t)) for t in TEXTS]
    assert np.diff(Tokens([t or "" for t in TEXTS]).bounds).tolist() == jvm


def long_text(r, n, ends):
    return "".join(r.choice(["word", "Satz", "汉", "a" * 20, "9"]) + r.choice(ends) for _ in range(n))


@pytest.mark.parametrize("seed", range(4))
def test_split_round_trip(spark, seed):
    r = random.Random(seed)
    texts = [*TEXTS, *(long_text(r, r.randrange(1, 400), e) for e in ([" ", ". ", "\n"], [" "], [""], [" "] * 30 + ["! "]))]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(None, "a b", 0), (3, "one", 0)], "doc_id int, text string, piece int")
    out = collections.defaultdict(list)
    for row in split_documents(df, "doc_id", "text", 20, 5).collect():
        out[row["doc_id"]].append(row)
    assert len(out[None]) == 1 and len(out[3]) == 2
    for i, t in enumerate(texts):
        n, pieces = len(tokens_of(t)), sorted(out.get(i, []), key=lambda p: p["piece"])
        if i == 3:
            continue
        assert bool(pieces) == (n > 0)
        for k, p in enumerate(pieces):
            assert p["piece"] == k and p["piece_text"] == t[p["first_char"] : p["end_char"]]
            assert len(tokens_of(p["piece_text"])) == p["end_token"] - p["first_token"] <= 20
            assert p["first_token"] == (pieces[k - 1]["end_token"] - 5 if k else 0)
        if pieces:
            assert pieces[0]["first_char"] == 0 and pieces[-1]["end_char"] == len(t) and pieces[-1]["end_token"] == n


def test_split_takes_natural_boundaries(spark):
    text = " ".join(f"w{i}." if i % 7 == 6 else f"w{i}" for i in range(60))
    rows = split_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", 20, 4).orderBy("piece").collect()
    assert len(rows) > 1 and all(r["piece_text"].rstrip().endswith(".") for r in rows[:-1])
    with pytest.raises(ValueError):
        split_documents(spark.createDataFrame([(1, text)], "doc_id int, text string"), "doc_id", "text", 5, 5)


def test_doubling_equals_stepping():
    r = random.Random(1)
    succ = np.array([min(99, i + r.randrange(1, 9)) for i in range(100)])
    want, at = [0], 0
    while at != 99:
        at = int(succ[at])
        want.append(at)
    assert doubled(np.array([0]), succ).tolist() == want


@pytest.mark.parametrize("mixed", [True, False])
def test_pack(spark, mixed):
    r = random.Random(2)
    sizes = [r.choice([0, 1, 3, 7, 7, 7, 40, 51, 99, 100, 101, 250, 300]) for _ in range(500)] + [7] * 300
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(None, 5, "x"), (0, 1, "x"), (5000, None, "x")], "doc_id int, n long, container string")
    out = pack(df, "doc_id", "n", 100, mixed).collect()
    fill, pieces = collections.Counter(), collections.defaultdict(list)
    for x in out:
        fill[x["container"]] += x["size"]
        pieces[x["doc_id"]].append(x["size"])
    assert max(fill.values()) <= 100 and len({(x["container"]) for x in out}) == max(fill) + 1
    for i, s in enumerate(sizes):
        if i:
            assert sum(pieces[i]) == s and (len(pieces[i]) == max(1, -(-s // 100)))
    assert sum(pieces[None]) == 5 and sum(pieces[5000]) == 0
    assert pack(df.limit(0), "doc_id", "n", 100, mixed).count() == 0


def test_plan_counts_everything_once():
    counts = {30: 10, 70: 4, 55: 3, 0: 9, 1: 5}
    for mixed in (True, False):
        done = collections.Counter()
        for template, times in plan(counts, 100, mixed):
            assert sum(s * m for s, m in template.items()) <= 100
            for s, m in template.items():
                done[s] += m * times
        assert done == {30: 10, 70: 4, 55: 3, 1: 14}


def plain_words(t):
    t = re.sub(r"<[^<>]{0,40}>", " ", t or "")
    t = re.sub(r"&[a-z]{2,6};", " ", t)
    t = "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c))
    return re.findall(r"[^\W_]+", t)


def test_leaks_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"wörd{i}" for i in range(60)]
    items = [" ".join(r.choices(vocabulary, k=r.randrange(5, 40))) for _ in range(25)]
    docs = []
    for _ in range(120):
        some, a = r.choice(items).split(), r.randrange(10)
        part = some[a : a + r.randrange(4, 40)]
        text = " ".join([*r.choices(vocabulary, k=9), *part, *r.choices(vocabulary, k=9)])
        docs.append(r.choice([text, text.upper(), text.replace("ö", "o"), text.replace(" ", " <b class='x'>", 3), unicodedata.normalize("NFD", text), text.replace(" ", "&nbsp;", 2)]))
    docs += [None, "", "x", items[7] * 1, "z " * 70_000 + items[8]]
    ddf = spark.createDataFrame([(i, t, "a") for i, t in enumerate(docs)], "doc_id long, text string, item string")
    idf = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)] + [("n", None), (None, items[0]), ("i0", items[0])], "item_id string, text string")
    want = set()
    for d, t in enumerate(docs):
        w = plain_words(t)
        windows = {tuple(w[k : k + RUN]) for k in range(len(w) - RUN + 1)}
        for i, it in enumerate(items):
            v, cover = plain_words(it), set()
            for q in range(len(v) - RUN + 1):
                if tuple(v[q : q + RUN]) in windows:
                    cover |= set(range(q, q + RUN))
            if cover and len(cover) * 5 >= len(v) * 2:
                want.add((d, f"i{i}", len(cover)))
    assert len(want) > 30
    assert {tuple(x) for x in leaks(ddf, "doc_id", "text", idf, "item_id", "text").collect()} == want
    assert leaks(ddf.limit(0), "doc_id", "text", idf, "item_id", "text").count() == 0
    assert leaks(ddf, "doc_id", "text", idf.limit(0), "item_id", "text").count() == 0


def test_simhash_of_equal_windows():
    h, _ = words(["a b c d e f g h", "h g f e d c b a"])
    assert simhashes(h[:8])[0] == simhashes(h[8:])[0]


def test_near_fingerprints_against_brute_force():
    """All fingerprints within a radius that is more than equality, and no others."""
    r = np.random.default_rng(3)
    index = Index.of_texts([" ".join(f"w{r.integers(500)}" for _ in range(40)) for _ in range(30)])
    sim = np.repeat(index.simhash, 6)
    for flips in range(6):
        for i in range(flips, len(sim), 6):
            for bit in r.choice(64, flips, replace=False):
                sim[i] ^= np.uint64(1) << np.uint64(bit)
    got = set(zip(*(x.tolist() for x in index.near(sim))))
    want = {(i, j) for i, s in enumerate(sim) for j in np.flatnonzero(np.bitwise_count(index.simhash ^ s) <= RADIUS).tolist()}
    assert got == want and RADIUS > 1 and all((i, i // 6) in got for i in range(len(sim)) if i % 6 <= 3)


def test_weighted_shingles_decide_proposed_pairs():
    """Reordered words have the same fingerprint and propose the item; the shingles of the whole item decide."""
    item = [f"w{i}" for i in range(20)]
    texts = [" ".join(item[8:4:-1] + item[4:0:-1]), " ".join(item[:8] + ["x"] + item[9:19]), " ".join(item), "no such words " * 9]
    index = Index.of_texts([" ".join(item), "short item"])
    hashes, bounds = words(texts, accents=False)
    pairs = index.proposed(hashes, bounds)
    assert pairs.tolist() == [0, 2, 4]  # text * items + item
    keys, weight = index.contained(hashes, bounds, pairs)
    assert keys.tolist() == [2, 4] and weight.tolist() == [18, 20]
    assert len(index.contained(hashes, bounds, pairs[:0])[0]) == 0


def bag(t):
    return collections.Counter(re.findall(r"[^\W_]+", (t or "").lower()))


def test_overlaps_against_brute_force(spark):
    r = random.Random(9)
    rows = []
    for k in range(60):
        base = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 2, 6, 30, 80]))]
        for _ in range(r.randrange(1, 4)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 6)):
                w[r.randrange(len(w))] = f"x{r.randrange(3000)}"
            if r.random() < 0.2:
                r.shuffle(w)
            rows.append((r.choice(["p", "q"]), f"k{len(rows)}", r.choice([" ", ", "]).join(w).title(), r.choice(["train", "validation", "test", None]), r.choice(["s1", None]), 1))
    rows += [("p", "n1", None, "train", "s1", 1), ("p", "n2", " ", "test", "s1", 1), ("p", "n3", "!!", "test", "s1", 1), ("p", None, "w1", "test", "s1", 1)]
    rows += [("p", "h1", "hot text here", "train", "s", 1), ("p", "h2", "Hot text, here!", "test", "s", 1), ("p", "h2", "Hot text, here!", "test", "s", 1), ("p", "h1", "hot text here", "test", "s", 1)]
    df = spark.createDataFrame(rows, "kind string, key string, text string, split string, source string, n int")
    want, near = set(), 0
    for a in rows:
        for b in rows:
            if a[0] == b[0] and a[3] in ("validation", "test") and b[3] == "train" and a[1] and b[1] and a[1] != b[1]:
                x, y = bag(a[2]), bag(b[2])
                if x and y and (x & y).total() * 5 >= 4 * max(x.total(), y.total()):
                    want.add(tuple(sorted((a[1], b[1]))))
                    near += a[2].lower() != b[2].lower()
    members, links = overlaps(df)
    assert {tuple(x) for x in record_pairs(members, links).collect()} == want and near > 5
    assert sum(x["records"] for x in report(members, links).collect()) == sum(x[3] in ("validation", "test") and bool(bag(x[2])) and x[1] is not None for x in rows)
    assert overlaps(df.limit(0))[1].count() == 0


def test_shared_words_counts_repetition():
    assert shared_words(["a a b", "a a a a b"], ["b a a", "a a a b b"]).tolist() == [3, 0]
