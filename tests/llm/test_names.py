from itertools import combinations, product

import pytest

from fathomline.llm.names import LESS_A, LESS_B, STRONG, Lexicon, candidate_pairs, clusters, compare, deletes, edits, parse, variants

SAME = [
    ("Nathaniel Getonvufu", "GETONVUFU Natthaniel"),
    ("Nathaniel Getonvufu", "Getonvufu, Nathaniel, M.A."),
    ("Frederick Nigazoder", "Fred Niga'zoder"),
    ("Yusuf Dontunmége", "Yusuf E. Dontunmege"),
    ("Edward Menlisekin", "Menlisekin, Ed"),
    ("Penelope Vezisige", "Penelope Vezi sige"),
    ("Tunbugoza Railway Association", "Tunbugpza Rwy. Assoc."),
    ("University of Denbelesi", "Univeersity of Denbelesi"),
    ("Gevonbunvan Lodge No. 11", "Lodge 11 of Gevonbunvan"),
    ("Werabarten and Sons Mining Company Limited", "Werabarten & Sons Mining Co. Ltd."),
    ("Banfibunen Institute of Horology", "The Horology Institute, Banfibunne"),
]
OTHER = [
    ("Nathaniel Getonvufu", "Francesca Getonvufu"),
    ("Ingrid Theodore Gowatanmu", "Harold Theodore Gowatanmu"),
    ("Gevonbunvan Lodge No. 11", "Gevonbunvan Lodge No. 37"),
    ("National Astronomy Laboratory of Zafotofi", "National Mycology Laboratory of Zafotofi"),
    ("International Society for Mycology Federbunti", "International Society for Mycology Bunvetandon"),
    ("Mireille R. Kubrumanbre", "Mireille Rebirzumin"),
    ("Frederick Frederick Monderzevo", "Frederick Frederick Meburtunna"),
    ("Francesca Zegubribon", "Giuseppe Francesca Zegubribon"),
]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert compare(a, b) == compare(b, a) == STRONG


@pytest.mark.parametrize("a,b", OTHER)
def test_other(a, b):
    assert compare(a, b) is None and compare(b, a) is None


def test_names_that_say_less():
    assert compare("H. T. Gowatanmu", "Harold Theodore Gowatanmu") == LESS_A
    assert compare("Harold Theodore Gowatanmu", "H. T. Gowatanmu") == LESS_B
    assert compare("I.S.S. Kanmewika", "International Society for Seismology Kanmewika") == LESS_A


def test_edits_and_deletes():
    assert edits("abcd", "abdc") == 1 and edits("abcd", "abcd") == 0 and edits("abcd", "xyzw") == 3
    assert deletes("abc", 1) == {"abc", "bc", "ac", "ab"}
    # Any two words within one edit share a key.
    for w in ("getonvfu", "getonvuffu", "getonvuuf", "getonvuxu"):
        assert deletes("getonvufu", 1) & deletes(w, 1)


def test_parse():
    assert parse("Dr. Yusuf Dontunmége [ed.]").words == ("yusuf", "dontunmege")
    assert parse("Gevonbunvan Ldg. 11").numbers == ("11",)


def test_variants(spark):
    names = ["Nathaniel Getonvufu", "N. Getonvufu", "Getonvufu, Nathaniel", "Francesca Pevefivin", "Frederick Pevefivin", "F. Pevefivin", "Lake Getonvufu", None, "", "Noor"]
    rows = [(f"e{i}", n, "person" if i != 6 else "location", 1) for i, n in enumerate(names)] + [(None, "Nathaniel Getonvufu", None, 1), ("e0", "Nathaniel Getonvufu", None, 1)]
    df = spark.createDataFrame(rows, "entity_id string, name string, entity_type string, id int")
    found = {r["entity_id"]: r["cluster"] for r in variants(df, "entity_id", "name", "entity_type", ("person", "organisation"), ("location", "work")).collect()}
    assert found == {"e0": "e0", "e1": "e0", "e2": "e0"}  # "F." may be either of two, so it joins neither
    assert variants(df.limit(0), "entity_id", "name", "entity_type", ("person",), ("work",)).count() == 0


def test_index_misses_no_link(spark):
    """Every link of a comparison of all names is among the candidates, however common the words."""
    first = ["Nathaniel", "Natthaniel", "Nat", "N.", "Francesca", "Cesca", "Frederick", "Fred", "Nathaniel A.", "Nathaniel Adam"]
    names = [f"{f} {s}" for s in ("Getonvufu", "Getonvuffu", "Pevefivin", "Geton vufu", "Noor") for f in first]
    names += [n for pair in SAME + OTHER for n in pair]
    names += ["Zolubondu Lodge No. 37", "Zolubondu Ldg. 37", "Lodge 39 of Zolubondu", "Zolubondu Lodge Nr 39", "I.S.S. Kanmewika", "International Society for Seismology Kanmewika", "ISS Kanmewika", "Lodge 7", "Lodge No. 7"]
    names = sorted(set(names))
    got = {frozenset(r) for r in candidate_pairs(spark.createDataFrame([(x, x) for x in names], "id string, name string")).collect()}
    links = {frozenset(p) for p in combinations(names, 2) if compare(*p)}
    assert len(links) > 100 and links <= got


@pytest.mark.parametrize("bearers", [10, 70, 3000])
def test_bearers_of_a_name_change_nothing(spark, bearers):
    few = ["Theo Getonvufu", "Theo Getonvufo", "Nat Getonvufu", "Nathaniel Getonvufu"]
    given = ["".join(c) for c in product("bdfgkpsvwz", "aeiou", "lmnrt", "aeiou", "bd", "ou")]
    names = few + [f"{g} Getonvufu" for g in given[:bearers]]
    df = spark.createDataFrame([(x, x, "person") for x in names], "entity_id string, name string, entity_type string")
    found = {r["entity_id"]: r["cluster"] for r in variants(df, "entity_id", "name", "entity_type", ("person",), ("work",)).collect()}
    assert found["Theo Getonvufu"] == found["Theo Getonvufo"] != found["Nat Getonvufu"] == found["Nathaniel Getonvufu"]


def test_same_words_and_long_names(spark):
    """Names of the same words are compared once, whatever their number; very long names are linked to those only."""
    long = " ".join(f"word{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(99))
    rows = [(f"a{i}", "Nathaniel" + " " * (i + 1) + "Getonvufu", "person") for i in range(50)] + [("x", long, "work"), ("y", long.upper(), "person"), ("z", long + " more", "person"), ("w", long + ".", "person")]
    df = spark.createDataFrame(rows, "entity_id string, name string, entity_type string")
    found = {r["entity_id"]: r["cluster"] for r in variants(df, "entity_id", "name", "entity_type", ("person",), ("work",)).collect()}
    assert found == {**{f"a{i}": "a0" for i in range(50)}, "w": "w", "y": "w"}


def test_lexicon_is_a_parameter():
    other = Lexicon({"aloysius": "loisl wisl"})
    assert compare("Loisl Getonvufu", "Aloysius Getonvufu") is None and compare("Loisl Getonvufu", "Wisl Getonvufu", other) == STRONG
    assert compare("Nat Getonvufu", "Nathaniel Getonvufu") == STRONG


def test_common_tokens_stay_indexed(spark):
    """A common surname (or place) still meets its initials, typos and abbreviations."""
    given = ["".join(c) for c in product("bdfgk", "aeiou", "lmnrt", "aeiou")]
    for n in (60, 260):
        names = [f"{g} Mueller" for g in given[:n]] + [f"Johannes {g}sonvu" for g in given[:n]] + ["Johannes Mueller", "Johannes Muelller", "J. Mueller"]
        names += [f"Lodge {i} of Zolubondu" for i in range(100, 100 + n)] + ["Zolubondu Lodge 15", "Zolubondu Ldg. 15"]
        got = {frozenset(r) for r in candidate_pairs(spark.createDataFrame([(x, x) for x in names], "id string, name string")).collect()}
        for pair in (("J. Mueller", "Johannes Mueller"), ("Johannes Mueller", "Johannes Muelller"), ("Zolubondu Lodge 15", "Zolubondu Ldg. 15")):
            assert frozenset(pair) in got
        assert n < 200 or len(got) < 3 * n * n / 4  # three common words, none paired as a whole


def test_many_altered_words():
    """Six and more words that differ, by typos and abbreviations mixed, are assigned optimally."""
    full = "Internatiional Association Astronomical Laboratory Department Mycology Horologgy Zolubondu".split()
    other = "International Assoc Astronomical Lab Dept Mycollogy Horology Zolubonduu".split()
    assert compare(" ".join(full), " ".join(other)) == compare(" ".join(other), " ".join(full)) == STRONG


def test_long_abbreviation(spark):
    """Prefixes of six and seven letters, and words written as two, are shared features."""
    names = ["Zolubondu Metall", "Zolubondu Metallurgy", "Zolubondu Pharma O Neil", "Zolubondu Pharma ONeil"]
    got = {frozenset(r) for r in candidate_pairs(spark.createDataFrame([(x, x) for x in names], "id string, name string")).collect()}
    assert {frozenset(names[:2]), frozenset(names[2:])} <= got


def test_long_chain_of_weaker_names(spark):
    """Each name fits the full one and the name before it, so one joins a round."""
    links = [(1, 0, LESS_A), *((i, j, LESS_A) for i in range(2, 7) for j in (0, i - 1))]
    found = clusters(spark.createDataFrame(links, "a long, b long, link string"))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(7)}


SHORT_OR_SPLIT = [
    ("A. Stewakandar", "Alexander Stewakandar", LESS_A),
    ("Elizabeth A Nakunzafu", "Elizabeth Anna Nakunzafu", STRONG),
    ("Prof. A. Rudugito", "A. Rudugito", STRONG),
    ("Furegoba I.N.", "Furegoba Institute of Numismatics", LESS_A),
    ("Bob Lee", "Robert Lee", STRONG),
    ("J. Lee", "Jane Lee", LESS_A),
    ("Anna Webb", "Webb, Anne", STRONG),
    ("Bell Lab", "Bell Laboratories", STRONG),
    ("Noor Ali", "ALI Noor", STRONG),
    ("Plató", "Dr. Plato", STRONG),
    ("Vankezadon", "Vankezadonn", STRONG),
    ("Coca-Cola", "Coca Cola Co.", STRONG),
    ("IBM", "I.B.M. Corp.", STRONG),
    ("李明", "李明 (ed.)", STRONG),
    ("Pene lope Vezisige", "Vezi sige, Penelope", STRONG),
]


@pytest.mark.parametrize("a,b,link", SHORT_OR_SPLIT)
def test_short_and_split_names(a, b, link):
    assert compare(a, b) == link and compare(b, a) == {LESS_A: LESS_B, LESS_B: LESS_A}.get(link, link)


@pytest.mark.parametrize("a,b", [("Anna Lee", "Anna Kim"), ("Plato", "Plate"), ("Ben Noor Stobratinbor", "Noor Binvundenzo"), ("Dr.", "Prof."), ("A Company", "Trading Company"), ("Lee", "Jane Lee")])
def test_other_short_names(a, b):
    assert compare(a, b) is None and compare(b, a) is None


def test_index_misses_no_short_or_split_name(spark):
    given, family = ["Noor", "Bob", "Robert", "Rob", "Anna", "Anne", "A.", "Jo", "J. K.", "Penelope", "Pene lope", "Al"], ["Lee", "Li", "Webb", "Web", "Ali", "Kim", "Vezisige", "Vezi sige", "O Neil", "ONeil", "Vezisigge"]
    names = {f"{g} {f}" for g, f in product(given, family)} | {f"{f}, {g}" for g, f in product(given, family)} | {f"{g} Noor {f}" for g, f in product(given, family)}
    names |= {x for a, b, _ in SHORT_OR_SPLIT for x in (a, b)} | set(family) | {"Lab 7", "Lab No. 7", "7", "No. 7", "NASA", "N.A.S.A.", "J. K."}
    names = sorted(names)
    got = {frozenset(r) for r in candidate_pairs(spark.createDataFrame([(x, x) for x in names], "id string, name string")).collect()}
    links = {frozenset(p) for p in combinations(names, 2) if compare(*p)}
    assert len(links) > 1000 and links <= got


def test_short_names_are_clustered(spark):
    names = ["Bob Lee", "Robert Lee", "Lee, Robert", "Noor Kim", "I.B.M.", "IBM Corp.", "Plato", "PLATO", "Dr. Plato"]
    df = spark.createDataFrame([(f"e{i}", n, None if i == 2 else "person") for i, n in enumerate(names)], "entity_id string, name string, entity_type string")
    found = {r["entity_id"]: r["cluster"] for r in variants(df, "entity_id", "name", "entity_type", ("person", "organisation"), ("work",)).collect()}
    assert found == {"e0": "e0", "e1": "e0", "e2": "e0", "e4": "e4", "e5": "e4", "e6": "e6", "e7": "e6", "e8": "e6"}
