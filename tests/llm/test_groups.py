import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm.fuse import fused, fused_ranking, leaders
from fathomline.llm.ledger import Ledger, collapse, copies_of, read_payloads, record_key
from fathomline.llm.topn import LoserTree, _Block, merge_runs, top_n

W = {"s": 0.5, "g": 0.5}


def ranked_rows(seed, hot=400, groups=30):
    r = random.Random(seed)
    rows = [("hot", f"c{r.randrange(200):03d}", r.choice([None, float("nan"), 0.0, -0.0, round(r.random(), 1)]), round(r.random() * 9, 1)) for _ in range(hot)]
    rows += [(f"q{g}", f"c{r.randrange(20):03d}", round(r.random(), 1), r.choice([None, 0.0, r.random() * 100])) for g in range(groups) for _ in range(r.randrange(1, 9))]
    return rows + [(None, "c1", 0.5, 1.0), ("q0", None, 0.5, 1.0), ("none", "c1", None, None)]


def best(rows):
    out = {}
    for q, c, s, _ in rows:
        if q is not None and c is not None and s is not None and not math.isnan(s):
            out[q, c] = max(out.get((q, c), -9), s)
    return out


@given(st.lists(st.lists(st.integers(0, 20)), max_size=9))
@settings(max_examples=60, deadline=None)
def test_loser_tree_merges(lists):
    sources = [sorted((x,) for x in v) for v in lists]
    at = [0] * len(sources)
    tree = LoserTree([v[0] if v else None for v in sources])
    out = []
    while (k := tree.keys[tree.top]) is not None:
        out.append(k[0])
        i = tree.top
        at[i] += 1
        tree.replace(sources[i][at[i]] if at[i] < len(sources[i]) else None)
    assert out == sorted(itertools.chain(*lists))


def blocks_of(runs, size):
    """Runs of (group, item, score), sorted, as blocks by their first keys."""
    key = lambda r: (r[0], -r[2], r[1])
    cut = [(i, key(some[0]), lambda some=some: _Block(*map(list, zip(*some)))) for i, run in enumerate(runs) for a in range(0, len(run), size) if (some := run[a : a + size])]
    return sorted(cut, key=lambda b: b[1])


def test_merge_seeks_next_group():
    a = [("a", f"i{k:02d}", 1.0) for k in range(50)] + [("b", "x", 0.5)]
    b = [("a", "i00", 2.0), ("c", "y", 1.0)]
    for size in (1, 3, 99):
        assert list(merge_runs(blocks_of([a, b], size), 2)) == [("a", "i00", 2.0), ("a", "i01", 1.0), ("b", "x", 0.5), ("c", "y", 1.0)]


@given(st.lists(st.lists(st.tuples(st.sampled_from("abcd"), st.sampled_from("uvwxyz"), st.sampled_from([0.0, 0.5, 1.0])), max_size=30), max_size=7), st.integers(1, 4), st.integers(1, 5))
@settings(max_examples=80, deadline=None)
def test_merge_of_blocks_equals_sorting(runs, size, n):
    """A block is loaded no sooner than the merge comes to it, and the result is that of sorting everything."""
    key = lambda r: (r[0], -r[2], r[1])
    want, seen = [], {}
    for g, i, s in sorted(itertools.chain(*runs), key=key):
        if i not in seen.setdefault(g, []) and len(seen[g]) < n:
            seen[g].append(i)
            want.append((g, i, s))
    assert list(merge_runs(blocks_of([sorted(r, key=key) for r in runs], size), n)) == want


def test_merge_holds_a_block_a_run():
    loaded, out = [], 0
    runs = [[(f"g{g:03d}", f"i{r}", 1.0) for g in range(200)] for r in range(4)]

    def counted(block):
        loaded.append(1)
        return block()

    for _ in merge_runs([(i, k, lambda b=b: counted(b)) for i, k, b in blocks_of(runs, 10)], 9):
        out += 1
        assert len(loaded) <= 4 * (out // 40 + 1)


@pytest.mark.parametrize("seed", [1, 2])
def test_top_n(spark, seed):
    rows = ranked_rows(seed)
    df = spark.createDataFrame([(*r, "x") for r in rows], "q string, c string, s double, g double, bucket string").repartition(7)
    want = set()
    by = {}
    for (q, c), s in best(rows).items():
        by.setdefault(q, []).append((-s, c))
    for q, v in by.items():
        want |= {(q, c, -s) for s, c in sorted(v)[:3]}
    got = [tuple(r) for r in top_n(df, "q", "c", "s", 3).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert top_n(df.limit(0), "q", "c", "s", 3).count() == 0


def test_fused_is_monotone_and_leaders_are_exact(spark):
    rows = ranked_rows(3)
    df = spark.createDataFrame([(*r, "x") for r in rows], "q string, c string, s double, g double, rank string")
    out = fused(df, "q", "c", W).collect()
    for a, b in itertools.product([r for r in out if r["q"] == "hot"], repeat=2):
        if None not in (a["s"], b["s"], a["g"], b["g"]) and a["s"] >= b["s"] and a["g"] >= b["g"]:
            assert a["fused"] >= b["fused"]
    want = set()
    for q in {r["q"] for r in out}:
        mine = [r for r in out if r["q"] == q]
        for r in mine:
            if r["s"] is not None and r["g"] is not None and all(sum(x[k] is not None and x[k] > r[k] for x in mine) < 5 for k in "sg"):
                want.add((q, r["c"]))
    assert {(r["q"], r["c"]) for r in leaders(df, "q", "c", W, 5).collect()} == want
    ranks = {}
    for r in fused_ranking(df, "q", "c", W).collect():
        ranks.setdefault(r["q"], []).append((r["rank"], round(math.log(max(-r["log_fused"], 1e-300)), 9), r["c"]))
    for v in ranks.values():
        v.sort()
        assert [x[0] for x in v] == list(range(1, len(v) + 1)) and [x[1:] for x in v] == sorted(x[1:] for x in v)
    assert fused(df.limit(0), "q", "c", W).count() == 0 and leaders(df.limit(0), "q", "c", W, 5).count() == 0
    with pytest.raises(ValueError):
        fused(df, "q", "c", {"s": -1.0})


def test_fused_neither_scale_decides(spark):
    rows = [("q", "both", 0.8, 800.0), ("q", "wide", 0.1, 1000.0), ("q", "narrow", 0.9, 1.0), ("q", "low", 0.1, 1.0)]
    out = {r["c"]: r["rank"] for r in fused_ranking(spark.createDataFrame(rows, "q string, c string, s double, g double"), "q", "c", W).collect()}
    assert out["both"] == 1 and out["low"] == 4


def test_long_tail_is_told_apart(spark):
    """Scores dozens and hundreds of scales above the median keep their order, whatever their ids."""
    rows = [("q", f"c{i:03d}", 0.5, float(i % 7)) for i in range(50)] + [("q", f"a{9 - i}", 0.5, 100.0 * (i + 1)) for i in range(9)]
    out = sorted(fused_ranking(spark.createDataFrame(rows, "q string, c string, s double, g double"), "q", "c", W).collect(), key=lambda r: r["rank"])
    assert [r["c"] for r in out[:9]] == [f"a{9 - i}" for i in reversed(range(9))]


RECORDS = [("r2", "The  Title", "Some text."), ("r1", "the title!", "SOME TEXT"), ("r3", "the title", "other"), ("r4", None, "x"), ("r5", " ", "x"), ("r6", "x", ""), ("r7", "t", "a" * 100_000), (None, "the title", "some text")]
RAW = [("r0", '{"text": "some\\n text", "title": "THE TITLE", "n": 1}'), ("r8", '{"title": "the title", "text": "oth'), ("r9", "[1]"), ("r10", None), ("r11", '{"title":"T","text":"' + "A" * 100_000 + '"}')]


def test_ledger(spark):
    known = spark.createDataFrame(RECORDS, "record_id string, title string, text string")
    raw = read_payloads(spark.createDataFrame(RAW, "record_id string, payload string"), "payload", ["record_id"], ["title", "text"])
    assert {r[0] for r in raw.collect()} == {"r0", "r11"}
    ledger, members = collapse([known, raw], "record_id", ["title", "text"])
    assert {(r["first_id"], r["copies"]) for r in ledger.collect()} == {("r0", 4), ("r3", 1), ("r11", 2)}
    assert {tuple(r) for r in copies_of(ledger, members, "record_id").collect()} == {("r0", "r1"), ("r0", "r2"), ("r11", "r7")}
    # Batches in any order, or all at once, make the same ledger.
    both = known.unionByName(raw)
    assert {tuple(r) for r in collapse([both], "record_id", ["title", "text"])[0].collect()} == {tuple(r) for r in collapse([raw, known.limit(0), known], "record_id", ["title", "text"])[0].collect()}


def test_ledger_goes_on_in_another_session(spark, tmp_path, monkeypatch):
    """A second run finds the first one's counts; a repeated batch changes nothing; buckets grow; only the batch moves."""
    from fathomline.llm import ledger as module

    where = str(tmp_path / "ledger")
    df = spark.createDataFrame([(f"r{i}", f"t{i}") for i in range(200)], "id string, t string").withColumn("key", record_key(F.col("t")))
    Ledger(spark, where).apply(df, "id", "monday")
    other = spark.newSession()
    again = Ledger(other, where)
    assert again.state["keys"] == 200 and again.state["buckets"] == module.BUCKETS
    again.apply(df, "id", "monday")
    monkeypatch.setattr(module, "BUCKET_KEYS", 10)
    late = other.createDataFrame([("r5", "t5"), ("a7", "T7"), ("new", "t999")], "id string, t string").withColumn("key", record_key(F.col("t")))
    again.apply(late, "id", "tuesday")
    last = Ledger(spark, where)
    assert last.state["buckets"] == 32 and last.state["applied"] == ["monday", "tuesday"]
    want = {f"r{i}": 1 + (i == 5) for i in range(200) if i != 7} | {"a7": 2, "new": 1}
    assert {r["first_id"]: r["copies"] for r in last.read().collect()} == want
    joined = late.groupBy("key").count().repartition(32, "key").hint("merge").join(last._table(), "key", "full_outer")
    assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # of the batch


def test_batches_of_two_runs_equal_one(spark, tmp_path):
    known = spark.createDataFrame(RECORDS, "record_id string, title string, text string")
    raw = read_payloads(spark.createDataFrame(RAW, "record_id string, payload string"), "payload", ["record_id"], ["title", "text"])
    for batch in (known, raw):
        ledger, _ = collapse([batch], "record_id", ["title", "text"], str(tmp_path / "l"))
    assert {tuple(r) for r in ledger.collect()} == {tuple(r) for r in collapse([known, raw], "record_id", ["title", "text"])[0].collect()}
