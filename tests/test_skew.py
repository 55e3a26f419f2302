import random

from pyspark.sql import functions as F

from fathomline.operators.accumulate import _add_blocks, distincts, heavy_keys, value_lists
from fathomline.plans.components import components
from fathomline.plans.skew import join_by_key, ranked


def hot_rows(seed=1):
    r = random.Random(seed)
    rows = [(r.choice(["hot", "hot", f"k{r.randrange(40)}", "warm"]), f"p{r.randrange(300)}", "x") for _ in range(3000)]
    return rows + [(None, "p1", "x"), ("k1", None, "x"), ("only", None, "x")]


def test_distincts(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "entity_id string, paragraph_id string, code string").repartition(5)
    want = {}
    for e, p, _ in rows:
        if e is not None and p is not None:
            want.setdefault(e, set()).add(p)
    found = distincts(df, "entity_id", "paragraph_id")
    counts = found.counts.collect()
    assert {r["entity_id"]: r["n_values"] for r in counts} == {e: len(p) for e, p in want.items()}
    assert sorted(r["code"] for r in counts) == list(range(len(want)))
    total = sum(map(len, want.values()))
    assert {r["entity_id"] for r in heavy_keys(df, "entity_id", "paragraph_id", 2).collect()} == {e for e, p in want.items() if len(p) * 50 >= total}
    lists = {}
    for r in value_lists(df, "entity_id", "paragraph_id", 7).collect():
        assert r["n_values"] == len(r["values"]) <= 7
        lists.setdefault(r["entity_id"], []).append((r["list_no"], r["values"]))
    assert {e: [p for _, v in sorted(x) for p in v] for e, x in lists.items()} == {e: sorted(p) for e, p in want.items()}


def test_distincts_of_nothing(spark):
    df = spark.createDataFrame([], "entity_id string, paragraph_id string")
    assert distincts(df, "entity_id", "paragraph_id").counts.count() == 0
    assert heavy_keys(df, "entity_id", "paragraph_id", 2).count() == 0
    assert value_lists(df, "entity_id", "paragraph_id").count() == 0


def test_blocks_are_added_in_steps(spark):
    rows = [(0, p, [p] + [1] * 1023) for p in range(150)] + [(3, 7, [2] * 1024)]
    out = {r["block"]: r["counts"] for r in _add_blocks(spark.createDataFrame(rows, "block long, part int, counts array<bigint>"), 150).collect()}
    assert out[0] == [sum(range(150))] + [150] * 1023 and out[3] == [2] * 1024


def test_ranked(spark):
    rows = hot_rows(2)
    df = spark.createDataFrame(rows, "g string, v string, _x string").repartition(6)
    out = {}
    for r in ranked(df, ["g"], [F.desc("v")], "rank").collect():
        out.setdefault(r["g"], []).append((r["rank"], r["v"]))
    for g, v in out.items():
        v.sort(key=lambda x: x[0])
        assert [x[0] for x in v] == list(range(1, len(v) + 1))
        assert [x[1] for x in v] == sorted((p for e, p, _ in rows if e == g), key=lambda p: p or "", reverse=True)
    assert ranked(df.limit(0), ["g"], [F.col("v")], "rank").count() == 0


def test_join_by_key(spark):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 500 + ["a", "b", None, "zz"])], "k string, i int")
    keys = spark.createDataFrame([("hot", 500, 1), ("a", 1, 2), ("b", 1, 3), (None, 1, 4)], "k string, n long, x int")
    out = join_by_key(rows, keys, "k", "n", 504).groupBy("k").agg(F.count("*").alias("c"), F.max("x").alias("x")).collect()
    assert {(r["k"], r["c"], r["x"]) for r in out} == {("hot", 500, 1), ("a", 1, 2), ("b", 1, 3)}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(1000, 1060)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in parent}
