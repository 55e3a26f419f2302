import numpy as np

from fathomline.llm.neighbours import build, nearest, search


def made(seed=3, n=400, dim=16):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((40, dim))
    x = centres[r.integers(0, 40, n)] + 0.25 * r.standard_normal((n, dim))
    x *= r.uniform(0.5, 20, (n, 1))
    x[50:150] = x[50]  # a fourth of all rows share one vector
    return x.astype(np.float32)


def test_nearest_and_search(spark):
    x = made()
    rows = [(f"c{i:04d}", v.tolist(), "t") for i, v in enumerate(x)]
    odd = [("n1", None, "t"), ("n2", [0.0] * 16, "t"), ("n3", [1.0] * 15, "t"), ("n4", [float("nan")] + [1.0] * 15, "t"), (None, [1.0] * 16, "t"), ("n5", [None] + [1.0] * 15, "t"), rows[3]]
    df = spark.createDataFrame(rows + odd, "candidate_id string, embedding array<float>, item string")
    index = build(df, "candidate_id", "embedding")
    got = {}
    for r in nearest(index, 5, 0.8).collect():
        got.setdefault(r["item"], set()).add(r["other"])
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    s[50:150, 50:150] = 1.0
    np.fill_diagonal(s, -2)
    hit = total = 0
    for i in range(len(x)):
        order = np.lexsort((np.arange(len(x)), -np.round(s[i], 9)))[:5]
        want = {f"c{j:04d}" for j in order if s[i, j] >= 0.8}
        mine = got.get(f"c{i:04d}", set())
        assert len(mine) <= 5 and f"c{i:04d}" not in mine
        if 50 <= i < 150:  # equal vectors: the smallest other ids, exactly
            assert mine == want
        hit, total = hit + len(want & mine), total + len(want)
    assert hit >= 0.95 * total and not set(got) & {"n1", "n2", "n3", "n4", "n5"}
    asked = df.where("candidate_id in ('c0000', 'c0200', 'c0333')")
    found = search(index, asked, "candidate_id", "embedding", 5).collect()
    right = 0
    for i in (0, 200, 333):
        top = set(np.argsort(-s[i])[:5])
        right += len(top & {int(r["item"][1:]) for r in found if r["query"] == f"c{i:04d}"})
    assert right >= 13


def test_empty(spark):
    df = spark.createDataFrame([], "candidate_id string, embedding array<float>")
    index = build(df, "candidate_id", "embedding")
    assert nearest(index, 5, 0.8).count() == 0 and search(index, df, "candidate_id", "embedding", 5).count() == 0


def test_hot_group_of_near_copies(spark):
    """Many vectors around one direction, none equal; and more rescaled copies of a vector than a node has edges."""
    r = np.random.default_rng(5)
    one = r.standard_normal(64)
    near = (one / np.linalg.norm(one) + 0.03 * r.standard_normal((4000, 64))).astype(np.float32)
    scaled = (r.standard_normal(64).astype(np.float32) * (2.0 ** np.arange(-30, 30))[:, None]).astype(np.float32)
    rows = [(f"c{i:04d}", v.tolist()) for i, v in enumerate(near)] + [(f"s{i:02d}", v.tolist()) for i, v in enumerate(scaled)]
    got = {}
    for x in nearest(build(spark.createDataFrame(rows, "item string, vector array<float>"), "item", "vector"), 5, 0.8).collect():
        got.setdefault(x["item"], set()).add(x["other"])
    u = near.astype(float) / np.linalg.norm(near.astype(float), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argpartition(-s, 5, axis=1)[:, :5]
    hit = sum(len({f"c{j:04d}" for j in best[i]} & got[f"c{i:04d}"]) for i in range(len(near)))
    assert hit >= 0.97 * best.size
    for i in range(60):
        assert got[f"s{i:02d}"] == {f"s{j:02d}" for j in [j for j in range(6) if j != i][:5]}
