import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import rankers as rk

DIM = 12


def rows(spark, queries=60, seed=1):
    """Candidates of which one a query is right: the one with the largest first feature."""
    r = np.random.default_rng(seed)
    out = []
    for q in range(queries):
        n = int(r.integers(2, 9))
        x = r.standard_normal((n, DIM)).round(3)
        x[:, DIM - rk.NUMBERS + rk.SCORE_AT] = r.random(n).round(3)
        for i in range(n):
            out.append((f"q{q:03d}", f"c{i}", i + 1, [float(v) for v in x[i]], float(i == x[:, 0].argmax()), "validation" if q % 4 == 0 else "train"))
    return spark.createDataFrame(out, "query_id string, candidate_id string, rank int, features array<double>, label double, side string")


@pytest.mark.parametrize("kind", ["mlp", "set_transformer"])
@pytest.mark.parametrize("loss", ["listwise", "pointwise"])
def test_gradients(kind, loss):
    m = rk.Ranker(9, kind, hidden=8, heads=2, layers=2, feedforward=12, dropout=0.0)
    r = np.random.default_rng(3)
    m.p = {k: (v + 0.1 * r.standard_normal(v.shape)).astype(np.float64) for k, v in m.p.items()}
    x, mask = r.standard_normal((3, 5, 9)), np.array([[1, 1, 1, 1, 1], [1, 1, 1, 0, 0], [1, 1, 0, 0, 0]], bool)
    y = np.array([[0, 1, 0, 1, 0], [1, 0, 0, 0, 0], [0, 0, 0, 0, 0.0]])
    value = lambda: rk.LOSSES[loss](m.run(x, mask)[0], y, mask)
    _, d = value()
    grads = m.run(x, mask)[2](d)
    for name, p in m.p.items():
        at = tuple(int(r.integers(0, n)) for n in p.shape)
        p[at] += 1e-4
        up = value()[0]
        p[at] -= 2e-4
        down = value()[0]
        p[at] += 1e-4
        assert grads[name][at] == pytest.approx((up - down) / 2e-4, abs=2e-4), name


def test_erf():
    import math

    x = np.linspace(-5, 5, 1001)
    assert np.abs(rk.erf(x) - np.array([math.erf(v) for v in x])).max() < 2e-7


def test_dataset_is_padded_and_counted(spark, tmp_path):
    df = rows(spark, 20)
    m = rk.prepare(df, str(tmp_path / "d"), k=4, dtype="float32")
    sizes = {r["query_id"]: r["count"] for r in df.groupBy("query_id").count().collect()}
    assert m["statistics"] == {"queries": 20, "without_positive": m["statistics"]["without_positive"], "truncated": sum(n > 4 for n in sizes.values())}
    assert m["splits"] == {"train": 15, "validation": 5} and m["feature_dim"] == DIM and m["candidate_k"] == 4
    batch = rk.dataset(spark, str(tmp_path / "d"), "train").orderBy("query_id").toArrow().combine_chunks().to_batches()[0]
    x, y, mask = rk.padded(batch, 4, "float32", DIM)
    assert x.shape == (15, 4, DIM) and mask.sum() == sum(min(4, n) for q, n in sizes.items() if int(q[1:]) % 4) and not x[~mask].any() and not y[~mask].any()
    want = [r["features"] for r in df.where("query_id = 'q001' and rank <= 4").orderBy("rank").collect()]
    assert np.allclose(x[0, : len(want)], want, atol=1e-6)
    for bad in (dict(dtype="int8"), dict(sides=("train",))):
        with pytest.raises(ValueError):
            rk.prepare(df, str(tmp_path / "e"), **bad)
    with pytest.raises(ValueError):
        rk.dataset(spark, str(tmp_path / "d"), "test")
    with pytest.raises(FileNotFoundError):
        rk.load_manifest(spark, str(tmp_path / "none"))


def test_untrained_mlp_keeps_the_order(spark, tmp_path):
    rk.prepare(rows(spark, 12), str(tmp_path / "d"), k=10, dtype="float32")
    got = rk.rank_dataset(spark, str(tmp_path / "d"), "train", rk.Ranker(DIM, "mlp"), 20).join(rows(spark, 12), ["query_id", "candidate_id"]).collect()
    assert got and all(r["neural_score"] == pytest.approx(r["features"][DIM - rk.NUMBERS + rk.SCORE_AT], abs=1e-6) and len(r["representation"]) == 16 for r in got)


@pytest.mark.parametrize("kind,workers", [("mlp", 1), ("set_transformer", 2)])
def test_training_learns_saves_and_goes_on(spark, tmp_path, kind, workers):
    path, folder = str(tmp_path / "d"), str(tmp_path / "run")
    rk.prepare(rows(spark, 160), path, k=8)
    model = rk.Ranker(DIM, kind, hidden=16, heads=2, layers=1, feedforward=32, dropout=0.0)
    options = dict(batch=16, rate=5e-3, workers=workers)
    rk.train(spark, path, folder, model, epochs=3, **options)
    out = rk.train(spark, path, folder, model, epochs=6, **options)
    assert out["last_epoch"] == 6
    log = rk.read_checkpoint(spark, f"{folder}/last")["log"]
    assert [e["epoch"] for e in log] == [1, 2, 3, 4, 5, 6] and log[-1]["train_loss"] < log[0]["train_loss"]
    whole = rk.train(spark, path, str(tmp_path / "once"), model, epochs=6, **options)
    assert whole["best_ndcg@10"] == pytest.approx(out["best_ndcg@10"], abs=1e-6)  # cut off or not
    best = rk.load_ranker(spark, folder)
    firsts = rk.rank_dataset(spark, path, "validation", best, 1).join(rows(spark, 160), ["query_id", "candidate_id"])
    assert firsts.agg(F.avg("label")).first()[0] > 0.6
    with pytest.raises(ValueError):
        rk.train(spark, path, folder, model, epochs=9, batch=8, rate=5e-3, workers=workers)
    with pytest.raises(FileNotFoundError):
        rk.load_ranker(spark, str(tmp_path / "nothing"))


def test_metrics():
    s, y, mask = np.array([[3.0, 2, 1, 9], [1, 2, 3, 4]]), np.array([[0, 1.0, 0, 0], [0, 0, 0, 0]]), np.array([[1, 1, 1, 0], [1, 1, 1, 1]], bool)
    got = rk.metrics(s, y, mask)
    assert got["MRR"].tolist() == [0.5] and got["Recall@5"].tolist() == [1.0] and got["NDCG@10"].tolist() == [pytest.approx(1 / np.log2(3))]
