"""Neural rankers of a query's candidates that are trained, kept and applied on the cluster (numpy, no other library)."""

from __future__ import annotations

import base64
import io
import json
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import files
from ..plans.stage import width
from .semantic import top

#: Version of dataset manifests and checkpoints; others are not read.
VERSION = 1
#: Place of the fused score among the numeric features, which end a row of features.
SCORE_AT, NUMBERS = 2, 7
LOWEST = float(np.finfo(np.float32).min)
Back = Callable[[np.ndarray], np.ndarray]

# ---- Dataset ----------------------------------------------------------------------------------------------------------

_DATASET = "query_id string, side string, candidate_ids array<string>, labels array<float>, features binary"


def _pack(dtype: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = pa.concat_arrays([batch.column("rows")])
            ends, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
            x = flat.field("features").flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(len(flat), -1)
            ids, labels = (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat.field(c)) for c in ("candidate_id", "label"))
            packed = [x[i:j].tobytes() for i, j in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("side"), ids, labels, pa.array(packed, pa.binary())], names=["query_id", "side", "candidate_ids", "labels", "features"])

    return run


def prepare(rows: DataFrame, path: str, k: int = 100, dtype: str = "float16", sides: tuple[str, ...] = ("train", "validation"), per_file: int = 512) -> dict:
    """Write a ranker's dataset, one row a query, and its manifest, which is returned.

    rows: query_id, candidate_id, rank, features, label, side.  Only the first ``k`` candidates are kept; a query with
    fewer is padded, with a mask, when it is read (``padded``), so padding takes no room.  An unknown side is an error.
    """
    if dtype not in ("float16", "float32"):
        raise ValueError(f"unknown storage type: {dtype}")
    spark = rows.sparkSession
    odd = rows.where(~F.coalesce(F.col("side").isin(*sides), F.lit(False))).select("query_id", "side").head(1)
    if odd:
        raise ValueError(f"query {odd[0][0]} is of side {odd[0][1]}, not of {sorted(sides)}")
    size = rows.groupBy("query_id").agg(F.count("*").alias("n"))
    long = size.agg(F.count("*"), F.count_if(F.col("n") > k)).first()
    one = F.struct("rank", "candidate_id", F.col("label").cast("float").alias("label"), "features")
    held = rows.where(F.col("rank") <= k).groupBy("query_id").agg(F.first("side").alias("side"), F.array_sort(F.collect_list(one)).alias("rows"))  # at most k
    held.mapInArrow(_pack(dtype), _DATASET).write.mode("overwrite").partitionBy("side").option("maxRecordsPerFile", per_file).parquet(f"{path}/data")
    data = spark.read.schema(_DATASET).parquet(f"{path}/data")
    counts = {r["side"]: r["n"] for r in data.groupBy("side").agg(F.count("*").alias("n")).collect()}
    bare, width_ = data.agg(F.count_if(~F.exists("labels", lambda x: x > 0)), F.max(F.length("features") / F.size("candidate_ids"))).first()
    manifest = {
        "version": VERSION, "candidate_k": k, "feature_dim": int(width_ or 0) // np.dtype(dtype).itemsize, "storage_dtype": dtype, "splits": {s: counts.get(s, 0) for s in sides},
        "statistics": {"queries": long[0], "without_positive": bare, "truncated": long[1]},
    }
    files.write_json(spark, f"{path}/manifest.json", manifest)
    return manifest


def load_manifest(spark: SparkSession, path: str) -> dict:
    found = files.read_json(spark, f"{path}/manifest.json")
    if found is None:
        raise FileNotFoundError(f"no dataset in {path}")
    if found.get("version") != VERSION:
        raise ValueError(f"the dataset has version {found.get('version')}")
    return found


def dataset(spark: SparkSession, path: str, side: str) -> DataFrame:
    """Queries of one side; an unknown side, repeated queries or another count than the manifest's are errors."""
    manifest = load_manifest(spark, path)
    if side not in manifest["splits"]:
        raise ValueError(f"unknown split {side}; there are {sorted(manifest['splits'])}")
    data = spark.read.schema(_DATASET).parquet(f"{path}/data").where(F.col("side") == side)
    n, ids = data.agg(F.count("*"), F.count_distinct("query_id")).first()
    if n != manifest["splits"][side] or ids != n:
        raise ValueError(f"{n} queries with {ids} ids in {side}, {manifest['splits'][side]} expected")
    return data


def padded(batch: pa.RecordBatch, k: int, dtype: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features [B, k, dim], labels [B, k], mask [B, k]); what is not there is 0 and masked."""
    n = len(batch)
    x, y, mask = np.zeros((n, k, dim), np.float32), np.zeros((n, k), np.float32), np.zeros((n, k), bool)
    for i, (raw, labels) in enumerate(zip(batch.column("features"), batch.column("labels"))):
        some = np.frombuffer(raw.as_py(), dtype).reshape(-1, dim)
        x[i, : len(some)], y[i, : len(some)], mask[i, : len(some)] = some, labels.as_py(), True
    return x, y, mask


# ---- Parts of models: each gives its result and the way back -------------------------------------------------------


def erf(x: np.ndarray) -> np.ndarray:
    """Error function by a rational approximation (off by less than 2e-7)."""
    t = 1 / (1 + 0.3275911 * np.abs(x))
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    return np.sign(x) * (1 - poly * np.exp(-x * x))


class _Pass:
    """A forward pass: collects gradients of the parameters on the way back."""

    def __init__(self, p: dict[str, np.ndarray], rng: np.random.Generator | None, rate: float):
        self.p, self.rng, self.rate, self.grads = p, rng, rate, {}

    def _add(self, name: str, g: np.ndarray) -> None:
        self.grads[name] = self.grads[name] + g if name in self.grads else g

    def linear(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        w = self.p[f"{name}.w"]

        def back(d: np.ndarray) -> np.ndarray:
            flat = d.reshape(-1, d.shape[-1])
            self._add(f"{name}.w", x.reshape(-1, x.shape[-1]).T @ flat)
            self._add(f"{name}.b", flat.sum(0))
            return d @ w.T

        return x @ w + self.p[f"{name}.b"], back

    def norm(self, name: str, x: np.ndarray) -> tuple[np.ndarray, Back]:
        s = 1 / np.sqrt(x.var(-1, keepdims=True) + 1e-5)
        unit = (x - x.mean(-1, keepdims=True)) * s
        gain = self.p[f"{name}.g"]

        def back(d: np.ndarray) -> np.ndarray:
            over = tuple(range(d.ndim - 1))
            self._add(f"{name}.g", (d * unit).sum(over))
            self._add(f"{name}.c", d.sum(over))
            u = d * gain
            return s * (u - u.mean(-1, keepdims=True) - unit * (u * unit).mean(-1, keepdims=True))

        return unit * gain + self.p[f"{name}.c"], back

    def gelu(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        share = (0.5 * (1 + erf(x / 2**0.5))).astype(x.dtype)
        return x * share, lambda d: d * (share + x * np.exp(-0.5 * x * x) / (2 * math.pi) ** 0.5).astype(x.dtype)

    def relu(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        return np.maximum(x, 0), lambda d: d * (x > 0)

    def drop(self, x: np.ndarray) -> tuple[np.ndarray, Back]:
        if self.rng is None or not self.rate:
            return x, lambda d: d
        keep = ((self.rng.random(x.shape) >= self.rate) / (1 - self.rate)).astype(x.dtype)
        return x * keep, lambda d: d * keep

    def attention(self, name: str, x: np.ndarray, mask: np.ndarray, heads: int) -> tuple[np.ndarray, Back]:
        b, k, h = x.shape
        size = h // heads
        qkv, back_in = self.linear(f"{name}.in", x)
        q, key, v = (t.reshape(b, k, heads, size).transpose(0, 2, 1, 3) for t in np.split(qkv, 3, axis=-1))
        s = q @ key.transpose(0, 1, 3, 2) / size**0.5
        s = np.where(mask[:, None, None, :], s, LOWEST)
        a = np.exp(s - s.max(-1, keepdims=True))
        a = a / a.sum(-1, keepdims=True)
        dropped, back_drop = self.drop(a)
        out, back_out = self.linear(f"{name}.out", (dropped @ v).transpose(0, 2, 1, 3).reshape(b, k, h))

        def back(d: np.ndarray) -> np.ndarray:
            d = back_out(d).reshape(b, k, heads, size).transpose(0, 2, 1, 3)
            dv = dropped.transpose(0, 1, 3, 2) @ d
            da = back_drop(d @ v.transpose(0, 1, 3, 2))
            ds = a * (da - (da * a).sum(-1, keepdims=True)) / size**0.5
            parts = (ds @ key, ds.transpose(0, 1, 3, 2) @ q, dv)
            return back_in(np.concatenate([t.transpose(0, 2, 1, 3).reshape(b, k, h) for t in parts], axis=-1))

        return out, back


def _weights(r: np.random.Generator, a: int, b: int) -> np.ndarray:
    return (r.uniform(-1, 1, (a, b)) / a**0.5).astype(np.float32)


class Ranker:
    """Scores of all candidates of a query: ``set_transformer`` (they attend to one another) or ``mlp`` (each by itself).

    The untrained ``mlp`` has a head of zeros, so it keeps the order of the fused score.
    """

    def __init__(self, dim: int, kind: str = "set_transformer", hidden: int = 256, heads: int = 8, layers: int = 3, feedforward: int = 1024, dropout: float = 0.1, seed: int = 13):
        if kind not in ("mlp", "set_transformer"):
            raise ValueError(f"unknown model: {kind}")
        if kind == "set_transformer" and hidden % heads:
            raise ValueError("the hidden size must be a multiple of the number of heads")
        self.config = {"dim": dim, "kind": kind, "hidden": hidden, "heads": heads, "layers": layers, "feedforward": feedforward, "dropout": dropout, "seed": seed}
        r, self.p = np.random.default_rng(seed), {}

        def linear(name: str, a: int, b: int) -> None:
            self.p[f"{name}.w"], self.p[f"{name}.b"] = _weights(r, a, b), np.zeros(b, np.float32)

        def norm(name: str) -> None:
            self.p[f"{name}.g"], self.p[f"{name}.c"] = np.ones(hidden, np.float32), np.zeros(hidden, np.float32)

        linear("start", dim, hidden)
        if kind == "mlp":
            linear("middle", hidden, hidden)
        else:
            norm("start")
            for i in range(layers):
                linear(f"{i}.in", hidden, 3 * hidden), linear(f"{i}.out", hidden, hidden)
                linear(f"{i}.up", hidden, feedforward), linear(f"{i}.down", feedforward, hidden)
                norm(f"{i}.one"), norm(f"{i}.two")
            norm("end")
        linear("head", hidden, 1)
        if kind == "mlp":
            self.p["head.w"][:] = 0

    def run(self, x: np.ndarray, mask: np.ndarray, rng: np.random.Generator | None = None) -> tuple[np.ndarray, np.ndarray, Callable[[np.ndarray], dict]]:
        """(scores [B, K], representations [B, K, H], gradients of the parameters by those of the scores)."""
        t, backs, c = _Pass(self.p, rng, self.config["dropout"]), [], self.config

        def then(got: tuple[np.ndarray, Back]) -> np.ndarray:
            backs.append(got[1])
            return got[0]

        def beside(h: np.ndarray, *steps: Callable) -> np.ndarray:
            """h plus what the steps make of it."""
            inner, out = [], h
            for f in steps:
                out, b = f(out)
                inner.append(b)

            def back(d: np.ndarray) -> np.ndarray:
                e = d
                for b in reversed(inner):
                    e = b(e)
                return d + e

            backs.append(back)
            return h + out

        h = then(t.linear("start", x))
        if c["kind"] == "mlp":
            h = then(t.drop(then(t.relu(h))))
            h = then(t.relu(then(t.linear("middle", h))))
        else:
            h = then(t.norm("start", h))
            for i in range(c["layers"]):
                h = then(t.norm(f"{i}.one", beside(h, lambda z, i=i: t.attention(str(i), z, mask, c["heads"]), t.drop)))
                h = then(t.norm(f"{i}.two", beside(h, lambda z, i=i: t.linear(f"{i}.up", z), t.gelu, t.drop, lambda z, i=i: t.linear(f"{i}.down", z), t.drop)))
            h = then(t.norm("end", h))
        rep = h
        s = then(t.linear("head", h))[..., 0]
        if c["kind"] == "mlp":
            s = s + x[..., x.shape[-1] - NUMBERS + SCORE_AT]

        def gradients(d: np.ndarray) -> dict[str, np.ndarray]:
            e = np.where(mask, d, 0).astype(np.float32)[..., None]
            for b in reversed(backs):
                e = b(e)
            return t.grads

        return np.where(mask, s, LOWEST), rep, gradients


# ---- Losses and metrics ------------------------------------------------------------------------------------------------


def listwise(s: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Cross entropy of the scores' softmax against equal mass on the positives; queries without one don't count."""
    y = y * mask
    n = y.sum(1, keepdims=True)
    ok = n[:, 0] > 0
    e = np.exp(s - s.max(1, keepdims=True)) * mask
    p = e / np.maximum(e.sum(1, keepdims=True), 1e-30)
    target = y / np.maximum(n, 1)
    loss = -(target * np.log(np.maximum(p, 1e-30))).sum(1)
    count = max(1, ok.sum())
    return float(loss[ok].sum() / count), np.where(ok[:, None], p - target, 0) / count


def pointwise(s: np.ndarray, y: np.ndarray, mask: np.ndarray) -> tuple[float, np.ndarray]:
    """Binary cross entropy over all candidates, positives weighted by their rarity."""
    n, positives = mask.sum(), (y * mask).sum()
    w = (n - positives) / max(positives, 1.0)
    z = np.where(mask, s, 0)
    log1 = np.logaddexp(0, -np.abs(z))
    loss = (w * y * (np.maximum(-z, 0) + log1) + (1 - y) * (np.maximum(z, 0) + log1)) * mask
    p = 1 / (1 + np.exp(-z))
    return float(loss.sum() / max(n, 1)), ((1 - y) * p - w * y * (1 - p)) * mask / max(n, 1)


LOSSES = {"listwise": listwise, "pointwise": pointwise}


def metrics(s: np.ndarray, y: np.ndarray, mask: np.ndarray, ks: tuple[int, ...] = (5, 10)) -> dict[str, np.ndarray]:
    """Metrics of each query that has a positive among its candidates."""
    ok = (y * mask).sum(1) > 0
    order = np.argsort(-np.where(mask, s, -np.inf)[ok], axis=1, kind="stable")
    hits = np.take_along_axis((y * mask)[ok], order, 1) > 0
    n, gain = hits.sum(1), 1 / np.log2(np.arange(hits.shape[1]) + 2)
    out = {"MRR": 1 / (1 + hits.argmax(1))}
    for k in ks:
        ideal = np.cumsum(gain)[np.minimum(n, min(k, len(gain))) - 1]
        out |= {f"Recall@{k}": hits[:, :k].sum(1) / n, f"Hit@{k}": hits[:, :k].any(1).astype(float), f"NDCG@{k}": (hits[:, :k] * gain[:k]).sum(1) / ideal}
    return out


# ---- Training ------------------------------------------------------------------------------------------------------------


def _bytes(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _arrays(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw), allow_pickle=False) as f:
        return {k: f[k] for k in f.files}


class AdamW:
    def __init__(self, rate: float, decay: float, clip: float):
        self.rate, self.decay, self.clip, self.n = rate, decay, clip, 0
        self.m: dict[str, np.ndarray] = {}
        self.v: dict[str, np.ndarray] = {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        norm = math.sqrt(sum(float((x * x).sum()) for x in g.values()))
        scale = self.clip / norm if 0 < self.clip < norm else 1.0
        self.n += 1
        for k, x in g.items():
            x = x * scale
            self.m[k] = 0.9 * self.m.get(k, 0) + 0.1 * x
            self.v[k] = 0.999 * self.v.get(k, 0) + 0.001 * x * x
            m, v = self.m[k] / (1 - 0.9**self.n), self.v[k] / (1 - 0.999**self.n)
            p[k] = (p[k] * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


#: Numbers of a parameter in one row that is averaged.
CHUNK = 1 << 16


def _one_epoch(shared, config: dict, manifest: dict, options: dict, epoch: int):
    """A task's share of an epoch: it goes through its queries in batches, from the parameters that all began with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ranker(**config)
        state = _arrays(shared.value)
        model.p = {k[2:]: v for k, v in state.items() if k.startswith("p:")}
        adam = AdamW(options["rate"], options["decay"], options["clip"])
        adam.n = int(state.get("n", 0))
        adam.m, adam.v = ({k[2:]: v for k, v in state.items() if k.startswith(f"{c}:")} for c in "mv")
        loss_sum, updates, rng = 0.0, 0, None
        for batch in _shuffled(batches, options["batch"], options["seed"] * 1_000_003 + epoch):
            rng = rng or np.random.default_rng([options["seed"], epoch])
            x, y, mask = padded(batch, manifest["candidate_k"], manifest["storage_dtype"], manifest["feature_dim"])
            s, _, gradients = model.run(x, mask, rng)
            loss, d = LOSSES[options["loss"]](s, y, mask)
            adam.step(model.p, gradients(d))
            loss_sum, updates = loss_sum + loss, updates + 1
        if updates:
            out = {f"{c}:{k}": v for c, part in (("p", model.p), ("m", adam.m), ("v", adam.v)) for k, v in part.items()}
            for name, v in out.items():
                flat = np.asarray(v, np.float64).ravel()
                for a in range(0, len(flat), CHUNK):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([a]), pa.array([updates]), pa.array([0.0]), pa.array([(flat[a : a + CHUNK] * updates).tolist()], pa.list_(pa.float64()))], names=["name", "at", "n", "loss", "v"])
            yield pa.RecordBatch.from_arrays([pa.array([""]), pa.array([0]), pa.array([updates]), pa.array([loss_sum]), pa.array([[]], pa.list_(pa.float64()))], names=["name", "at", "n", "loss", "v"])

    return run


def _shuffled(batches: Iterator[pa.RecordBatch], size: int, seed: int, held: int = 8) -> Iterator[pa.RecordBatch]:
    """Batches of ``size`` rows, mixed within a buffer of ``held`` batches."""
    rng, rows = np.random.default_rng(seed), []

    def out(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal rows
        table = pa.Table.from_batches(rows).combine_chunks()
        table = table.take(pa.array(rng.permutation(len(table))))
        end = len(table) if last else len(table) // size * size
        for a in range(0, end, size):
            yield table.slice(a, size).combine_chunks().to_batches()[0]
        rows = [] if last else table.slice(end).to_batches()

    for b in batches:
        if b.num_rows:
            rows.append(b)
            if sum(x.num_rows for x in rows) >= size * held:
                yield from out(False)
    if rows:
        yield from out(True)


_STATE = "name string, at long, n long, loss double, v array<double>"


def _summed(group):
    import pandas as pd

    total = np.sum(np.stack([np.asarray(v) for v in group["v"]]), axis=0)
    return pd.DataFrame({"name": group["name"].iloc[:1], "at": group["at"].iloc[:1], "n": [group["n"].sum()], "loss": [group["loss"].sum()], "v": [total.tolist()]})


def _judge(shared, config: dict, manifest: dict, loss: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Ranker(**config)
        model.p = {k[2:]: v for k, v in _arrays(shared.value).items() if k.startswith("p:")}
        for batch in batches:
            if batch.num_rows:
                x, y, mask = padded(batch, manifest["candidate_k"], manifest["storage_dtype"], manifest["feature_dim"])
                s = model.run(x, mask)[0]
                found = {"loss": np.array([LOSSES[loss](s, y, mask)[0]])} | metrics(s, y, mask)
                yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array([float(v.sum()) for v in found.values()]), pa.array([len(v) for v in found.values()])], names=["metric", "total", "n"])

    return run


def train(spark: SparkSession, path: str, folder: str, model: Ranker, epochs: int = 100, batch: int = 256, rate: float = 1e-4, decay: float = 0.01, clip: float = 1.0, loss: str = "listwise", seed: int = 13, workers: int | None = None) -> dict:
    """Fit ``model`` to the dataset at ``path``; checkpoints (last, best by NDCG@10) and a log go to ``folder``.

    Each epoch is one job: every task runs AdamW over its share of the queries in batches, and the tasks' parameters
    and moments are averaged by their number of updates (with one worker it is plain mini-batch training).  What
    reaches the driver has the size of the model, whatever that of the data.  A run that was cut off goes on after its
    last checkpoint when it is called again with the same folder.
    """
    if loss not in LOSSES:
        raise ValueError(f"unknown loss: {loss}")
    manifest = load_manifest(spark, path)
    if manifest["feature_dim"] != model.config["dim"]:
        raise ValueError(f"features of {manifest['feature_dim']}, a model of {model.config['dim']}")
    options = {"batch": batch, "rate": rate, "decay": decay, "clip": clip, "loss": loss, "seed": seed}
    parts = workers or width(spark)
    fitting = dataset(spark, path, "train").repartition(parts, F.xxhash64("query_id"))
    held_out = dataset(spark, path, "validation")
    state = {f"p:{k}": v for k, v in model.p.items()} | {"n": np.array(0)}
    log, first, best = [], 1, -math.inf
    if (last := read_checkpoint(spark, f"{folder}/last")) is not None:
        if last["config"] != model.config or last["options"] != options:
            raise ValueError(f"{folder} holds a run of other options")
        state, log, first = last["state"], last["log"], last["epoch"] + 1
        best = max((e["validation"].get("NDCG@10", 0.0) for e in log), default=best)
    for epoch in range(first, epochs + 1):
        shared = spark.sparkContext.broadcast(_bytes(state))  # the size of the model
        rows = fitting.mapInArrow(_one_epoch(shared, model.config, manifest, options, epoch), _STATE).groupBy("name", "at").applyInPandas(_summed, _STATE).collect()
        updates = next((r["n"] for r in rows if r["name"] == ""), 0)
        loss_sum = next((r["loss"] for r in rows if r["name"] == ""), 0.0)
        new: dict[str, list] = {}
        for r in sorted((r for r in rows if r["name"]), key=lambda r: (r["name"], r["at"])):
            new.setdefault(r["name"], []).append(np.asarray(r["v"]) / r["n"])
        shapes = {f"{c}:{k}": v.shape for k, v in model.p.items() for c in "pmv"}
        state |= {k: np.concatenate(v).reshape(shapes[k]).astype(np.float32) for k, v in new.items()}
        state["n"] = np.array(int(state["n"]) + -(-updates // parts))
        shared.unpersist()
        shared = spark.sparkContext.broadcast(_bytes(state))
        judged = held_out.mapInArrow(_judge(shared, model.config, manifest, loss), "metric string, total double, n long").groupBy("metric").agg((F.sum("total") / F.sum("n")).alias("v")).collect()
        shared.unpersist()
        values = {r["metric"]: r["v"] for r in judged if r["v"] is not None}
        log.append({"epoch": epoch, "train_loss": loss_sum / max(1, updates), "updates": updates, "validation_loss": values.pop("loss", 0.0), "validation": values})
        made = {"version": VERSION, "epoch": epoch, "config": model.config, "options": options, "log": log, "state": state}
        write_checkpoint(spark, f"{folder}/last", made)
        if values.get("NDCG@10", 0.0) > best:
            best = values.get("NDCG@10", 0.0)
            write_checkpoint(spark, f"{folder}/best", made)
        files.write_text(spark, f"{folder}/training_log.jsonl", "".join(json.dumps(e, sort_keys=True) + "\n" for e in log))
    return {"best_ndcg@10": best, "last_epoch": epochs, "folder": folder, "updates": sum(e["updates"] for e in log)}


def write_checkpoint(spark: SparkSession, path: str, made: dict) -> None:
    files.write_json(spark, f"{path}.json", made | {"state": base64.b64encode(_bytes(made["state"])).decode()})


def read_checkpoint(spark: SparkSession, path: str) -> dict | None:
    found = files.read_json(spark, f"{path}.json")
    if found is None:
        return None
    if found.get("version") != VERSION:
        raise ValueError(f"the checkpoint has version {found.get('version')}")
    return found | {"state": _arrays(base64.b64decode(found["state"]))}


def load_ranker(spark: SparkSession, folder: str, name: str | None = None) -> Ranker:
    """A trained model: the named checkpoint, else the best one, else the last."""
    for n in [name] if name else ["best", "last"]:
        if (found := read_checkpoint(spark, f"{folder}/{n}")) is not None:
            model = Ranker(**found["config"])
            model.p = {k[2:]: v for k, v in found["state"].items() if k.startswith("p:")}
            return model
    raise FileNotFoundError(f"no checkpoint {name or ''} in {folder}")


# ---- Inference -------------------------------------------------------------------------------------------------------------

Interaction = Callable[[np.ndarray, np.ndarray], np.ndarray]


def no_interaction(features: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The place for a model of interactions between candidates: features in, features out."""
    return features


def rank_dataset(spark: SparkSession, path: str, side: str, model: Ranker, k: int = 20, representation: int = 16, interaction: Interaction = no_interaction) -> DataFrame:
    """(query_id, candidate_id, neural_score, representation, neural_rank) of the ``k`` best of every query of a side."""
    manifest = load_manifest(spark, path)
    if manifest["feature_dim"] != model.config["dim"]:
        raise ValueError(f"features of {manifest['feature_dim']}, a model of {model.config['dim']}")
    shared = spark.sparkContext.broadcast((model.config, model.p))  # the size of the model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Ranker(**shared.value[0])
        m.p = shared.value[1]
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                some = batch.slice(a, 64)
                x, _, mask = padded(some, manifest["candidate_k"], manifest["storage_dtype"], manifest["feature_dim"])
                s, rep, _ = m.run(interaction(x, mask), mask)
                counts = mask.sum(1)
                ids = [i for one in some.column("candidate_ids").to_pylist() for i in one]
                kept = rep[..., :representation][mask].astype(np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, kept.size + 1, kept.shape[1], dtype=np.int32)), pa.array(kept.ravel()))
                yield pa.RecordBatch.from_arrays([some.column("query_id").take(pa.array(np.repeat(np.arange(len(some)), counts))), pa.array(ids), pa.array(s[mask].astype(np.float64)), lists], names=["query_id", "candidate_id", "neural_score", "representation"])

    scored = dataset(spark, path, side).mapInArrow(run, "query_id string, candidate_id string, neural_score double, representation array<float>")
    return top(scored, k, "neural_score", rank="neural_rank")


def hash_side(query_id: Column, fraction: float, seed: int) -> Column:
    from ..functions.vectors import split_side

    if not 0 < fraction < 1:
        raise ValueError("the validation fraction must lie between 0 and 1")
    return split_side(seed, query_id, fraction)
