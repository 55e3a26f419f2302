"""Stages with manifests: corpus, vectors, graph, retrieval, ranker dataset, training, re-ranking, evaluation."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import split_side
from ..operators import embedders, features, metrics, rankers, rerank  # noqa: F401  (embedders registers itself)
from ..operators.expand import Expansion
from ..operators.pool import evidence, graph_features, retrieval_stats
from ..operators.seeds import SeedRules
from ..sources import protocol, sinks
from ..sources.derived import Inputs
from ..sources.resume import shard
from . import datasets, files  # noqa: F401  (datasets registers itself)
from .registry import DATASETS, EMBEDDERS, GRAPHS, STORES
from .retrieve import Retrieval, retrieve

#: Version of the manifests; others are not read.
VERSION = 2
STAGES = ["corpus", "vectors", "graph", "retrieval", "neural", "llm", "evaluate"]


@dataclass
class Config:
    """What a run reads (``inputs``: a folder of Parquet tables, or ``source``: a dataset by name), where it writes, and
    its options."""

    root: str
    inputs: str = ""
    source: dict = field(default_factory=dict)
    dataset: str = "default"
    experiment: str = "default"
    embedding: dict = field(default_factory=dict)
    graph: dict = field(default_factory=dict)
    retrieval: dict = field(default_factory=dict)
    expansion: dict = field(default_factory=dict)
    seeds: dict = field(default_factory=dict)
    shards: int = 1
    neural_k: int = 20
    representation: int = 16
    llm_k: int = 10
    model: dict | str = "mlp"
    training: dict = field(default_factory=dict)
    ranker_dataset: dict = field(default_factory=dict)
    split: dict = field(default_factory=lambda: {"seed": 13, "fraction": 0.1})
    ks: list = field(default_factory=lambda: [5, 10])
    stage_ks: dict = field(default_factory=dict)
    limit: int | None = None

    @staticmethod
    def load(path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            values = yaml.safe_load(f)
        if not isinstance(values, dict):
            raise ValueError("a configuration is a mapping")
        return Config(**values)

    def folder(self) -> str:
        return "/".join([self.root.rstrip("/"), self.dataset, self.experiment])

    def options(self) -> Retrieval:
        return Retrieval(**({"semantic_k": 500, "top_k": 100} | self.retrieval), seeds=SeedRules.of(**({"semantic_k": 20} | self.seeds)), expansion=Expansion(**self.expansion))

    def model_options(self) -> dict:
        return {"kind": self.model} if isinstance(self.model, str) else dict(self.model)

    def signature(self, stage: str, inputs: list[str], split: str | None = None) -> str:
        values = {k: v for k, v in self.__dict__.items() if k not in ("root", "ks", "stage_ks")}
        return hashlib.sha256(json.dumps([VERSION, stage, split, values, sorted(inputs)], sort_keys=True).encode()).hexdigest()


class Pipeline:
    """Runs stages; a stage whose manifest has the same signature is reused, one of another signature is an error
    unless it is forced: results of different options never mix.

    ``split``: neural and llm may run on one side of the queries; that of validation is written under the stage's own
    name, another under ``stage.split``.
    """

    def __init__(self, spark: SparkSession, config: Config, provider: rerank.Provider = rerank.passthrough, provider_name: str = "passthrough"):
        self.spark, self.config, self.provider, self.provider_name = spark, config, provider, provider_name
        source = dict(config.source) or {"name": "tables", "path": config.inputs}
        self.data = DATASETS.create(source.pop("name"), spark, **source)
        options = dict(config.embedding)
        self.embed = EMBEDDERS.create(options.pop("name", "hashing"), **options)
        self.store = STORES.create(config.graph.get("store", "parquet"), spark, self.path("graph"))
        self._held: dict[str, DataFrame] = {}

    def path(self, name: str) -> str:
        return f"{self.config.folder()}/{name}"

    def output(self, stage: str, split: str | None = None) -> str:
        return stage if split in (None, "validation") else f"{stage}.{split}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def _inputs(self) -> list[str]:
        """Name, size and time of change of every input file: another delivery has another signature."""
        return [f for p in self.data.inputs() for f in files.listing(self.spark, p)]

    def _done(self, stage: str, force: bool, split: str | None = None) -> bool:
        have = files.read_json(self.spark, self.path(f"{self.output(stage, split)}.manifest.json"))
        if have is None or force:
            return False
        if have.get("version") != VERSION:
            raise ValueError(f"{stage} has a manifest of version {have.get('version')}")
        if have["signature"] != self.config.signature(stage, self._inputs(), split):
            raise ValueError(f"{stage} was made with other options or inputs; force it to make it anew")
        return have.get("complete", False)

    def _finish(self, stage: str, split: str | None = None, **facts) -> None:
        files.write_json(self.spark, self.path(f"{self.output(stage, split)}.manifest.json"), {"signature": self.config.signature(stage, self._inputs(), split), "complete": True, "version": VERSION, **facts})

    def run(self, stage: str = "all", force: bool = False, split: str | None = None) -> dict:
        if stage != "all" and stage not in STAGES:
            raise ValueError(f"unknown stage: {stage}")
        out: dict = {}
        for name in STAGES if stage == "all" else [stage]:
            if name == "evaluate":
                out = self.evaluate(split)
            elif name in ("neural", "llm"):
                if not self._done(name, force, split):
                    getattr(self, name)(split)
            elif not self._done(name, force):
                if name == "retrieval":
                    self.retrieval(force)
                else:
                    getattr(self, name)()
        return out

    def audit(self) -> dict:
        """Counts of the dataset's protocol, written beside the stages; unexpected ones are errors."""
        if not hasattr(self.data, "audit"):
            raise ValueError("the dataset has no protocol to audit")
        report = self.data.audit()
        files.write_json(self.spark, self.path("audit.json"), report)
        return report

    def corpus(self) -> None:
        digest = sinks.write_corpus(self.data.corpus(), self.path("corpus"))
        n, bare = self.read("corpus").agg(F.count("*"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "")).first()
        self._finish("corpus", digest=digest, candidates=n, empty_texts=bare)

    def vectors(self) -> None:
        c = self.read("corpus")
        self.embed(c.select("candidate_id", F.concat_ws("\n", "title", "text").alias("t")), "candidate_id", "t").write.mode("overwrite").parquet(self.path("vectors"))
        n, least, most = self.read("vectors").agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
        if n != c.count() or least != most:
            raise ValueError("vectors and corpus don't agree")
        self._finish("vectors", count=n, dimension=most)

    def graph(self) -> None:
        name = self.config.graph.get("builder", "citations" if hasattr(self.data, "papers") else "knowledge")
        self._finish("graph", builder=name, **self.store.write(GRAPHS.create(name, self.data, self.read("corpus"))))

    def _queries(self) -> DataFrame:
        q = self.data.queries()
        if self.config.limit is not None:
            q = q.orderBy("query_id").limit(self.config.limit)
        if "split" in q.columns:
            return q.withColumnRenamed("split", "side")
        s = self.config.split
        return q.withColumn("side", split_side(s["seed"], F.col("query_id"), s["fraction"]))

    def _side(self, split: str | None) -> DataFrame:
        q = self._queries()
        return q if split is None else q.where(F.col("side") == split)

    def _found(self, q: DataFrame):
        qv = self.embed(q, "query_id", "text").join(q.select("query_id", "excluded", "allowed"), "query_id")
        i = Inputs(q, qv, self.read("corpus"), self.read("vectors"), self.store.open())
        named = q.select("query_id", F.posexplode("seeds").alias("pos", "candidate_id"))
        return retrieve(i, named, self.config.options())

    def retrieval(self, force: bool = False) -> None:
        """Ranked candidates, their paths, features and counts, shard by shard of the queries.

        A shard is complete when its own manifest is there: a run that was cut off does the rest.
        """
        began, n = time.time(), self.config.shards
        q = self._queries().withColumn("shard", shard(F.col("query_id"), n))
        signature = self.config.signature("retrieval", self._inputs())
        for k in range(n):
            mark = self.path(f"retrieval_shards/{k:05d}.json")
            have = None if force else files.read_json(self.spark, mark)
            if have is not None and have["signature"] == signature:
                continue
            part = q.where(F.col("shard") == k).drop("shard")
            f = self._found(part)
            at = lambda name: self.path(f"{name}/shard={k}")
            f.ranked.write.mode("overwrite").parquet(at("retrieval"))
            ranked = self.spark.read.parquet(at("retrieval"))
            f.paths(ranked).write.mode("overwrite").parquet(at("paths"))
            paths = self.spark.read.parquet(at("paths"))
            graph_features(ranked, paths).write.mode("overwrite").parquet(at("graph_features"))
            stats = retrieval_stats(f.pool, ranked, f.emitted, self.data.judgements().join(part.select("query_id"), "query_id", "left_semi")).first().asDict()
            files.write_json(self.spark, mark, {"signature": signature, "stats": stats})
        done = [files.read_json(self.spark, self.path(f"retrieval_shards/{k:05d}.json"))["stats"] for k in range(n)]
        total = sum(s["queries"] for s in done)
        means = {c: sum((s[c] or 0) * s["queries"] for s in done) / total if total else 0.0 for c in (done[0] if done else {}) if c.startswith("mean_")}
        self._finish("retrieval", queries=total, paths=sum(s["paths"] for s in done), seconds=round(time.time() - began, 3), **means)

    def split_of(self, stage: str, split: str) -> DataFrame:
        """A stage's rows of one side, checked and kept: a repeated or missing query is an error."""
        key = f"{stage}:{split}"
        if key not in self._held:
            ids = self._side(split).select("query_id", F.col("query_id").alias("seq"))
            self._held[key] = protocol.project(self.read(stage), ids).drop("seq")
        return self._held[key]

    def _rows(self, name: str) -> DataFrame:
        return self.read(name).drop("shard")

    def _features(self) -> DataFrame:
        q = self._queries()
        n = features.numeric(self._rows("retrieval"), self._rows("graph_features"))
        return features.full(n, self.embed(q, "query_id", "text"), self.read("vectors"), strict=True)

    def _dimension(self) -> int:
        return 4 * files.read_json(self.spark, self.path("vectors.manifest.json"))["dimension"] + len(features.NUMERIC)

    def ranker_dataset(self) -> dict:
        """Features, labels and masks of all queries by side, with a manifest."""
        options = {"k": self.config.options().top_k, **self.config.ranker_dataset}
        rows = features.labelled(self._features(), self.data.judgements()).join(self._queries().select("query_id", "side"), "query_id")
        sides = options.pop("sides", None) or sorted({"train", "validation"} | {r[0] for r in self._queries().select("side").distinct().collect()})
        out = rankers.prepare(rows, self.path("ranker_dataset"), sides=tuple(sides), **options)
        self._finish("ranker_dataset", **{k: v for k, v in out.items() if k != "version"})
        return out

    def ranker(self) -> rankers.Ranker:
        return rankers.Ranker(self._dimension(), **self.config.model_options())

    def fit(self) -> dict:
        """Train the configured model on the dataset; a run that was cut off goes on."""
        return rankers.train(self.spark, self.path("ranker_dataset"), self.path("checkpoints"), self.ranker(), **self.config.training)

    def neural(self, split: str | None = None) -> None:
        """Re-rank by the model: the trained one where there are checkpoints, else as it begins."""
        kind, used = self.config.model_options()["kind"], "untrained"
        to = self.path(self.output("neural", split))
        if kind == "linear":
            rows = self._features()
            labelled = features.labelled(rows, self.data.judgements())
            w = features.fit_listwise(labelled.join(self._side("train").select("query_id"), "query_id", "left_semi"))
            files.write_json(self.spark, self.path("linear.json"), {"weights": w.tolist()})
            if split is not None:
                rows = rows.join(self._side(split).select("query_id"), "query_id", "left_semi")
            out, used = features.score_points(rows, lambda x, s, w=w: (x @ w, x), self.config.neural_k), "linear.json"
        else:
            if files.read_json(self.spark, self.path("ranker_dataset/manifest.json")) is None:
                self.ranker_dataset()
            model = self.ranker()
            if files.names(self.spark, self.path("checkpoints")):
                model, used = rankers.load_ranker(self.spark, self.path("checkpoints"), self.config.model_options().get("checkpoint")), "checkpoints"
            sides = rankers.load_manifest(self.spark, self.path("ranker_dataset"))["splits"]
            if split is not None and split not in sides:
                raise ValueError(f"unknown split {split}; there are {sorted(sides)}")
            out = None
            for side in [split] if split is not None else [s for s, n in sides.items() if n]:
                one = rankers.rank_dataset(self.spark, self.path("ranker_dataset"), side, model, self.config.neural_k, self.config.representation)
                out = one if out is None else out.unionByName(one)
        out.write.mode("overwrite").parquet(to)
        self._finish("neural", split, model=kind, parameters=used)

    def llm(self, split: str | None = None) -> None:
        ranked = self.read(self.output("neural", split)).select("query_id", "candidate_id", F.col("neural_rank").alias("rank"))
        cache_path, schema = self.path("llm_cache"), f"cache_key string, {rerank.REPLY}"
        cache = self.spark.read.schema(schema).parquet(cache_path) if files.exists(self.spark, cache_path) else None
        asked = rerank.requests(ranked, self._side(split), self.read("corpus"), self.provider_name)
        rerank.replies(asked, self.provider, cache)[1].write.mode("append").parquet(cache_path)
        kept = self.spark.read.schema(schema).parquet(cache_path)  # a provider is asked once a request
        got, _ = rerank.replies(asked, self.provider, kept)
        rerank.merged(ranked, got, self.config.llm_k).write.mode("overwrite").parquet(self.path(self.output("llm", split)))
        self._finish("llm", split)

    def rankings(self, split: str | None = None) -> dict[str, DataFrame]:
        names = {"retrieval": "rank", "neural": "neural_rank", "llm": "llm_rank"}
        at = lambda s: s if s == "retrieval" else self.output(s, split)
        found = {s: (at(s) if files.exists(self.spark, self.path(f"{at(s)}.manifest.json")) else s, c) for s, c in names.items()}
        return {s: self.read(name).select("query_id", "candidate_id", F.col(c).alias("rank")) for s, (name, c) in found.items() if files.exists(self.spark, self.path(f"{name}.manifest.json"))}

    def evaluate(self, split: str | None = None, stage: str | None = None) -> dict:
        """Macro metrics of every stage that is there, or of one; stages must hold the same queries as the first one."""
        q = self._side(split)
        ranked = self.rankings(split)
        if stage is not None:
            ranked = {s: r for s, r in ranked.items() if s == stage}
        if not ranked:
            raise ValueError("nothing to evaluate")
        first = None
        for name, r in ranked.items():
            ids = r.join(q.select("query_id"), "query_id", "left_semi").select("query_id").distinct()
            if first is not None and (ids.join(first, "query_id", "left_anti").head(1) or first.join(ids, "query_id", "left_anti").head(1)):
                raise ValueError(f"{name} holds other queries than the stage before")
            first = ids
        rows = metrics.stages(q, ranked, self.data.judgements(), {"*": self.config.ks} | self.config.stage_ks).collect()  # stages x metrics
        out: dict = {}
        for r in rows:
            out.setdefault(r["stage"], {"queries": r["queries"]})[r["metric"]] = r["value"]
        files.write_json(self.spark, self.path("metrics.json" if split is None else f"metrics.{split}.json"), out)
        return out

    def export(self, stage: str, path: str, with_evidence: bool = False) -> None:
        """A stage's results as nested JSON lines, one query a line; on demand with texts, types and titles of evidence."""
        r = self.rankings()[stage]
        if with_evidence:
            corpus = self.read("corpus")
            r = r.join(evidence(r, self._rows("paths"), self.store.open().nodes, corpus), ["query_id", "candidate_id"]).join(corpus.select("candidate_id", "text"), "candidate_id", "left")
        sinks.nested_results(r, self._queries(), self.data.judgements(), stage).write.mode("overwrite").json(path)
