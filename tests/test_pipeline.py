import json

import pytest

import __spark_entry__ as entry
from compare import same
from fathomline import catalog
from fathomline.cli import main
from fathomline.operators.expand import Expansion
from fathomline.plans import files
from fathomline.plans.pipeline import Config, Pipeline
from fathomline.plans.retrieve import Retrieval
from fathomline.sources import readers
from fathomline.sources.derived import inputs
from fathomline.streaming.front import serve

DATA = "/root/testdata/sf0.001"


def config(tmp_path, **more):
    values = {"inputs": DATA, "root": str(tmp_path / "out"), "retrieval": {"semantic_k": 20, "top_k": 10}, "expansion": {"hops": 1, "nodes_per_hop": 20, "neighbours": 5, "candidates_per_node": 5, "graph_candidates": 20}, "seeds": {"semantic_k": 3}, "neural_k": 8, "llm_k": 5, "limit": 12}
    return Config(**(values | more))


def test_stages(spark, tmp_path):
    c = config(tmp_path)
    out = Pipeline(spark, c).run("all")
    assert set(out) == {"retrieval", "neural", "llm"} and all(v["queries"] == 12 for v in out.values())
    p = Pipeline(spark, c, provider=lambda r: 1 / 0)
    assert p.run("all") == out  # everything is reused: the provider isn't asked
    assert p.run("evaluate", split="train")["retrieval"]["queries"] <= 12
    with pytest.raises(ValueError, match="other options"):
        Pipeline(spark, config(tmp_path, llm_k=4)).run("llm")
    Pipeline(spark, config(tmp_path, llm_k=4)).run("llm", force=True)  # the cache has all replies
    assert Pipeline(spark, c).read("llm").groupBy("query_id").count().agg({"count": "max"}).first()[0] == 4
    p.export("retrieval", str(tmp_path / "lines"))
    rows = spark.read.json(str(tmp_path / "lines")).collect()
    assert len(rows) == 12 and [x["rank"] for x in rows[0]["candidates"]] == list(range(1, len(rows[0]["candidates"]) + 1))
    with pytest.raises(ValueError):
        p.run("nothing")


def test_command_line(spark, tmp_path):
    c = config(tmp_path, model="set_transformer")
    path = tmp_path / "c.yaml"
    path.write_text(json.dumps(c.__dict__))
    main(["prepare", "--config", str(path)], spark)
    main(["run", "--stage", "retrieval", "--config", str(path), "--limit", "12"], spark)
    assert main(["evaluate", "--config", str(path)], spark)["retrieval"]["queries"] == 12
    (tmp_path / "bad.yaml").write_text("- a")
    with pytest.raises(ValueError):
        Config.load(str(tmp_path / "bad.yaml"))


def test_resumed_retrieval_and_trained_ranker(spark, tmp_path, monkeypatch):
    """Shards that are complete aren't done again; a trained model is used, with its representation, by side."""
    c = config(tmp_path, shards=3, model={"kind": "mlp", "hidden": 8}, training={"epochs": 2, "batch": 4, "workers": 1, "rate": 0.001}, split={"seed": 13, "fraction": 0.5})
    p = Pipeline(spark, c)
    for s in ("corpus", "vectors", "graph"):
        p.run(s)
    found, asked = p._found, []

    def cut_off(q):
        asked.append(1)
        if len(asked) == 3:
            raise RuntimeError("lost")
        return found(q)

    monkeypatch.setattr(p, "_found", cut_off)
    with pytest.raises(RuntimeError):
        p.run("retrieval")
    p.run("retrieval")
    assert len(asked) == 4
    whole = Pipeline(spark, config(tmp_path / "whole"))
    for s in ("corpus", "vectors", "graph", "retrieval"):
        whole.run(s)
    same = lambda x: {tuple(r) for r in x.read("retrieval").drop("shard").collect()}
    assert same(p) == same(whole)
    facts = files.read_json(spark, p.path("retrieval.manifest.json"))
    assert facts["queries"] == 12 and facts["mean_pool_size"] > 0 and 0 <= facts["mean_ranked_recall"] <= facts["mean_pool_recall"] <= 1 and facts["paths"] > 0
    p.ranker_dataset()
    assert p.fit()["last_epoch"] == 2
    p.run("neural", split="validation")
    p.run("neural", split="train")
    assert files.read_json(spark, p.path("neural.manifest.json"))["parameters"] == "checkpoints"
    sides = {s: {r[0] for r in p.read(n).select("query_id").distinct().collect()} for s, n in (("validation", "neural"), ("train", "neural.train"))}
    assert not sides["validation"] & sides["train"] and len(sides["validation"] | sides["train"]) == 12
    assert len(p.read("neural").first()["representation"]) == 8
    assert p.split_of("retrieval", "train").select("query_id").distinct().count() == len(sides["train"])
    p.run("llm", split="train")
    assert set(p.evaluate("train")) == {"retrieval", "neural", "llm"} and set(p.evaluate("train", "neural")) == {"neural"}
    p.export("neural", str(tmp_path / "n"), with_evidence=True)
    rows = readers.results(spark, str(tmp_path / "n")).collect()
    nodes = [n for r in rows for c in r["candidates"] for n in c["evidence_nodes"]]
    assert nodes and all(n["text"] for n in nodes) and {"candidate"} < {n["node_type"] for n in nodes}


def test_streamed_queries_are_answered_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    line = lambda i, t: json.dumps({"query_id": i, "text": t, "seeds": [], "excluded": []})
    (tmp_path / "in/a.json").write_text(line("s1", "the canal of a lodge") + "\n" + line("s2", "railway association"))
    static = inputs(spark, DATA)
    r = Retrieval(semantic_k=10, expansion=Expansion(hops=1, nodes_per_hop=5, neighbours=5, candidates_per_node=5), top_k=5)
    run = lambda: serve(spark, str(tmp_path / "in"), static, str(tmp_path / "out"), str(tmp_path / "check"), r).awaitTermination()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("query_id").count().count() == 2
    (tmp_path / "in/b.json").write_text(line("s3", "museum"))
    run()
    run()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(x["query_id"], x["count"]) for x in out.groupBy("query_id").count().collect()} == {("s1", 5), ("s2", 5), ("s3", 5)}


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, name):
    assert "DIFFERENT" not in same(spark, DATA, name, catalog.queries()[name], catalog.sql().get(name))
