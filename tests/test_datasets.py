import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.cli import extract_kg, main
from fathomline.operators import embedders, pool
from fathomline.operators.graph import citation_counts
from fathomline.operators.providers import ChatProvider
from fathomline.plans import files, local
from fathomline.plans.datasets import ParquetStore, Scidocs
from fathomline.plans.pipeline import Config, Pipeline
from fathomline.plans.registry import DATASETS, EMBEDDERS, GRAPHS, STORES, Registry
from fathomline.sources import readers

SMALL = {"retrieval": {"semantic_k": 5, "top_k": 4}, "expansion": {"hops": 1, "nodes_per_hop": 9, "neighbours": 9, "candidates_per_node": 9, "graph_candidates": 9}, "neural_k": 3, "llm_k": 2}


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value), encoding="utf-8")
    return str(path)


def lines(*rows):
    return "\n".join(json.dumps(r) for r in rows) + "\n"


@pytest.fixture
def scidocs(tmp_path):
    papers = {f"p{i}": {"title": f"Title {i}", "abstract": f"About topic {i % 3} and more"} for i in range(8)}
    return {
        "metadata": [put(tmp_path / "meta.json", papers)],
        "train_clicks": put(tmp_path / "clicks.csv", "query_id,clicked_id\np0,p3\np0,p6\np1,p4\nheld,p2\np2,gone\n"),
        "validation_qrels": put(tmp_path / "val.qrel", "p5 0 p2 1\np5 0 p1 0\np7 0 p4 1\n"),
        "forbidden_queries": put(tmp_path / "held.jsonl", lines({"_id": "held", "text": "x"}, {"_id": "p7", "text": "y"})),
        "enrichment": [put(tmp_path / "e.jsonl", lines({"paper_id": "p0", "authors": [{"authorId": 1, "name": "A"}], "fieldsOfStudy": ["Math"], "references": ["p3", "p0", "zz"]}, {"paper_id": "p3", "authors": [{"authorId": 1}], "references": []}, {"paper_id": "p7", "references": ["p1", "p2"]}, {"paper_id": "out", "authors": ["B"]}))],
        "beir_corpus": put(tmp_path / "corpus.jsonl", lines(*({"_id": k, "title": v["title"], "text": v["abstract"]} for k, v in papers.items()))),
        "beir_queries": put(tmp_path / "q.jsonl", lines({"_id": "p1", "text": "topic 1"}, {"_id": "p2", "text": "topic 2"})),
        "beir_qrels": put(tmp_path / "t.tsv", "query-id\tcorpus-id\tscore\np1\tp4\t1\np2\tp5\t1\np2\tp3\t0\n"),
    }


def test_scidocs_development(spark, tmp_path, scidocs):
    d = Scidocs(spark, "development", **scidocs)
    report = d.audit()
    assert (report["candidates"], report["queries"], report["splits"]) == (8, 3, {"train": 2, "validation": 1})
    assert (report["positives"], report["dropped_positives"], report["forbidden_queries"]) == (4, 1, 2)
    assert {(r["query_id"], tuple(r["seeds"]), tuple(r["excluded"]), r["split"], r["text"]) for r in d.queries().collect()} == {("p0", ("p0",), ("p0",), "train", "Title 0"), ("p1", ("p1",), ("p1",), "train", "Title 1"), ("p5", ("p5",), ("p5",), "validation", "Title 5")}
    for bad in (dict(expected={"queries": 4}), dict(missing_positives="strict")):
        with pytest.raises(ValueError):
            Scidocs(spark, "development", **scidocs, **bad).audit()
    with pytest.raises(ValueError):
        Scidocs(spark, "development", **(scidocs | {"enrichment": ["a.qrel"]}))
    with pytest.raises(FileNotFoundError):
        Scidocs(spark, "development", **(scidocs | {"enrichment": ["/nowhere"]}), require_enrichment=True).papers()
    g = GRAPHS.create("citations", d, d.corpus())
    assert {tuple(r)[:3] for r in g.edges.collect()} == {("candidate::p0", "candidate::p3", "cites"), ("candidate::p3", "candidate::p0", "cited_by")}
    counted = citation_counts(d.papers(), d.corpus(), d.forbidden().withColumnRenamed("query_id", "candidate_id")).first().asDict()
    assert counted == {"papers_in_corpus": 3, "papers_outside_corpus": 1, "author_links": 2, "field_links": 1, "forbidden_papers": 1, "skipped_references": 2, "citations": 1}


def test_scidocs_command(spark, tmp_path, scidocs):
    """From raw files to metrics, by the command line."""
    source = {"name": "scidocs", "protocol": "beir_test", **{k: v for k, v in scidocs.items() if k not in ("metadata", "train_clicks", "validation_qrels")}}
    c = put(tmp_path / "c.yaml", {"root": str(tmp_path / "out"), "source": source, "model": "mlp", **SMALL})
    report = main(["prepare", "--config", c], spark)
    assert report["splits"] == {"test": 2} and report["positives"] == 2 and files.read_json(spark, f"{tmp_path}/out/default/default/audit.json") == report
    out = main(["run", "--config", c], spark)
    assert set(out) == {"retrieval", "neural", "llm"} and out["retrieval"]["queries"] == 2
    held = Pipeline(spark, Config.load(c)).read("retrieval")
    assert held.where("query_id = candidate_id").count() == 0  # a paper is never its own answer
    assert main(["prepare-ranker", "--config", c], spark)["splits"]["test"] == 2
    bad = put(tmp_path / "bad.jsonl", lines({"_id": "p9", "text": "no positive"}))
    with pytest.raises(ValueError, match="without a positive"):
        Scidocs(spark, "beir_test", **(scidocs | {"beir_queries": bad})).queries()


def test_hotpot_from_raw_files(spark, tmp_path):
    q = lambda i, a, b: {"_id": i, "question": f"Who is {a}?", "supporting_facts": {"title": [a], "sent_id": [0]}, "context": {"title": [a, b], "sentences": [[f"{a} lived in {b} City."], [f"{b} is a place."]]}}
    questions = put(tmp_path / "q.json", [q("q1", "Alice Ames", "Berlin"), q("q2", "Bob Burr", "Berlin"), q("q3", "Carl Cole", "Paris")])
    made = str(tmp_path / "kg")
    paragraphs = put(tmp_path / "p.jsonl", lines(*({"id": t, "title": t, "text": f"{t} met Dora Dean and Eve Earl."} for t in ("Alice Ames", "Bob Burr", "Berlin"))))
    assert extract_kg(spark, paragraphs, made, 0, 2) + extract_kg(spark, paragraphs, made, 1, 2) == 3
    (tmp_path / "kg" / "part-00000" / "cut.json").write_text('{"id": "cut')
    assert extract_kg(spark, paragraphs, made, 0, 2) == 0 and main(["extract-kg", "--input", paragraphs, "--output", made, "--shard-index", "1", "--num-shards", "2"], spark) == {"written": 0}
    c = put(tmp_path / "c.yaml", {"root": str(tmp_path / "out"), "source": {"name": "hotpotqa", "questions": [questions], "extractions": f"{made}/part-*"}, "split": {"seed": 1, "fraction": 0.5}, **SMALL})
    assert main(["run", "--config", c], spark)["retrieval"]["queries"] == 3
    p = Pipeline(spark, Config.load(c))
    assert p.read("corpus").count() == 5  # Berlin's paragraph is one
    assert p.store.open().nodes.where("node_id = 'dora dean'").count() == 1
    main(["export", "--config", c, "--output", str(tmp_path / "lines"), "--evidence"], spark)
    rows = readers.results(spark, str(tmp_path / "lines")).collect()
    texts = {(n["node_type"], n["text"]) for r in rows for x in r["candidates"] for n in x["evidence_nodes"]}
    assert len(rows) == 3 and ("candidate", "Alice Ames") in texts


def test_registries(spark, tmp_path):
    assert {"tables", "hotpotqa", "scidocs"} <= set(DATASETS.made) and {"hashing", "table", "model"} <= set(EMBEDDERS.made) and {"knowledge", "citations"} <= set(GRAPHS.made) and {"parquet", "memory"} <= set(STORES.made)
    with pytest.raises(ValueError, match="unknown dataset: nothing; there are"):
        DATASETS.create("nothing")
    mine = Registry("thing")
    mine.register("a")(lambda x: x + 1)
    assert mine.create("a", 1) == 2
    with pytest.raises(ValueError):
        mine.register("a")(len)
    df = spark.createDataFrame([("a", "one two"), ("b", None)], "id string, text string")
    made = EMBEDDERS.create("model", model=lambda texts: np.array([[len(t), 1.0] for t in texts]), batch=1)(df, "id", "text")
    assert {(r["id"], tuple(r["vector"])) for r in made.collect()} == {("a", (7.0, 1.0)), ("b", (0.0, 1.0))}
    made.where("id = 'a'").withColumnRenamed("id", "item").write.parquet(str(tmp_path / "v"))
    table = EMBEDDERS.create("table", path=str(tmp_path / "v"))
    assert table(df.where("id = 'a'"), "id", "text").count() == 1
    with pytest.raises(Exception, match="no vector for b"):
        table(df, "id", "text").collect()
    assert embedders.hashing(16)(df, "id", "text").agg(F.min(F.size("vector"))).first()[0] == 16
    with pytest.raises(ValueError):
        STORES.create("memory", spark, "x").open()
    assert isinstance(STORES.create("parquet", spark, str(tmp_path)), ParquetStore)


def test_chat_provider(monkeypatch):
    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append((self.path, self.headers["Authorization"], json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            content = '```json\n{"ranking": [{"candidate_id": "b", "score": 2}, {"candidate_id": "a"}, "odd"]}\n```' if len(seen) == 1 else "[]"
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": content}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    p = ChatProvider("m", f"http://127.0.0.1:{server.server_port}/v1/", "SOME_KEY_OF_A_TEST", timeout=9)
    with pytest.raises(RuntimeError):
        p({"candidates": []})
    monkeypatch.setenv("SOME_KEY_OF_A_TEST", "k")
    assert p({"candidates": []}) == [{"candidate_id": "b", "score": "2"}, {"candidate_id": "a", "score": None}]
    path, key, body = seen[0]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["temperature"] == 0 and body["model"] == "m" and p.name.endswith(":m")
    with pytest.raises(ValueError):
        p({"candidates": []})
    server.shutdown()


ROWS = [("q", 0, "a", "Alice", "Alice lived in Berlin"), ("q", 1, "b", "Bob", "Bob knows chess chess very well"), ("q", 2, "c", "Carl", "chess players everywhere")]


def test_local_graph_and_retriever(spark):
    rows = spark.createDataFrame(ROWS, "query_id string, pos int, candidate_id string, title string, text string")
    e = lambda n, d="": {"entity_name": n, "entity_type": "person", "description": d}
    rec = [("r1", "Alice", [e(" Alice", "first"), e("Berlin"), e("")], [{"src_id": "r1", "tgt_id": "Berlin", "keywords": "lives_in", "description": ""}, {"src_id": "Berlin", "tgt_id": "Mars", "keywords": "x", "description": ""}])]
    records = spark.createDataFrame(rec, readers.EXTRACTION.replace("string, entities", "string, entities"))
    nodes, edges = local.local_graph(rows, records)
    assert {tuple(r)[1:] for r in edges.collect()} >= {("candidate::a", "entity::Alice", "mentions"), ("entity::Alice", "entity::Berlin", "lives_in"), ("candidate::b", "lexical::chess", "contains_term"), ("candidate::c", "lexical::chess", "contains_term")}
    assert edges.where("target = 'entity::Mars' or source = 'entity::'").count() == 0
    assert {r["text"] for r in nodes.where("node_id = 'entity::Alice'").collect()} == {"Alice. first"}
    titled = local.local_graph(rows, None, lexical=False)[1].collect()
    assert {(r["target"], r["relation"]) for r in titled} == {(f"entity::{t}", "has_title") for t in ("Alice", "Bob", "Carl")}
    questions = spark.createDataFrame([("q", "chess")], "query_id string, text string")
    ranked, paths = local.local_retriever(rows, questions, (nodes, edges), embedders.hashing(4096), seeds=1, hops=2)
    got = {r["candidate_id"]: (r["graph_score"], r["rank"]) for r in ranked.collect()}
    assert got["a"][0] == 0.0 and got["b"][0] == got["c"][0] == pytest.approx(1.0)  # one step from the seed, which is the question itself
    assert {tuple(r["path"]) for r in paths.collect()} == {("lexical::chess", "candidate::b"), ("lexical::chess", "candidate::c")}
    ev = {r["candidate_id"]: r for r in local.local_evidence(paths, (nodes, edges)).collect()}
    assert [n["node_id"] for n in ev["b"]["evidence_nodes"]] == ["lexical::chess", "candidate::b"] and ev["b"]["evidence_edges"][0]["relation"] == "contains_term"
    assert local.local_retriever(rows.limit(0), questions, local.local_graph(rows.limit(0), records))[0].count() == 0


def test_evidence_has_content(spark):
    paths = spark.createDataFrame([("q", "b", 1, ["candidate::a", "n1", "candidate::b"], ["r1", "r2"], 0.9), ("q", "b", 2, ["candidate::a", "n1", "n2", "candidate::b"], ["r1", "r3", "r4"], 0.5)], "query_id string, candidate_id string, path_rank int, path array<string>, relations array<string>, score double")
    chosen = spark.createDataFrame([("q", "b"), ("q", "z")], "query_id string, candidate_id string")
    nodes = spark.createDataFrame([("n1", "person", "Ann")], "node_id string, node_type string, text string")
    corpus = spark.createDataFrame([("a", "Title A", "x"), ("b", " ", "text of b")], "candidate_id string, title string, text string")
    got = {r["candidate_id"]: r for r in pool.evidence(chosen, paths, nodes, corpus).collect()}
    assert [tuple(n) for n in got["b"]["evidence_nodes"]] == [("candidate::a", "candidate", "Title A"), ("n1", "person", "Ann"), ("candidate::b", "candidate", "text of b"), ("n2", "graph_node", "n2")]
    assert [tuple(e) for e in got["b"]["evidence_edges"]] == [("candidate::a", "r1", "n1"), ("n1", "r2", "candidate::b"), ("n1", "r3", "n2"), ("n2", "r4", "candidate::b")]
    assert len(got["b"]["paths"]) == 2 and got["z"]["evidence_nodes"] == [] and got["z"]["paths"] == []
