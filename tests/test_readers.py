import json

import pytest

from fathomline.functions import text as tx
from fathomline.operators import corpus as cp
from fathomline.sources import readers, sinks
from pyspark.sql import functions as F


def put(path, value):
    path.write_text(value, encoding="utf-8")
    return str(path)


QUESTIONS = [
    {"_id": "q1", "question": "Who?", "supporting_facts": {"title": ["Alice", "Paris", "Gone"], "sent_id": [0, 0, 0]}, "context": {"title": ["Alice", "Bob", "Paris", "cut"], "sentences": [["Alice lived.", "In Paris."], ["Bob."], [" Paris is a city. "]]}, "extra": 1},
    {"_id": "q2", "question": "Sky?", "supporting_facts": {"title": ["Sky"], "sent_id": [0]}, "context": {"title": ["Sky", "Sea"], "sentences": [["The sky."], ["The sea."]]}},
]


def test_questions(spark, tmp_path):
    rows = readers.questions(spark, put(tmp_path / "q.json", json.dumps(QUESTIONS, indent=1)))
    got = cp.instances(rows).orderBy("query_id", "pos").collect()
    assert [(r["query_id"], r["title"], r["positive"]) for r in got] == [("q1", "Alice", True), ("q1", "Bob", False), ("q1", "Paris", True), ("q2", "Sky", True), ("q2", "Sea", False)]
    import hashlib

    assert got[0]["candidate_id"] == hashlib.sha1("Alice\nAlice lived.\nIn Paris.".encode()).hexdigest() and got[2]["text"] == "Paris is a city."
    assert [(r["query_id"], r["missing"]) for r in cp.missing_titles(rows).collect()] == [("q1", ["Gone"])]
    with pytest.raises(ValueError):
        readers.questions(spark, put(tmp_path / "no.json", '{"a": 1}'))


def test_corpus_formats(spark, tmp_path):
    one = readers.corpus(spark, put(tmp_path / "v1.jsonl", '\n{"paragraph_id": "p1", "title": "T", "text": "x", "sources": ["a"]}\n\n{"paragraph_id": "p2", "title": "", "text": "y"}\n'))
    assert {(r["candidate_id"], r["embedding_text"]) for r in one.collect()} == {("p1", "T\nx"), ("p2", "y")}
    two = readers.corpus(spark, put(tmp_path / "v2.jsonl", '{"candidate_id": "c1", "text": "x", "metadata": {"a": 1}}\n{"candidate_id": "c2", "text": "y", "embedding_text": "z"}'))
    assert {(r["candidate_id"], r["embedding_text"]) for r in two.collect()} == {("c1", "x"), ("c2", "z")}
    for bad in ("", '{"id": 1}', '{"candidate_id": "c", "text": "x"}\n{"candidate_id": "c", "text": "y"}'):
        with pytest.raises(ValueError):
            readers.corpus(spark, put(tmp_path / f"bad{len(bad)}.jsonl", bad))


def test_judgements(spark, tmp_path):
    q = readers.beir_queries(spark, put(tmp_path / "q.jsonl", '{"_id": "a", "text": "A"}\n{"query_id": "b", "title": "B"}\n{"_id": "c"}'))
    assert {(r["query_id"], r["text"]) for r in q.collect()} == {("a", "A"), ("b", "B"), ("c", "c")}
    rows = readers.beir_qrels(spark, put(tmp_path / "r.tsv", "query-id\tcorpus-id\tscore\na\td2\t1\na\td1\t1\na\td2\t1\nb\td3\t0\n"))
    got = cp.qrels(rows, "query_id", "candidate_id", F.col("score"), "seq").orderBy("pos").collect()
    assert [(r["query_id"], r["candidate_id"]) for r in got] == [("a", "d2"), ("a", "d1")]
    t = readers.trec_qrels(spark, put(tmp_path / "t.qrel", "q1 0 d1 1\nq1  0\td2 x\n\nq2 0 d3 0\n"))
    assert {(r["query_id"], r["candidate_id"], r["score"]) for r in t.collect()} == {("q1", "d1", 1), ("q2", "d3", 0)}
    with pytest.raises(Exception, match="four columns"):
        readers.trec_qrels(spark, put(tmp_path / "bad.qrel", "q1 0 d1\n")).collect()
    for head in ("", "Query_ID,clicked_id,x\n"):
        c = readers.clicks(spark, put(tmp_path / f"c{len(head)}.csv", head + "q1,d1,z\nq1,d2\nq2\n"))
        assert {(r["query_id"], r["candidate_id"]) for r in c.collect()} == {("q1", "d1"), ("q1", "d2")}


def test_papers(spark, tmp_path):
    a = put(tmp_path / "a.json", json.dumps({"p1": {"title": "One", "abstract": "short"}, "p2": {"paper_id": "p2", "title": "Two", "text": "t"}}))
    b = put(tmp_path / "b.json", json.dumps([{"_id": "p1", "abstract": "longer text"}, {"id": "p2", "title": "No", "abstract": ""}]))
    got = {r["paper_id"]: (r["title"], r["text"]) for r in readers.paper_metadata(spark, [a, b]).collect()}
    assert got == {"p1": ("One", "longer text"), "p2": ("Two", "t")}
    e1 = put(tmp_path / "e.jsonl", '{"paper_id": "p1", "authors": ["x", {"authorId": 7, "name": "N"}], "fieldsOfStudy": "Math"}\n{"paper_id": "p1", "authors": [{"name": "Last"}], "references": ["p2"]}')
    e2 = put(tmp_path / "e2.json", json.dumps({"p1": {"topics": ["Bio", None]}}))
    got = readers.enrichment(spark, [e1, e2]).collect()[0]
    assert (got["authors"], got["fields"], got["references"]) == (["Last"], ["Bio"], ["p2"])


def test_extractions_and_merge(spark, tmp_path):
    rec = lambda i, n: json.dumps({"id": i, "title": n, "entities": [{"entity_name": n}], "relationships": []})
    put(tmp_path / "s1.jsonl", rec("a", "Alice") + "\n" + rec("b", "Bob"))
    put(tmp_path / "s2.jsonl", rec("c", "ALICE "))
    titles = spark.createDataFrame([("alice",)], "title string")
    assert [r["id"] for r in readers.extractions(spark, str(tmp_path / "s*.jsonl"), titles).collect()] == ["c"]
    assert sinks.merge_extractions(spark, str(tmp_path / "s*.jsonl"), readers.EXTRACTION, 3).count() == 3
    with pytest.raises(ValueError):
        sinks.merge_extractions(spark, str(tmp_path / "s*.jsonl"), readers.EXTRACTION, 4)
    put(tmp_path / "s3.jsonl", rec("a", "Again"))
    with pytest.raises(ValueError):
        sinks.merge_extractions(spark, str(tmp_path / "s*.jsonl"), readers.EXTRACTION)


def test_text_functions(spark):
    row = spark.createDataFrame([("  Ab  Straße ", "One two-three it's", "<triplet> A <subj> B <obj> owns <triplet> C <subj> D <obj> is", '```json\n{"ranking": [{"candidate_id": "a"}]}\n```', "not json")], "a string, b string, c string, d string, e string")
    got = row.select(
        tx.strip(F.col("a")).alias("s"), tx.normalize_entity(F.col("a")).alias("n"), tx.bigrams(tx.tokens(F.col("b"))).alias("g"), tx.triplets(F.col("c")).alias("t"),
        tx.parse_reply(F.col("d"), "ranking array<struct<candidate_id string>>").alias("d"), tx.parse_reply(F.col("e"), "ranking array<struct<candidate_id string>>").alias("e"),
        tx.with_prefix("entity", F.lit("x")).alias("p"), tx.without_prefix("entity", F.lit("entity::x")).alias("u"), tx.context(F.lit("abcdef"), F.lit(2), F.lit(3), 1).alias("w"), tx.bigrams(F.array(F.lit("one"))).alias("none"),
    ).first()
    assert got["s"] == "Ab  Straße" and got["n"] == "ab strasse" and got["g"] == ["one::two-three", "two-three::it's"] and got["none"] == []
    assert [tuple(t) for t in got["t"]] == [("A", "B", "owns"), ("C", "D", "is")]
    assert got["d"]["ranking"][0]["candidate_id"] == "a" and got["e"] is None
    assert got["p"] == "entity::x" and got["u"] == "x" and got["w"] == "bcd"


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(f"c{i}", f"t{i}") for i in range(50)], "candidate_id string, text string")
    assert sinks.write_corpus(df.repartition(3), str(tmp_path / "c")) == sinks.digest(df.repartition(7)) != sinks.digest(df.limit(49))
    out = str(tmp_path / "shards")
    sinks.write_shards(df.where("candidate_id < 'c3'"), out, "candidate_id", 8)
    todo = sinks.resume(spark, df, out, "candidate_id", 8)
    sinks.write_shards(todo.drop("shard"), out, "candidate_id", 8)
    assert spark.read.parquet(out).select("candidate_id").distinct().count() == spark.read.parquet(out).count() == 50
    assert sinks.resume(spark, df, out, "candidate_id", 8).count() == 0
    more = str(tmp_path / "more")
    assert [sinks.append_missing(df.limit(20), more, "candidate_id"), sinks.append_missing(df, more, "candidate_id"), sinks.append_missing(df, more, "candidate_id")] == [20, 30, 0]
    parts = [sinks.worker_part(df, "candidate_id", i, 3).count() for i in range(3)]
    assert sum(parts) == 50
    with pytest.raises(ValueError):
        sinks.worker_part(df, "candidate_id", 3, 3)


def test_corpus_first_wins(spark):
    rows = [(1, "T ", "x", ["b", "a"]), (2, "T", " x", ["c", "b"]), (3, "", "x", ["d"]), (4, "U", None, ["d"])]
    df = spark.createDataFrame(rows, "seq int, title string, text string, sources array<string>")
    got = cp.paragraph_corpus(df, "seq").collect()
    assert [(r["title"], r["text"], r["sources"]) for r in got] == [("T", "x", ["b", "a", "c"])]
    s = cp.corpus_stats(df).first()
    assert (s["input_records"], s["paragraphs"], s["duplicates_removed"], s["blank"]) == (4, 1, 3, 2)
    kept, dropped = cp.audited_positives(spark.createDataFrame([("q", "a"), ("q", "b")], "query_id string, candidate_id string"), spark.createDataFrame([("a",)], "candidate_id string"))
    assert kept.count() == dropped.count() == 1
    with pytest.raises(ValueError):
        cp.audited_positives(dropped, kept, "strict")


def test_rows_keep_the_order_of_the_files(spark, tmp_path):
    """The last record wins, also where a later file is much larger than an earlier one."""
    record = lambda d: '{"id": "1", "title": "T", "entities": [{"entity_name": "Alpha", "description": "%s"}]}' % d
    (tmp_path / "s1.jsonl").write_text(record("early") + "\n")
    (tmp_path / "s2.jsonl").write_text("\n".join(record("late" + "x" * 90) for _ in range(20_000)) + "\n" + record("last") + "\n")
    titles = spark.createDataFrame([("alpha",)], "title string")
    got = readers.extractions(spark, str(tmp_path), titles).collect()
    assert [r["entities"][0]["description"] for r in got] == ["last"]


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_top_level_values_in_parts(size):
    import io

    values = {"a": {"x": [1, {"y": "ü]}"}]}, "b": 12, "c": None, "d\"": "z"}
    for text, want in ((json.dumps(values, ensure_ascii=False, indent=1), values.items()), (" [ ] ", []), ("{}", []), (json.dumps([1, [2], "3"]), [(None, 1), (None, [2]), (None, "3")])):
        assert [(k, json.loads(v)) for k, v in readers.top_level(io.BytesIO(text.encode()).read, size)] == list(want)
    for bad in ("12", "", '[1, 2', '{"a" 1}', '[{"a": ]'):
        with pytest.raises(ValueError):
            list(readers.top_level(io.BytesIO(bad.encode()).read, size))


def test_papers_of_a_map_and_of_a_list(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"p1": {"title": "A", "abstract": "short"}, "p2": {"paper_id": "q2", "title": "B", "text": "t"}}))
    (tmp_path / "b.json").write_text(json.dumps([{"paper_id": "p1", "title": "A2", "abstract": "much longer"}]))
    got = readers.paper_metadata(spark, [str(tmp_path / "a.json"), "file://" + str(tmp_path / "b.json")]).collect()
    assert {tuple(r) for r in got} == {("p1", "A2", "much longer"), ("q2", "B", "t")}
