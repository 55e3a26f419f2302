"""Command line: ``python -m fathomline.cli COMMAND --config FILE``."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import extract
from .plans import files
from .plans.pipeline import STAGES, Config, Pipeline
from .sources import readers, sinks

PREPARED = ["corpus", "audit", "graph", "vectors"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="fathomline")
    sub = p.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run stages; finished ones are reused")
    run.add_argument("--stage", default="all", choices=["all", *STAGES])
    run.add_argument("--limit", type=int)
    prepare = sub.add_parser("prepare", help="corpus, audit of the protocol, graph and vectors")
    prepare.add_argument("--stage", default="all", choices=["all", *PREPARED])
    ranker = sub.add_parser("prepare-ranker", help="features, labels and masks for training")
    train = sub.add_parser("train", help="fit the configured ranker and apply it")
    evaluate = sub.add_parser("evaluate")
    evaluate.add_argument("--stage", default="all", choices=["all", "retrieval", "neural", "llm"])
    export = sub.add_parser("export", help="nested JSON lines of a stage")
    export.add_argument("--stage", default="retrieval")
    export.add_argument("--output", required=True)
    export.add_argument("--evidence", action="store_true")
    for c in (run, prepare, ranker, train):
        c.add_argument("--force", action="store_true")
    for c in (run, evaluate, train):
        c.add_argument("--split")
    for c in (run, prepare, ranker, train, evaluate, export):
        c.add_argument("--config", required=True)
    kg = sub.add_parser("extract-kg", help="extraction records of paragraphs, by rule; finished ones are kept")
    kg.add_argument("--input", required=True, help="JSON array or lines of paragraphs: id or paragraph_id, title, text")
    kg.add_argument("--output", required=True)
    kg.add_argument("--shard-index", type=int, default=0)
    kg.add_argument("--num-shards", type=int, default=1)
    kg.add_argument("--no-resume", dest="resume", action="store_false")
    merge = sub.add_parser("merge-kg", help="merge delivered extraction records")
    merge.add_argument("--input", required=True)
    merge.add_argument("--output", required=True)
    merge.add_argument("--expected-count", type=int)
    return p


def extract_kg(spark: SparkSession, source: str, output: str, index: int = 0, count: int = 1, resume: bool = True, model=None) -> int:
    """Records of this worker's paragraphs that the output lacks; returns their number.  Unreadable records that a run
    that was cut off left behind don't count as done.  ``model``: see ``extract.by_model``; none: by rule."""
    schema = "id string, paragraph_id string, title string, text string"
    rows = readers.json_lines(spark, source, schema) if source.endswith("l") else readers.json_array(spark, source, schema)
    rows = rows.select(F.coalesce("id", "paragraph_id").alias("id"), "title", "text").where("id is not null")
    mine = sinks.worker_part(rows, "id", index, count)
    part = f"{output}/part-{index:05d}"
    if not resume:
        files.delete(spark, part)
    if files.exists(spark, part):
        done = spark.read.schema(readers.EXTRACTION).option("mode", "DROPMALFORMED").json(part).where("id is not null").select("id").distinct()
        mine = mine.join(done, "id", "left_anti")
    todo = extract.by_rule(mine, "id", "title", "text") if model is None else extract.by_model(mine, "id", "title", "text", model)
    made = extract.records(todo).persist()
    n = made.count()
    if n:
        made.write.mode("append").json(part)
    made.unpersist()
    return n


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("fathomline").getOrCreate()
    if a.command == "merge-kg":
        sinks.merge_extractions(spark, a.input, readers.EXTRACTION, a.expected_count).write.mode("overwrite").json(a.output)
        return {}
    if a.command == "extract-kg":
        return {"written": extract_kg(spark, a.input, a.output, a.shard_index, a.num_shards, a.resume)}
    config = Config.load(a.config)
    if a.command == "run" and a.limit is not None:
        config.limit = a.limit
    p = Pipeline(spark, config)
    out: dict = {}
    if a.command == "run":
        out = p.run(a.stage, a.force, a.split)
    elif a.command == "prepare":
        for s in PREPARED if a.stage == "all" else [a.stage]:
            if s != "audit":
                p.run(s, a.force)
            elif a.stage == "audit" or hasattr(p.data, "audit"):
                out = p.audit()
    elif a.command == "prepare-ranker":
        out = p.ranker_dataset()
    elif a.command == "train":
        if config.model_options()["kind"] != "linear":
            p.ranker_dataset()
            out = p.fit()
        p.run("neural", a.force, a.split)
    elif a.command == "evaluate":
        out = p.evaluate(a.split, None if a.stage == "all" else a.stage)
    else:
        p.export(a.stage, a.output, a.evidence)
    print(json.dumps(out, indent=2, sort_keys=True, default=str))
    return out


if __name__ == "__main__":
    main()
