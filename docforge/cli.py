"""Command line: run, preview, graph, init, report, version."""

from __future__ import annotations

import argparse
import json
import os
import sys

VERSION = "0.1.0"
TEMPLATE = """pipeline:
  name: my-pipeline
  stages:
    clean:
      chunking: {strategy: structure_aware, max_size: 500, overlap: 50, min_size: 50}
  sinks:
    - {type: markdown, dir: 00-clean}
    - {type: jsonl, path: 01-chunks/chunks.jsonl}
"""


def _arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="docforge")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("run", "preview"):
        r = sub.add_parser(name)
        r.add_argument("--input", action="append", required=True)
        r.add_argument("--output", default="out")
        r.add_argument("--config")
        r.add_argument("--set", action="append", default=[], metavar="KEY=VALUE")
    g = sub.add_parser("graph")
    g.add_argument("--chunks", required=True)
    g.add_argument("--dictionary", required=True, help="JSON object of name to type")
    g.add_argument("--output", required=True)
    i = sub.add_parser("init")
    i.add_argument("path", nargs="?", default="pipeline.yaml")
    r = sub.add_parser("report")
    r.add_argument("output")
    sub.add_parser("version")
    return p


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    if args.command == "init":
        if os.path.exists(args.path):
            print(f"{args.path} exists", file=sys.stderr)
            return 1
        with open(args.path, "w", encoding="utf-8") as f:
            f.write(TEMPLATE)
        return 0
    if args.command == "report":
        for name in ("processing-report.json", "error-report.json"):
            with open(os.path.join(args.output, "02-reports", name), encoding="utf-8") as f:
                print(f.read())
        return 0
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = SparkSession.builder.appName("docforge").getOrCreate()
    if args.command == "graph":
        from .operators import graph
        from .sources.files import read_chunks

        with open(args.dictionary, encoding="utf-8") as f:
            words = json.load(f)
        chunks = read_chunks(spark, args.chunks).where("id is not null")
        per_chunk = graph.chunk_entities(graph.dictionary_entities(chunks, words))
        order = chunks.select(F.col("id").alias("chunkId"), F.col("ordinal").alias("chunkOrder"))
        graph.merge_entities(per_chunk.join(order, "chunkId")).write.mode("overwrite").parquet(f"{args.output}/entities")
        return 0
    from .plans import config, pipeline
    from .sources.files import documents, scan

    text = None
    if args.config:
        with open(args.config, encoding="utf-8") as f:
            text = f.read()
    over = {"pipeline.input": args.input, "pipeline.output": args.output} | {k: json.loads(v) if v[:1] in "[{0123456789tf" else v for k, _, v in (x.partition("=") for x in args.set)}
    conf = config.load(text, over)
    if args.command == "preview":
        print(json.dumps(pipeline.preview(documents(scan(spark, conf.input)), conf), ensure_ascii=False, indent=2))
    else:
        print(json.dumps(pipeline.run(spark, conf).report, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
