"""The document pipeline: files to clean chunks, marks, gates, sinks, state and reports."""

from __future__ import annotations

import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking, cleaning, dedup, embedding, quality
from ..sources import files as sources
from ..sources import sinks as outputs
from .config import Config
from .state import FAILURES, Events, StateTable, processing_report


@dataclass
class Result:
    documents: DataFrame
    chunks: DataFrame
    failures: DataFrame
    report: dict[str, Any] = field(default_factory=dict)


def cleaned(docs: DataFrame, config: Config) -> DataFrame:
    """Documents without exact duplicates, with their content cleaned."""
    clean = config.stages["clean"]
    flags = clean["normalize"]
    if clean["dedup"]["file_level"]["enabled"]:
        marked = dedup.first_by_hash(docs)
        docs = marked.where(~F.col("isDuplicate") | (F.trim("content") == "")).drop("isDuplicate", "duplicateOf")
    chain = cleaning.steps(fullwidth=flags["fullwidth_to_halfwidth"], simplified=flags["traditional_to_simplified"], whitespace=flags["trim_whitespace"])
    return cleaning.clean(docs, "content", "content", chain)


def chunked(docs: DataFrame, config: Config) -> DataFrame:
    c = config.chunking
    limits = chunking.Limits(c["max_size"], c["overlap"], c["min_size"])
    return chunking.create(c["strategy"])(docs, "id", "content", "sourcePath", limits)


def marked(chunks: DataFrame, config: Config) -> DataFrame:
    """Near duplicates get a tag; the order is that of source path and ordinal."""
    level = config.stages["clean"]["dedup"]["paragraph_level"]
    if not level["enabled"]:
        return chunks.withColumn("tags", F.array().cast("array<string>"))
    order = F.concat(F.coalesce("sourcePath", F.lit("")), F.lit("\x00"), F.lpad(F.col("ordinal").cast("string"), 9, "0"), F.lit("\x00"), F.col("id"))
    keyed = chunks.select("id", "text", order.alias("_o"))
    found = dedup.near_duplicates(keyed, "_o", "text", level["threshold"])
    last = lambda c: F.element_at(F.split(c, "\x00"), -1)
    return dedup.mark(chunks, found.select(last(F.col("_o")).alias("id"), last(F.col("leader")).alias("leader")))


def transform(docs: DataFrame, config: Config) -> Result:
    """All steps from documents to gated chunks; lazy."""
    failed = docs.where("status = 'FAILED'").select(F.col("sourcePath").alias("filePath"), F.col("id").alias("documentId"), F.lit("INGEST").alias("stage"), F.lit("PARSE_001").alias("errorCode"), F.col("error").alias("message"))
    sound = cleaned(docs.where("status <> 'FAILED'"), config)
    kept, garbled = quality.gate(marked(chunked(sound, config), config))
    return Result(docs, kept, failed.unionByName(garbled))


def run(spark: SparkSession, config: Config, parsers: dict[str, sources.Parser] | None = None, provider: embedding.EmbeddingProvider | None = None, events: Events | None = None) -> Result:
    """Scan, transform, write to every sink, record state and reports."""
    events, job, output = events or Events(), config.job_id(), config.output or "."
    events.emit("PipelineStarted", job=job)
    state = StateTable(spark, os.path.join(output, config.state["path"]))
    sinks = outputs.default_sinks(output, config.sinks)
    vectors = any(s.requires_embedding for s in sinks)
    scanned = sources.scan(spark, config.input)
    todo = quality.pending(scanned.withColumnRenamed("path", "file_path"), state.current(job), vectors).withColumnRenamed("file_path", "path")
    work = os.path.join(output, ".docforge", "work", job)
    sources.documents(todo, parsers).write.mode("overwrite").parquet(f"{work}/documents")
    docs = spark.read.parquet(f"{work}/documents")
    result = transform(docs, config)
    result.chunks.write.mode("overwrite").parquet(f"{work}/chunks")
    chunks = spark.read.parquet(f"{work}/chunks")
    failures = result.failures.collect()
    events.emit("StageProgress", stage="CLEAN", chunks=chunks.count())
    embedded = None
    if vectors:
        used = provider or embedding.HashingProvider(config.stages["embed"].get("dimensions", 64))
        embed = embedding.embedder(used, config.stages["embed"].get("batch_size", embedding.BATCH))
        embedding.embedded_chunks(chunks, embed).write.mode("overwrite").parquet(f"{work}/embedded")
        embedded = spark.read.parquet(f"{work}/embedded")
    sunk = True
    for sink in sinks:
        try:
            sink.write(embedded if sink.requires_embedding else chunks)
        except Exception as error:  # noqa: BLE001  one sink does not keep others from writing
            sunk = False
            failures.append({"filePath": None, "documentId": None, "stage": "SINK", "errorCode": "SINK_003", "message": f"{sink.type}: {error}"[:500]})
            events.emit("SinkFailed", sink=sink.type)
    failed = spark.createDataFrame([tuple(f[k] for k in ("filePath", "documentId", "stage", "errorCode", "message")) for f in failures], FAILURES)
    bad = failed.where("filePath is not null").select(F.col("filePath").alias("file_path"))
    done = ["INGEST", "CLEAN", *(["EMBED"] if vectors else []), *(["SINK"] if sunk else [])]
    rows = docs.select(F.lit(job).alias("job_id"), F.col("sourcePath").alias("file_path"), F.col("contentHash").alias("content_hash"), F.col("id").alias("document_id")).join(bad, "file_path", "left_anti")
    state.append(rows.withColumn("stage", F.explode(F.array(*(F.lit(s) for s in done)))).withColumn("status", F.lit("SUCCESS")))
    report = processing_report(docs, chunks, failed)
    outputs.write_reports(os.path.join(output, "02-reports"), report, [r.asDict() for r in failed.collect()])
    events.emit("PipelineFinished", **report)
    return Result(docs, chunks, failed, report)


def preview(docs: DataFrame, config: Config, limit: int = 20) -> dict[str, Any]:
    """Clean and chunk without de-duplication or gate; the first chunks, their number and whether more exist."""
    sound = cleaning.clean(docs, "content", "content")
    chunks = chunked(sound, config)
    first = [r.asDict() for r in chunks.orderBy("documentId", "ordinal").limit(limit).collect()]
    total = chunks.count()
    return {"chunks": first, "total": total, "truncated": total > limit}
