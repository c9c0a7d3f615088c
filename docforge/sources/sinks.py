"""Sinks: JSONL, Markdown, vector tables, reports, and reading back."""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import file_stem, vector_literal

VECTOR_BATCH = 100
PREVIEW_CHARS = 500


class Sink(ABC):
    type: str = ""
    requires_embedding = False

    @abstractmethod
    def write(self, rows: DataFrame) -> None: ...

    @abstractmethod
    def delete_by_document(self, ids: list[str], spark: SparkSession) -> None: ...


def jsonl_record(tags: bool = True) -> Column:
    """The record of one chunk."""
    meta = F.struct("sectionTitle", "sectionLevel", "startPage", "charCount", "blockType")
    fields = ["id", "documentId", "sourcePath", "text", "ordinal", meta.alias("metadata")]
    return F.to_json(F.struct(*fields, *(["tags"] if tags else [])))


def replaced(old: DataFrame, new: DataFrame, key: str = "documentId") -> DataFrame:
    """Old rows of other documents and all new rows."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


class _Swapped(Sink):
    """A folder that is written anew beside the old one and then takes its place."""

    def __init__(self, path: str):
        self.path = path

    def _exists(self, spark: SparkSession) -> bool:
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)

    def _swap(self, spark: SparkSession, write: Callable[[str], None]) -> None:
        write(f"{self.path}.new")
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        fs.delete(path(self.path), True)
        fs.rename(path(f"{self.path}.new"), path(self.path))


class JsonlSink(_Swapped):
    """One JSON object a chunk; a document's rows replace its earlier ones; lines that cannot be read are kept."""

    type = "jsonl"

    def write(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        new = rows.select(jsonl_record("tags" in rows.columns).alias("value"), F.col("documentId").alias("_d"))
        if self._exists(spark):
            old = spark.read.text(self.path).select("value", F.get_json_object("value", "$.documentId").alias("_d"))
            new = old.join(new.select("_d"), "_d", "left_anti").select("value").unionByName(new.select("value"))
        self._swap(spark, lambda p: new.select("value").write.mode("overwrite").text(p))

    def delete_by_document(self, ids: list[str], spark: SparkSession) -> None:
        if self._exists(spark):
            kept = spark.read.text(self.path).where(~F.coalesce(F.get_json_object("value", "$.documentId").isin(ids), F.lit(False)))
            self._swap(spark, lambda p: kept.write.mode("overwrite").text(p))


def markdown(chunks: DataFrame, markers: bool = False) -> DataFrame:
    """``documentId, sourcePath, markdown``: chunks in order, a heading line where the section changes."""
    w = Window.partitionBy("documentId").orderBy("ordinal")
    title = F.coalesce("sectionTitle", F.lit(""))
    changed = (F.trim(title) != "") & ~F.coalesce(F.lag(title).over(w) == title, F.lit(False))
    head = F.when(title.startswith("#"), title).otherwise(F.concat(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.coalesce("sectionLevel", F.lit(0)))), F.lit(" "), title))
    mark = F.concat(F.lit("<!-- chunk id="), F.col("id"), F.lit(" level="), F.col("sectionLevel").cast("string"), F.lit(" page="), F.col("startPage").cast("string"), F.lit(" char_count="), F.col("charCount").cast("string"), F.lit(" -->\n"))
    block = F.concat(F.when(changed, F.concat(head, F.lit("\n\n"))).otherwise(F.lit("")), mark if markers else F.lit(""), F.col("text"), F.lit("\n\n"))
    rows = chunks.select("documentId", "sourcePath", "ordinal", block.alias("b"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "b"))), lambda x: x["b"]), "")
    return rows.groupBy("documentId").agg(F.min("sourcePath").alias("sourcePath"), joined.alias("markdown"))


def markdown_names(docs: DataFrame) -> DataFrame:
    """Adds ``fileName``: the source's stem, with the document's id where two share a stem."""
    stem = file_stem(F.col("sourcePath"))
    shared = docs.groupBy(stem.alias("_stem")).agg((F.count("*") > 1).alias("_shared"))
    out = docs.withColumn("_stem", stem).join(shared, "_stem")
    name = F.when(F.col("_shared"), F.concat("_stem", F.lit("-"), F.col("documentId"))).otherwise(F.col("_stem"))
    return out.withColumn("fileName", F.concat(name, F.lit(".md"))).drop("_stem", "_shared")


class MarkdownSink(Sink):
    """One Markdown file a document, written by the tasks into a folder that they share."""

    type = "markdown"

    def __init__(self, folder: str, markers: bool = True):
        self.folder, self.markers = folder, markers

    def write(self, rows: DataFrame) -> None:
        folder = self.folder
        os.makedirs(folder, exist_ok=True)

        def put(part: Iterator[Any]) -> None:
            for row in part:
                with open(os.path.join(folder, row.fileName), "w", encoding="utf-8") as f:
                    f.write(row.markdown)

        markdown_names(markdown(rows, self.markers)).foreachPartition(put)

    def delete_by_document(self, ids: list[str], spark: SparkSession) -> None:
        """Files carry no document id, so nothing is deleted."""


class VectorTableSink(_Swapped):
    """Vectors as a Parquet table, upserted by id."""

    type = "vectors"
    requires_embedding = True

    def write(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        out = rows
        if self._exists(spark):
            out = replaced(spark.read.parquet(self.path), rows, "id")
        self._swap(spark, lambda p: out.write.mode("overwrite").parquet(p))

    def delete_by_document(self, ids: list[str], spark: SparkSession) -> None:
        if self._exists(spark):
            kept = spark.read.parquet(self.path).where(~F.col("documentId").isin(ids))
            self._swap(spark, lambda p: kept.write.mode("overwrite").parquet(p))


class BatchSink(Sink):
    """Upserts through a client in batches, from the tasks: for SQL stores, ``rows_for_sql``; for point stores, ``points``."""

    requires_embedding = True

    def __init__(self, connect: Callable[[], Any], prepare: Callable[[DataFrame], DataFrame], batch: int = VECTOR_BATCH, type_: str = "batch"):
        self.connect, self.prepare, self.batch, self.type = connect, prepare, batch, type_

    def write(self, rows: DataFrame) -> None:
        connect, size = self.connect, self.batch

        def put(part: Iterator[Any]) -> None:
            client, held = connect(), []
            for row in part:
                held.append(row.asDict(True))
                if len(held) >= size:
                    client.upsert(held)
                    held = []
            if held:
                client.upsert(held)

        self.prepare(rows).foreachPartition(put)

    def delete_by_document(self, ids: list[str], spark: SparkSession) -> None:
        self.connect().delete(ids)


def rows_for_sql(embedded: DataFrame) -> DataFrame:
    """Columns of a vector table in SQL: a vector literal, typed metadata, 0 as null, and all metadata as JSON."""
    m = lambda k: F.col("metadata")[k]
    zero = lambda k: F.when(m(k).cast("int") != 0, m(k).cast("int"))
    return embedded.select("id", F.col("documentId").alias("document_id"), "text", vector_literal(F.col("embedding")).alias("embedding"), m("sectionTitle").alias("section_title"), zero("sectionLevel").alias("section_level"), zero("startPage").alias("start_page"), m("sourcePath").alias("source_path"), F.to_json("metadata").alias("metadata"))


def points(embedded: DataFrame) -> DataFrame:
    """Points of a vector store: a 64-bit id of the chunk id, vector and payload."""
    payload = F.map_concat(F.create_map(F.lit("text"), F.col("text"), F.lit("document_id"), F.col("documentId"), F.lit("chunk_id"), F.col("id")), F.col("metadata"))
    return embedded.select(F.xxhash64("id").alias("id"), F.col("embedding").alias("vector"), payload.alias("payload"))


FACTORIES: dict[str, Callable[[dict[str, Any]], Sink]] = {
    "jsonl": lambda p: JsonlSink(p["path"]),
    "markdown": lambda p: MarkdownSink(p["dir"], p.get("include_chunk_markers", True)),
    "vectors": lambda p: VectorTableSink(p["path"]),
}


def create_sink(kind: str, properties: dict[str, Any]) -> Sink:
    if kind not in FACTORIES:
        raise LookupError(f"CONFIG_005: no sink of type {kind!r}")
    return FACTORIES[kind](properties)


def default_sinks(output: str, configured: list[dict[str, Any]] | None = None) -> list[Sink]:
    """Configured sinks, else Markdown and JSONL; relative places are below the output folder."""
    rows = configured or [{"type": "markdown", "dir": "00-clean"}, {"type": "jsonl", "path": "01-chunks/chunks.jsonl"}]
    return [create_sink(r["type"], {k: os.path.join(output, v) if k in ("dir", "path") else v for k, v in r.items()}) for r in rows]


def write_reports(folder: str, processing: dict[str, Any], failures: list[dict[str, Any]]) -> None:
    os.makedirs(folder, exist_ok=True)
    for name, value in (("processing-report.json", processing), ("error-report.json", {"failed": len({f["filePath"] for f in failures}), "failures": failures})):
        with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False, indent=2)


def preview(docs: DataFrame, text_col: str = "markdown", size: int = PREVIEW_CHARS) -> DataFrame:
    return docs.withColumn("preview", F.substring(text_col, 1, size))


def page(chunks: DataFrame, number: int, size: int, order: tuple[str, ...] = ("documentId", "ordinal")) -> DataFrame:
    """Page ``number`` (from 1) of the chunks in order."""
    return chunks.orderBy(*order).offset((number - 1) * size).limit(size)
