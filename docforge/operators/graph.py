"""Entities and relations of chunks, merged into a graph.

Extraction is a plug-in (a provider that answers prompts, or the offline
dictionary); merging and resolution are aggregations and equi-joins.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id, normalize, relation_id

# Default types and limits of the prompts.
ENTITY_TYPES = ("人物", "概念", "物品", "地点", "事件")
RELATION_TYPES = ("相关", "组成", "包含", "属于", "位于", "产生", "影响")
MOST_ENTITIES, CONFIDENCE = 15, 0.8

ENTITY_SCHEMA = "chunkId string, pos int, name string, type string, aliases array<string>"
RELATION_SCHEMA = "chunkId string, source string, target string, type string, confidence double"


class LlmProvider(Protocol):
    def chat(self, system: str, user: str) -> str: ...


def entity_prompt(types: tuple[str, ...] = ENTITY_TYPES, most: int = MOST_ENTITIES) -> str:
    return f'Name at most {most} key entities that the text states, of these types: {", ".join(types)}. Answer in JSON only: {{"entities": [{{"name": "", "type": "", "aliases": []}}]}}'


def relation_prompt(names: list[str], types: tuple[str, ...] = RELATION_TYPES) -> str:
    return f'Name the relations between {", ".join(names)} that the text states, of these types: {", ".join(types)}. Answer in JSON only: {{"relations": [{{"source": "", "target": "", "type": "", "confidence": {CONFIDENCE}}}]}}'


def parse_answer(answer: str, key: str) -> list[dict]:
    """The records under a key of a JSON answer, fenced or not; anything malformed gives none."""
    text = re.sub(r"\s*```\s*\Z", "", re.sub(r"\A```\w*\s*", "", answer.strip())) if answer.strip().startswith("```") else answer
    try:
        found = json.loads(text).get(key, [])
    except (ValueError, AttributeError):
        return []
    return [x for x in found if isinstance(x, dict)] if isinstance(found, list) else []


def extract_entities(chunks: DataFrame, llm: LlmProvider, types: tuple[str, ...] = ENTITY_TYPES) -> DataFrame:
    """Entities as answered, in order; blank names are dropped."""
    system = entity_prompt(types)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk, text in zip(pdf["id"], pdf["text"], strict=True):
                for pos, e in enumerate(parse_answer(llm.chat(system, text or ""), "entities")):
                    if str(e.get("name") or "").strip():
                        rows.append((chunk, pos, e["name"], e.get("type"), [str(a) for a in e.get("aliases") or []]))
            yield pd.DataFrame(rows, columns=["chunkId", "pos", "name", "type", "aliases"])

    return chunks.select("id", "text").mapInPandas(run, ENTITY_SCHEMA)


def dictionary_entities(chunks: DataFrame, dictionary: dict[str, str]) -> DataFrame:
    """Offline extraction: dictionary words that a chunk contains, by first occurrence; native."""
    words = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in sorted(dictionary.items())))
    hits = F.filter(F.transform(words, lambda w: F.struct(F.instr(F.col("text"), w["name"]).alias("at"), w["name"].alias("name"), w["type"].alias("type"))), lambda h: h["at"] > 0)
    row = chunks.select(F.col("id").alias("chunkId"), F.posexplode(F.array_sort(hits)).alias("pos", "h"))
    return row.select("chunkId", "pos", "h.name", "h.type", F.array().cast("array<string>").alias("aliases"))


def chunk_entities(found: DataFrame) -> DataFrame:
    """One row per chunk and normalised name: the first keeps name and type, later names become aliases."""
    keyed = found.withColumn("normalizedKey", normalize(F.col("name")))
    g = keyed.groupBy("chunkId", "normalizedKey").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "type", "aliases"))).alias("x"))
    first = F.col("x")[0]
    later = F.transform(F.slice("x", 2, F.size("x")), lambda e: e["name"])
    return g.select("chunkId", entity_id(F.col("normalizedKey")).alias("id"), first["name"].alias("name"), first["type"].alias("type"), "normalizedKey", first["pos"].alias("pos"), F.array_distinct(F.concat(first["aliases"], later)).alias("aliases"))


def merge_entities(per_chunk: DataFrame, order_col: str = "chunkOrder") -> DataFrame:
    """One row per normalised name over all chunks: the first in order keeps name and type, aliases unite in order.

    Aliases are made distinct by chunk order before they are gathered, so a name
    in every chunk gathers its distinct aliases only.
    """
    first = per_chunk.groupBy("normalizedKey").agg(F.min_by(F.struct("id", "name", "type"), F.struct(order_col, "pos")).alias("f"))
    alias = per_chunk.select("normalizedKey", order_col, "pos", F.posexplode("aliases").alias("i", "alias")).groupBy("normalizedKey", "alias").agg(F.min(F.struct(order_col, "pos", "i")).alias("o"))
    alias = alias.groupBy("normalizedKey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "alias"))), lambda x: x["alias"]).alias("aliases"))
    return first.join(alias, "normalizedKey", "left").select("f.id", "f.name", "f.type", "normalizedKey", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def extract_relations(chunks: DataFrame, entities: DataFrame, llm: LlmProvider, types: tuple[str, ...] = RELATION_TYPES) -> DataFrame:
    """Relations as answered, for chunks that have entities."""
    names = entities.groupBy("chunkId").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for chunk, text, known in zip(pdf["id"], pdf["text"], pdf["names"], strict=True):
                for r in parse_answer(llm.chat(relation_prompt(list(known), types), text or ""), "relations"):
                    rows.append((chunk, r.get("source"), r.get("target"), r.get("type"), float(CONFIDENCE if r.get("confidence") is None else r["confidence"])))
            yield pd.DataFrame(rows, columns=["chunkId", "source", "target", "type", "confidence"])

    return chunks.select("id", "text").join(names.withColumnRenamed("chunkId", "id"), "id").mapInPandas(run, RELATION_SCHEMA)


def resolve_relations(found: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends become entity ids by name or alias within the chunk; where entities share a name the last one holds it."""
    named = entities.select("chunkId", "id", "pos", F.explode(F.array_union(F.array("name"), "aliases")).alias("n"))
    named = named.groupBy("chunkId", "n").agg(F.max_by("id", "pos").alias("id"))
    source = named.select("chunkId", F.col("n").alias("source"), F.col("id").alias("sourceEntityId"))
    target = named.select("chunkId", F.col("n").alias("target"), F.col("id").alias("targetEntityId"))
    out = found.join(source, ["chunkId", "source"]).join(target, ["chunkId", "target"])
    return out.select(relation_id(F.col("sourceEntityId"), F.col("targetEntityId"), F.col("type")).alias("id"), "sourceEntityId", "targetEntityId", "type", F.col("chunkId").alias("source"), F.coalesce("confidence", F.lit(CONFIDENCE)).alias("confidence"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows by key, the new one where both have it; the last of equal new keys is not defined and must not occur."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def valid_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """One edge for each (source, target, id) whose ends exist; the least chunk's row wins."""
    ids = entities.select("id")
    ok = relations.join(ids.withColumnRenamed("id", "sourceEntityId"), "sourceEntityId", "left_semi").join(ids.withColumnRenamed("id", "targetEntityId"), "targetEntityId", "left_semi")
    one = ok.groupBy("sourceEntityId", "targetEntityId", "id").agg(F.min(F.struct("source", "type", "confidence")).alias("x"))
    return one.select("id", "sourceEntityId", "targetEntityId", "x.type", "x.source", "x.confidence")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, out_degree, in_degree``."""
    ends = edges.select(F.col("sourceEntityId").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("targetEntityId").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def stats(lines: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """One row of totals; lines: rows of a JSONL scan with their ``_corrupt`` column."""
    a = lines.agg(F.count("*").alias("totalChunks"), F.coalesce(F.sum(F.col("_corrupt").isNotNull().cast("long")), F.lit(0)).alias("failedChunks"))
    return a.crossJoin(entities.agg(F.count("*").alias("totalEntities"))).crossJoin(relations.agg(F.count("*").alias("totalRelations")))
