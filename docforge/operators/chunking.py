"""Chunking: sections, structure-aware, fixed and semantic splitting.

``sections`` is relational (a running sum over a text's lines).  The
structure-aware chunker carries a buffer from section to section and a position
through a text, so it runs as one narrow Arrow pass over whole documents: no
exchange, and a document never leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chunk_id, lines, slices, strip
from ..functions.vectors import cosine

# Heading forms, words and limits.
MARKDOWN = r"^#{1,6}\s+.+$"
CHAPTER = r"^第[一二三四五六七八九十百千零\d]+章"
SECTION = r"^第[一二三四五六七八九十百千零\d]+[节回卷篇条]"
CHINESE_NUMBER = r"^[一二三四五六七八九十]+[、.．]"
BRACKETED = r"^[（(][一二三四五六七八九十\d]+[)）]"
NUMBERED = r"^\d+[、.．]\s*\S"
DECIMAL = r"^\d+\.\d+\s"
HEADING_WORDS = (
    "序", "自序", "他序", "校堪序", "校勘序", "前言", "后记", "跋",
    "自 序", "他 序", "校 堪 序", "校 勘 序", "前 言", "后 记",
    "目录", "目 录", "目录:", "目 录:", "contents", "Contents", "CONTENTS",
    "引言", "导言", "导论", "绪论", "概述", "综述", "结论", "结语", "附录",
)
LEADERS = r"\.{3,}|…{2,}|。{3,}"
CONTENTS_TITLE = r"(?i)^(目\s*录|目\s*錄|contents)$"
HEADING_CHARS = 40
BREAKS = ("。", ". ", "！", "？", "!", "?", "\n\n", "\n", " ")
FRAGMENT_OPENERS = "。，、；：？！.,;:?!．"
FRAGMENT_CHARS = 30
MAX_SIZE, OVERLAP, MIN_SIZE = 500, 50, 50
SENTENCE_CHARS, SENTENCE_ENDS, BOUNDARY = 20, "。！？!?\n", 0.7

#: Java white space, for strip in Python: Python's own set also takes U+0085 and U+00A0.
JAVA_SPACE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x1680, *range(0x2000, 0x2007), *range(0x2008, 0x200B), 0x2028, 0x2029, 0x205F, 0x3000]))
CHUNK_SCHEMA = "id string, documentId string, sourcePath string, text string, ordinal int, sectionTitle string, sectionLevel int, startPage int, charCount int, blockType string"


def heading_level(line: Column, words: tuple[str, ...] = HEADING_WORDS) -> Column:
    """0 for no heading, else 1 to 6, of a stripped line."""
    numbered = (
        F.when(line.rlike(CHAPTER), 1)
        .when(line.rlike(SECTION) | line.rlike(CHINESE_NUMBER) | line.rlike(BRACKETED), 2)
        .when(line.rlike(NUMBERED) | line.rlike(DECIMAL), 3)
        .otherwise(0)
    )
    return (
        F.when(line.isNull() | (line == "") | (F.length(line) > HEADING_CHARS) | line.rlike(LEADERS), 0)
        .when(line.rlike(MARKDOWN), F.length(F.regexp_extract(line, "^#+", 0)))
        .when(line.isin(*words), 2)
        .otherwise(numbered)
    )


def is_contents_title(line: Column) -> Column:
    return line.rlike(CONTENTS_TITLE)


def sections(df: DataFrame, doc_col: str, text_col: str = "text", words: tuple[str, ...] = HEADING_WORDS) -> DataFrame:
    """``doc, section, title, level, text``: sections with text, in order; one exchange by document."""
    row = df.select(doc_col, F.posexplode(lines(F.col(text_col))).alias("pos", "line"))
    row = row.withColumn("_s", strip(F.col("line"))).withColumn("_level", heading_level(F.col("_s"), words)).withColumn("_toc", is_contents_title(F.col("_s")))
    up_to = Window.partitionBy(doc_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    names = (F.col("_level") > 0) & ~F.col("_toc")
    row = row.select(
        doc_col, "pos", "line",
        F.sum(F.when(F.col("_level") > 0, 1).otherwise(0)).over(up_to).cast("int").alias("section"),
        F.last(F.when(names, F.col("_s")), ignorenulls=True).over(up_to).alias("title"),
        F.last(F.when(names, F.col("_level")), ignorenulls=True).over(up_to).alias("level"),
    )
    out = row.groupBy(doc_col, "section").agg(
        F.coalesce(F.max("title"), F.lit("")).alias("title"),
        F.coalesce(F.max("level"), F.lit(0)).alias("level"),
        strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")).alias("text"),
    )
    return out.where(F.col("text") != "")


@dataclass(frozen=True)
class Limits:
    max_size: int = MAX_SIZE
    overlap: int = OVERLAP
    min_size: int = MIN_SIZE
    break_mode: str = "reference"

    def __post_init__(self) -> None:
        if self.max_size <= 0 or not 0 <= self.overlap < self.max_size or self.min_size < 0:
            raise ValueError(f"bad limits: {self}")


_PY = {k: re.compile(v) for k, v in (("md", MARKDOWN), ("chapter", CHAPTER), ("second", f"{SECTION}|{CHINESE_NUMBER}|{BRACKETED}"), ("third", f"{NUMBERED}|{DECIMAL}"), ("leaders", LEADERS), ("contents", CONTENTS_TITLE))}


def level_of(line: str, words: frozenset[str] | set[str]) -> int:
    """``heading_level`` for one line in Python."""
    if not line or len(line) > HEADING_CHARS or _PY["leaders"].search(line):
        return 0
    if _PY["md"].match(line):
        return len(line) - len(line.lstrip("#"))
    if line in words:
        return 2
    return 1 if _PY["chapter"].match(line) else 2 if _PY["second"].match(line) else 3 if _PY["third"].match(line) else 0


def sections_of(text: str, words: frozenset[str] | set[str]) -> Iterator[tuple[str, str, int]]:
    """(text, title, level) of a document's sections; a blank preamble is empty."""
    title, level, rows = "", 0, []
    for line in re.sub(r"\n+\Z", "", text).split("\n"):
        stripped = line.strip(JAVA_SPACE)
        found = level_of(stripped, words)
        if found:
            if rows:
                yield "\n".join(rows).strip(JAVA_SPACE), title, level
            rows = []
            if not _PY["contents"].match(stripped):
                title, level = stripped, found
        rows.append(line)
    yield "\n".join(rows).strip(JAVA_SPACE), title, level


def split_text(text: str, limits: Limits) -> list[str]:
    """Parts of a long text: at the best delimiter where one is late enough, else hard; parts are stripped.

    In the reference mode lateness is measured against half of the absolute end, so
    only early cuts can be soft (a blank part stays, so that ordinals match); ``relative`` measures against the part itself.
    """
    out, start, n = [], 0, len(text)
    while start < n:
        end = min(start + limits.max_size, n)
        if end < n:
            bar = start + (end // 2 if limits.break_mode == "reference" else (end - start) // 2)
            for mark in BREAKS:
                at = text.rfind(mark, 0, end + len(mark))
                if at > bar:
                    end = at + len(mark)
                    break
        out.append(text[start:end].strip(JAVA_SPACE))
        start = end
    return out


def split_and_merge(found: Iterator[tuple[str, str, int]], limits: Limits) -> list[tuple[str, str, int]]:
    """Long sections are split, short ones gathered in a buffer that takes the title of its first."""
    out: list[tuple[str, str, int]] = []
    buffer, title, level, filled = "", "", 0, False

    def flush() -> None:
        nonlocal buffer, filled
        text = buffer.strip(JAVA_SPACE)
        if text:
            out.append((text, title, level))
        buffer, filled = "", False

    for text, own_title, own_level in found:
        if len(text) > limits.max_size:
            flush()
            parts = split_text(text, limits)
            if len(parts) > 1 and len(parts[-1]) < limits.min_size:
                last = parts.pop()
                parts[-1] += "\n" + last
            out += [(p, own_title, own_level) for p in parts]
        elif len(text) < limits.min_size:
            if len(buffer) + len(text) > limits.max_size:
                flush()
            if not filled:
                title, level, filled = own_title, own_level, True
            buffer += text + "\n"
        else:
            flush()
            out.append((text, own_title, own_level))
    flush()
    return out


def merge_fragments(chunks: list[tuple[str, str, int]]) -> list[tuple[int, str, str, int]]:
    """(ordinal, text, title, level): fragments join the chunk kept before them, which leaves gaps in the ordinals."""
    kept: list[tuple[int, str, str, int]] = []
    for ordinal, (text, title, level) in enumerate(chunks):
        stripped = text.strip(JAVA_SPACE)
        if kept and (stripped[:1] in FRAGMENT_OPENERS or len(stripped) < FRAGMENT_CHARS):
            o, before, t, v = kept[-1]
            kept[-1] = (o, before + "\n" + stripped, t, v)
        else:
            kept.append((ordinal, text, title, level))
    return kept


def chunk_text(text: str | None, limits: Limits, words: frozenset[str] | set[str]) -> list[tuple[int, str, str, int]]:
    return merge_fragments(split_and_merge(sections_of(text, words), limits)) if text and text.strip(JAVA_SPACE) else []


def structure_aware(df: DataFrame, doc_col: str, text_col: str = "text", path_col: str | None = None, limits: Limits | None = None, words: tuple[str, ...] = HEADING_WORDS) -> DataFrame:
    """Chunks of every document, in ``CHUNK_SCHEMA``; documents without text give none."""
    limits, known = limits or Limits(), frozenset(words)
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    return df.select(F.col(doc_col).cast("string").alias("d"), F.col(text_col).alias("t"), path.alias("p")).mapInArrow(lambda batches: chunk_batches(batches, limits, known), CHUNK_SCHEMA)


def chunk_batches(batches: Iterator[pa.RecordBatch], limits: Limits, known: frozenset[str]) -> Iterator[pa.RecordBatch]:
    """Batches of chunks, each of a slice of a batch of documents (id, text, path)."""
    fields = [x.split() for x in CHUNK_SCHEMA.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32()}

    def made(docs: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            (f"{doc}#{ordinal}", doc, path, part, ordinal, title, level, 0, len(part), "PARAGRAPH")
            for doc, text, path in zip(*(docs.column(i).to_pylist() for i in range(3)), strict=True)
            for ordinal, part, title, level in chunk_text(text, limits, known)
        ]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])

    for batch in batches:
        for start, length in slices(batch.column(1)):
            yield made(batch.slice(start, length))


def fragment_groups(chunks: DataFrame, doc_col: str = "documentId", order_col: str = "ordinal", text_col: str = "text") -> DataFrame:
    """Relational form of ``merge_fragments``: ``doc, ordinal, text``."""
    s = strip(F.col(text_col))
    row = chunks.select(doc_col, order_col, text_col, s.alias("_s"))
    w = Window.partitionBy(doc_col).orderBy(order_col)
    opener = F.substring("_s", 1, 1).isin(*FRAGMENT_OPENERS)
    head = (F.row_number().over(w) == 1) | ~(opener | (F.length("_s") < FRAGMENT_CHARS))
    row = row.withColumn("_head", head)
    row = row.withColumn("_group", F.sum(F.col("_head").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = F.when(F.col("_head"), F.col(text_col)).otherwise(F.col("_s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), part.alias("t")))), lambda x: x["t"]), "\n")
    return row.groupBy(doc_col, "_group").agg(F.min(order_col).alias(order_col), joined.alias(text_col)).drop("_group")


def sentences(c: Column, least: int = SENTENCE_CHARS) -> Column:
    """Sentences of at least ``least`` characters, cut after a sentence end; stripped, empty ones dropped."""
    found = F.regexp_extract_all(c, F.lit(f"(?s)(?:.{{{least - 1},}}?[{SENTENCE_ENDS}]|.+)"), 0)
    return F.filter(F.transform(found, strip), lambda x: x != "")


def fixed_windows(c: Column, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> Column:
    """Overlapping windows of fixed size; the last one ends with the text."""
    Limits(max_size, overlap)
    stride = max_size - overlap
    n = F.length(c)
    count = F.lit(1) + F.ceil(F.greatest(F.lit(0), n - max_size) / stride)
    spans = F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda i: F.substring(c, (i * stride + 1).cast("int"), F.lit(max_size)))
    return F.when(n > 0, spans).otherwise(F.array().cast("array<string>"))


def semantic(df: DataFrame, doc_col: str, text_col: str, embed: Callable[[Column], Column], threshold: float = BOUNDARY, max_size: int = MAX_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``doc, ordinal, text``: sentences joined while neighbours are similar; long blocks become fixed windows."""
    row = df.select(doc_col, F.posexplode(sentences(F.col(text_col))).alias("pos", "s")).withColumn("v", embed(F.col("s")))
    w = Window.partitionBy(doc_col).orderBy("pos")
    cut = F.coalesce(cosine(F.lag("v").over(w), F.col("v")) < threshold, F.lit(False))
    row = row.withColumn("_cut", cut.cast("int")).withColumn("_block", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), "")
    block = row.groupBy(doc_col, "_block").agg(text.alias("text"))
    part = block.select(doc_col, "_block", F.posexplode(F.when(F.length("text") > max_size, fixed_windows(F.col("text"), max_size, overlap)).otherwise(F.array("text"))).alias("_i", "text"))
    order = Window.partitionBy(doc_col).orderBy("_block", "_i")
    return part.select(doc_col, (F.row_number().over(order) - 1).alias("ordinal"), "text")


def with_chunk_ids(chunks: DataFrame, doc_col: str = "documentId", order_col: str = "ordinal") -> DataFrame:
    return chunks.withColumn("id", chunk_id(F.col(doc_col), F.col(order_col)))


def heading_dictionary(rows: list[str]) -> tuple[str, ...]:
    """Words of a dictionary file: one a line, ``#`` opens a comment line, blanks are ignored."""
    return tuple(dict.fromkeys(x.strip() for x in rows if x.strip() and not x.strip().startswith("#")))


REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str, factory: Callable[..., DataFrame]) -> None:
    REGISTRY[name] = factory


def create(name: str) -> Callable[..., DataFrame]:
    """The chunker of a name."""
    if name not in REGISTRY:
        raise LookupError(f"CONFIG_005: no chunking strategy named {name!r}")
    return REGISTRY[name]


def _fixed(df: DataFrame, doc_col: str, text_col: str = "text", path_col: str | None = None, limits: Limits | None = None, **_: object) -> DataFrame:
    limits = limits or Limits()
    part = df.select(F.col(doc_col).cast("string").alias("documentId"), *([F.col(path_col).alias("sourcePath")] if path_col else [F.lit(None).cast("string").alias("sourcePath")]), F.posexplode(fixed_windows(F.col(text_col), limits.max_size, limits.overlap)).alias("ordinal", "text"))
    return part.select(chunk_id(F.col("documentId"), F.col("ordinal")).alias("id"), "documentId", "sourcePath", "text", "ordinal", F.lit("").alias("sectionTitle"), F.lit(0).alias("sectionLevel"), F.lit(0).alias("startPage"), F.length("text").alias("charCount"), F.lit("PARAGRAPH").alias("blockType"))


register("structure_aware", structure_aware)
register("fixed", _fixed)
