"""Registered queries of the document operators, each with the SQL that DuckDB runs on the same tables.

The tables hold no CJK text and no page noise, so a query on a cleaning step
first injects noise, by the same rule on both sides.  Long texts are compared
by their SHA-256.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.vectors import cosine
from ..operators import chunking, cleaning, dedup, embedding, graph, layout, quality
from ..sources import files, sinks
from ..streaming.incremental import document_stream, first_seen, run_available
from . import state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


class Noise:
    """Text before and after every k-th document."""

    def __init__(self, before: str = "", after: str = "", k: int = 2):
        self.before, self.after, self.k = before, after, k

    def column(self) -> Column:
        return F.when(F.col("doc_id") % self.k == 0, F.concat(F.lit(self.before), "text", F.lit(self.after))).otherwise(F.col("text"))

    @property
    def sql(self) -> str:
        return f"CASE WHEN doc_id % {self.k} = 0 THEN {quoted(self.before)} || text || {quoted(self.after)} ELSE text END"


def hashed(spark: SparkSession, sf_dir: str, noise: Noise, step: Callable[[Column], Column]) -> DataFrame:
    out = read(spark, sf_dir, "documents").select("doc_id", noise.column().alias("t")).select("doc_id", step(F.col("t")).alias("c"))
    return out.select("doc_id", F.length("c").cast("long").alias("n"), F.sha2("c", 256).alias("h"))


def hashed_sql(noise: Noise, step: str) -> str:
    """step: SQL over ``t``."""
    return f"SELECT doc_id, CAST(length(c) AS BIGINT) AS n, sha256(c) AS h FROM (SELECT doc_id, {step} AS c FROM (SELECT doc_id, {noise.sql} AS t FROM documents))"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_whitespace(x: str) -> str:
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\r\n?', chr(10), 'g')"
    return sql_strip(rf"regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g')")


TRADITIONAL, SIMPLIFIED = "國學習電話車門馬鳥魚龍書畫東風雲與為這個", "国学习电话车门马鸟鱼龙书画东风云与为这个"
WIDE = Noise("ＡＢＣ　１２３，（ｘ）！", "～＃。", 2)
HAN = Noise(TRADITIONAL, "", 3)
SPACES = Noise(" \t  x  y\r\n\r\n\r\n\r\n", "\n\n\n\n \t", 2)
ZERO = Noise("a​b﻿", "‌‍", 2)
PAGES = Noise("Page 12\n第 3 页\n", "\n- 4 -\n5 / 9\n1234\n12345 x\nend", 2)
LINES = Noise("-----\n", "\n ====== \n***\nx", 2)
MARKS = Noise("好。。。。坏！！！！", "，，，；；", 2)
PRINT = Noise("列印日期/時間：2005\n", "\n本资料来自网络\nQQ：12345678\n打印页数:3\nkept", 2)
WATER = Noise("Mark A\nMark A\nMark A\n", "\nMark A\nMark A\nMark A", 2)
BLOCKS = Noise("first line of it\nsecond line of it\nthird line of it\n" * 3, "\ntail", 2)
HEADINGS = Noise("# Title\nprologue words\n第一章 Opening\n", "\n一、 Part\nContents\n1、 Item\n目录....... 3\nclosing", 2)
MARKUP = Noise("<p>x</p>", "", 7)


@query(f"""SELECT doc_id, h AS content_hash, 'doc-' || substr(h, 1, 12) AS document_id, 'doc-' || substr(h, 1, 12) || '#0' AS first_chunk
FROM (SELECT doc_id, sha256({sql_whitespace("t")}) AS h FROM (SELECT doc_id, {SPACES.sql} AS t FROM documents))""")
def doc_identity(spark, sf_dir):
    h = T.content_hash(T.trim_whitespace(SPACES.column()))
    out = read(spark, sf_dir, "documents").select("doc_id", h.alias("content_hash")).withColumn("document_id", T.document_id(F.col("content_hash")))
    return out.withColumn("first_chunk", T.chunk_id(F.col("document_id"), F.lit(0)))


@query(hashed_sql(WIDE, f"translate(t, {quoted(T._WIDE)}, {quoted(T._NARROW)})"))
def norm_fullwidth(spark, sf_dir):
    return hashed(spark, sf_dir, WIDE, T.fullwidth_to_halfwidth)


@query(hashed_sql(HAN, f"translate(t, '{TRADITIONAL}', '{SIMPLIFIED}')"))
def norm_t2s(spark, sf_dir):
    return hashed(spark, sf_dir, HAN, T.traditional_to_simplified)


@query(hashed_sql(SPACES, sql_whitespace("t")))
def norm_whitespace(spark, sf_dir):
    return hashed(spark, sf_dir, SPACES, T.trim_whitespace)


@query(hashed_sql(WIDE, sql_whitespace(f"translate(translate(t, {quoted(T._WIDE)}, {quoted(T._NARROW)}), '{TRADITIONAL}', '{SIMPLIFIED}')")))
def norm_full(spark, sf_dir):
    return hashed(spark, sf_dir, WIDE, T.normalize)


@query(hashed_sql(ZERO, f"translate(t, {quoted(cleaning.ZERO_WIDTH)}, '')"))
def clean_zero_width(spark, sf_dir):
    return hashed(spark, sf_dir, ZERO, cleaning.remove_zero_width)


@query(hashed_sql(PAGES, rf"regexp_replace(t, {quoted(cleaning.PAGE_NUMBER)}, '', 'g')"))
def clean_page_numbers(spark, sf_dir):
    return hashed(spark, sf_dir, PAGES, cleaning.remove_page_numbers)


@query(hashed_sql(LINES, rf"regexp_replace(t, {quoted(cleaning.SEPARATOR)}, '', 'g')"))
def clean_separators(spark, sf_dir):
    return hashed(spark, sf_dir, LINES, cleaning.remove_separators)


def _punctuation_sql() -> str:
    x = "t"
    for mark in "。！？，；：、":
        x = f"regexp_replace({x}, '{mark}{{3,}}', '{mark}', 'g')"
    return x


@query(hashed_sql(MARKS, _punctuation_sql()))
def clean_repeat_punct(spark, sf_dir):
    return hashed(spark, sf_dir, MARKS, cleaning.collapse_punctuation)


@query()
def clean_repeat_units(spark, sf_dir):
    noise = Noise("ababab xyzxyzxyzxyz\n", "\nhahaha", 2)
    return hashed(spark, sf_dir, noise, lambda c: F.array_join(F.transform(F.split(c, "\n", -1), cleaning.collapse_units), "\n"))


@query(f"""SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, unnest(string_split({WATER.sql}, chr(10))) AS line FROM documents)
WHERE length(line) BETWEEN 1 AND 30 GROUP BY doc_id, line HAVING count(*) >= 5""")
def line_frequency_watermark(spark, sf_dir):
    row = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(WATER.column(), "\n", -1)).alias("line"))
    return row.where(F.length("line").between(1, cleaning.MARK_CHARS)).groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= cleaning.MARK_TIMES)


@query(f"""WITH l AS (SELECT doc_id, string_split({WATER.sql}, chr(10)) AS r FROM documents),
m AS (SELECT doc_id, list(line) AS marks FROM (SELECT doc_id, line FROM (SELECT doc_id, unnest(r) AS line FROM l) WHERE length(line) BETWEEN 1 AND 30 GROUP BY doc_id, line HAVING count(*) >= 5) GROUP BY doc_id)
SELECT doc_id, CAST(len(list_filter(r, lambda x: NOT coalesce(list_contains(marks, x), false))) AS BIGINT) AS n_kept FROM l LEFT JOIN m USING (doc_id)""")
def watermark_lines_removed(spark, sf_dir):
    rows = F.split(WATER.column(), "\n", -1)
    kept = T.let(rows, lambda r: T.let(cleaning.watermarks(r), lambda m: F.size(F.filter(r, lambda x: ~F.array_contains(m, x)))))
    return read(spark, sf_dir, "documents").select("doc_id", kept.cast("long").alias("n_kept"))


@query()
def watermark_composed_lines(spark, sf_dir):
    noise = Noise("AB\nAB\nAB\nAB\nAB\nCDE\nCDE\nCDE\nCDE\nCDE\nABCDE AB\n", "", 2)
    rows = F.split(noise.column(), "\n", -1)
    kept = T.let(rows, lambda r: T.let(cleaning.watermarks(r), lambda m: F.array_join(cleaning.remove_watermarks(r, m), "\n")))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(kept, 256).alias("h"))


@query(f"""WITH l AS (SELECT doc_id, generate_subscripts(r, 1) AS p, unnest(r) AS x FROM (SELECT doc_id, string_split({WATER.sql}, chr(10)) AS r FROM documents)),
g AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM l WHERE x <> ''),
k AS (SELECT doc_id, string_agg(x, chr(10) ORDER BY p) AS c FROM g WHERE b IS NULL OR b <> x GROUP BY doc_id)
SELECT doc_id, sha256(coalesce(c, '')) AS h FROM documents LEFT JOIN k USING (doc_id)""")
def adjacent_line_dedup(spark, sf_dir):
    rows = cleaning.collapse_adjacent(F.split(WATER.column(), "\n", -1))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.array_join(rows, "\n"), 256).alias("h"))


@query(rf"""WITH l AS (SELECT doc_id, len(r) AS n, generate_subscripts(r, 1) AS p, unnest(r) AS x FROM (SELECT doc_id, string_split(regexp_replace({BLOCKS.sql}, '\n+$', ''), chr(10)) AS r FROM documents)),
b AS (SELECT doc_id, p, n, {sql_strip("x")} AS s, {sql_strip("x")} || chr(10) || lead({sql_strip("x")}) OVER w || chr(10) || lead({sql_strip("x")}, 2) OVER w AS block FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY p))
SELECT doc_id, block, count(*) AS n FROM b WHERE s <> '' AND block IS NOT NULL AND length(block) >= 30 GROUP BY doc_id, block HAVING count(*) >= 3""")
def repeated_blocks(spark, sf_dir):
    keys = T.let(T.lines(BLOCKS.column()), cleaning.blocks)
    row = read(spark, sf_dir, "documents").select("doc_id", F.explode(keys).alias("block")).where("block is not null")
    return row.groupBy("doc_id", "block").agg(F.count("*").alias("n")).where(F.col("n") >= cleaning.BLOCK_TIMES)


@query()
def clean_repeated_blocks(spark, sf_dir):
    return hashed(spark, sf_dir, BLOCKS, cleaning.remove_repeated_blocks)


@query(hashed_sql(PRINT, rf"""array_to_string(list_filter(string_split(t, chr(10)), lambda x: NOT (regexp_matches({sql_strip("x")}, {quoted(cleaning.PRINT_MARK)}) OR regexp_matches(x, {quoted(cleaning.DOWNLOAD_MARK)}) OR regexp_matches(x, {quoted(cleaning.CURATOR_MARK)}))), chr(10))"""))
def clean_print_marks(spark, sf_dir):
    return hashed(spark, sf_dir, PRINT, cleaning.remove_print_marks)


@query()
def clean_full(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", PAGES.column().alias("text"))
    return cleaning.clean(docs).select("doc_id", F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("h"))


def _level_sql(s: str) -> str:
    m = lambda p: f"regexp_matches({s}, {quoted(p)})"
    words = ", ".join(quoted(w) for w in chunking.HEADING_WORDS)
    return f"""CASE WHEN {s} IS NULL OR {s} = '' OR length({s}) > 40 OR {m(chunking.LEADERS)} THEN 0
 WHEN {m(chunking.MARKDOWN)} THEN length(regexp_extract({s}, '^#+')) WHEN {s} IN ({words}) THEN 2
 WHEN {m(chunking.CHAPTER)} THEN 1 WHEN {m(chunking.SECTION)} OR {m(chunking.CHINESE_NUMBER)} OR {m(chunking.BRACKETED)} THEN 2
 WHEN {m(chunking.NUMBERED)} OR {m(chunking.DECIMAL)} THEN 3 ELSE 0 END"""


LINE_SQL = rf"""SELECT doc_id, generate_subscripts(r, 1) AS p, unnest(r) AS x FROM (SELECT doc_id, string_split(regexp_replace({HEADINGS.sql}, '\n+$', ''), chr(10)) AS r FROM documents)"""


@query(f"SELECT doc_id, CAST(level AS INTEGER) AS level, count(*) AS n FROM (SELECT doc_id, {_level_sql('s')} AS level FROM (SELECT doc_id, {sql_strip('x')} AS s FROM ({LINE_SQL}))) GROUP BY doc_id, level")
def heading_levels(spark, sf_dir):
    row = read(spark, sf_dir, "documents").select("doc_id", F.explode(T.lines(HEADINGS.column())).alias("x"))
    return row.groupBy("doc_id", chunking.heading_level(T.strip(F.col("x"))).alias("level")).agg(F.count("*").alias("n"))


SECTION_SQL = rf"""WITH l AS (SELECT doc_id, p, x, {sql_strip("x")} AS s FROM ({LINE_SQL})),
v AS (SELECT *, {_level_sql("s")} AS lv FROM l),
r AS (SELECT doc_id, p, x, sum(CASE WHEN lv > 0 THEN 1 ELSE 0 END) OVER w AS section,
  last_value(CASE WHEN lv > 0 AND NOT regexp_matches(s, {quoted(chunking.CONTENTS_TITLE)}) THEN s END IGNORE NULLS) OVER w AS title,
  last_value(CASE WHEN lv > 0 AND NOT regexp_matches(s, {quoted(chunking.CONTENTS_TITLE)}) THEN lv END IGNORE NULLS) OVER w AS level
  FROM v WINDOW w AS (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING)),
sec AS (SELECT doc_id, CAST(section AS INTEGER) AS section, coalesce(max(title), '') AS title, CAST(coalesce(max(level), 0) AS INTEGER) AS level, {sql_strip("string_agg(x, chr(10) ORDER BY p)")} AS text
  FROM r GROUP BY doc_id, section)"""


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sections(read(spark, sf_dir, "documents").select("doc_id", HEADINGS.column().alias("text")), "doc_id")


@query(SECTION_SQL + " SELECT doc_id, section, title, level, sha256(text) AS h FROM sec WHERE text <> ''")
def sections(spark, sf_dir):
    return _sections(spark, sf_dir).select("doc_id", "section", "title", "level", F.sha2("text", 256).alias("h"))


@query()
def chunks_structure_aware(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", HEADINGS.column().alias("text"))
    out = chunking.structure_aware(docs, "doc_id", "text", "source")
    return out.select("id", "documentId", "ordinal", "sectionTitle", "sectionLevel", "charCount", F.sha2("text", 256).alias("h"))


@query()
def split_large(spark, sf_dir):
    limits = chunking.Limits(300, 0, 0)
    out = chunking.structure_aware(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", limits=limits)
    return out.groupBy("documentId").agg(F.count("*").alias("n"), F.sum("charCount").alias("chars"))


@query(rf"""WITH l AS (SELECT doc_id, generate_subscripts(r, 1) - 1 AS p, unnest(r) AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS r FROM documents)),
h AS (SELECT *, {sql_strip("x")} AS s, row_number() OVER (PARTITION BY doc_id ORDER BY p) = 1 OR NOT (substr({sql_strip("x")}, 1, 1) IN ({", ".join(quoted(c) for c in chunking.FRAGMENT_OPENERS)}) OR length({sql_strip("x")}) < 30) AS head FROM l),
g AS (SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS grp FROM h)
SELECT doc_id, CAST(min(p) AS INTEGER) AS ordinal, sha256(string_agg(CASE WHEN head THEN x ELSE s END, chr(10) ORDER BY p)) AS h FROM g GROUP BY doc_id, grp""")
def fragment_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("ordinal", "text"))
    return chunking.fragment_groups(rows, "doc_id").select("doc_id", "ordinal", F.sha2("text", 256).alias("h"))


@query(rf"""SELECT doc_id, CAST(len(s) AS BIGINT) AS n, sha256(array_to_string(s, '|')) AS h FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '(?s)(?:.{{19,}}?[。！？!?\n]|.+)'), lambda x: {sql_strip("x")}), lambda x: x <> '') AS s FROM documents)""")
def sentences(spark, sf_dir):
    s = chunking.sentences(F.col("text"))
    return read(spark, sf_dir, "documents").select("doc_id", F.size(s).cast("long").alias("n"), F.sha2(F.array_join(s, "|"), 256).alias("h"))


WINDOW_SQL = "list_transform(range(0, 1 + CAST(ceil(greatest(0, length({0}) - 500) / 450.0) AS BIGINT)), lambda i: substr({0}, i * 450 + 1, 500))"


@query(f"SELECT doc_id, CAST(i AS INTEGER) AS i, sha256(list_extract(w, i + 1)) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM (SELECT doc_id, {WINDOW_SQL.format('text')} AS w FROM documents WHERE length(text) > 0))")
def fixed_windows(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.fixed_windows(F.col("text"))).alias("i", "w")).select("doc_id", "i", F.sha2("w", 256).alias("h"))


@query(f"""SELECT conv_id, CAST(len(w) AS BIGINT) AS n, sha256(array_to_string(w, '|')) AS h FROM (SELECT conv_id, {WINDOW_SQL.format('t')} AS w FROM
(SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) AS t FROM conversations GROUP BY conv_id) WHERE length(t) > 0)""")
def conversation_chunks(spark, sf_dir):
    row = read(spark, sf_dir, "conversations").where("role is not null and text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("x"))
    t = row.select("conv_id", F.array_join(F.transform("x", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("t")).where(F.length("t") > 0)
    w = t.select("conv_id", chunking.fixed_windows(F.col("t")).alias("w"))
    return w.select("conv_id", F.size("w").cast("long").alias("n"), F.sha2(F.array_join("w", "|"), 256).alias("h"))


@query(f"""WITH d AS (SELECT doc_id, sha256({sql_whitespace("text")}) AS h FROM documents), f AS (SELECT h, min(doc_id) AS first_id FROM d GROUP BY h)
SELECT doc_id, doc_id <> first_id AS is_duplicate, CASE WHEN doc_id <> first_id THEN first_id END AS duplicate_of FROM d JOIN f USING (h)""")
def exact_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", T.content_hash(T.trim_whitespace(F.col("text"))).alias("contentHash"))
    out = dedup.first_by_hash(docs, "contentHash", "doc_id", "doc_id")
    return out.select("doc_id", F.col("isDuplicate").alias("is_duplicate"), F.col("duplicateOf").alias("duplicate_of"))


GRAM_SQL = "CASE WHEN length({0}) < 3 THEN [{0}] ELSE list_distinct(list_transform(range(1, length({0}) - 1), lambda i: substr({0}, i, 3))) END"


@query(f"SELECT doc_id, CAST(len({GRAM_SQL.format('text')}) AS BIGINT) AS n_grams FROM documents")
def ngram_stats(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(dedup.grams(F.col("text"))).cast("long").alias("n_grams"))


@query(f"""WITH s AS (SELECT item_id, {GRAM_SQL.format("text")} AS g FROM benchmark),
e AS (SELECT item_id, unnest(g) AS x FROM s),
c AS (SELECT a.item_id AS a, b.item_id AS b, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.item_id < b.item_id GROUP BY 1, 2)
SELECT a, b, round(k / (len(p.g) + len(q.g) - k), 6) AS similarity FROM c JOIN s p ON p.item_id = a JOIN s q ON q.item_id = b WHERE k / (len(p.g) + len(q.g) - k) >= 0.3""")
def jaccard_pairs(spark, sf_dir):
    return dedup.similar_pairs(read(spark, sf_dir, "benchmark"), "item_id", "text", 0.3).withColumn("similarity", F.round("similarity", 6))


@query()
def near_dup_leaders(spark, sf_dir):
    return dedup.near_duplicates(read(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""WITH d AS (SELECT doc_id, {GRAM_SQL.format("text")} AS g FROM documents), i AS (SELECT item_id, {GRAM_SQL.format("text")} AS g FROM benchmark),
x AS (SELECT doc_id, unnest(g) AS t FROM d), y AS (SELECT item_id, unnest(g) AS t FROM i),
c AS (SELECT doc_id, item_id, count(*) AS k FROM x JOIN y USING (t) GROUP BY 1, 2)
SELECT doc_id, item_id, round(k / (len(d.g) + len(i.g) - k), 6) AS similarity FROM c JOIN d USING (doc_id) JOIN i USING (item_id) WHERE k / (len(d.g) + len(i.g) - k) >= 0.4""")
def benchmark_overlap(spark, sf_dir):
    c = dedup.overlaps(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), "doc_id", "item_id", "text", 0.4)
    s = F.col("k") / (F.col("m") + F.col("n") - F.col("k"))
    return c.where(s >= 0.4).select("doc_id", "item_id", F.round(s, 6).alias("similarity"))


BROKEN = Noise("", "�" * 40, 5)


@query(f"""SELECT doc_id, n_chars, n_replaced, marked OR coalesce(n_replaced / nullif(n_chars, 0), 0) > 0.02 AS garbled FROM (
SELECT doc_id, CAST(sum(length(x)) AS BIGINT) AS n_chars, CAST(sum(length(x) - length(replace(x, '�', ''))) AS BIGINT) AS n_replaced, bool_or(contains(x, 'bjbj')) AS marked
FROM (SELECT doc_id, unnest(string_split(CASE WHEN doc_id % 11 = 0 THEN 'bjbj' || text ELSE {BROKEN.sql} END, chr(10))) AS x FROM documents) GROUP BY doc_id)""")
def garbled_gate(spark, sf_dir):
    t = F.when(F.col("doc_id") % 11 == 0, F.concat(F.lit("bjbj"), "text")).otherwise(BROKEN.column())
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id"), F.explode(F.split(t, "\n", -1)).alias("text"))
    return quality.garbled(chunks, "doc_id").drop("n_chunks")


STATE_SQL = """SELECT 'job-1' AS job_id, 'f' || doc_id AS file_path, stage, CASE WHEN (doc_id + k) % 5 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status
FROM documents, (VALUES ('INGEST', 0), ('CLEAN', 1), ('SINK', 2)) AS s(stage, k) WHERE (doc_id + k) % 7 <> 0"""


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    stages = F.array(*(F.struct(F.lit(s).alias("stage"), F.lit(k).alias("k")) for k, s in enumerate(("INGEST", "CLEAN", "SINK"))))
    row = read(spark, sf_dir, "documents").select("doc_id", F.explode(stages).alias("s")).select("doc_id", "s.*").where((F.col("doc_id") + F.col("k")) % 7 != 0)
    status = F.when((F.col("doc_id") + F.col("k")) % 5 == 0, "FAILED").otherwise("SUCCESS")
    return row.select(F.lit("job-1").alias("job_id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"), "stage", status.alias("status"))


@query(f"WITH s AS ({STATE_SQL}) SELECT doc_id, 'f' || doc_id AS file_path FROM documents WHERE 'f' || doc_id NOT IN (SELECT file_path FROM s WHERE status = 'SUCCESS' GROUP BY file_path HAVING count(DISTINCT stage) = 3)")
def resume_pending(spark, sf_dir):
    listed = read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("file_path"))
    return quality.pending(listed, _state(spark, sf_dir))


@query(f"WITH s AS ({STATE_SQL}) SELECT job_id, file_path, " + ", ".join(f"max(CASE WHEN stage = '{s}' THEN status END) AS \"{s}\"" for s in state.STAGES) + " FROM s GROUP BY job_id, file_path")
def stage_pivot(spark, sf_dir):
    return state.by_stage(_state(spark, sf_dir))


@query(f"WITH s AS ({STATE_SQL}) SELECT job_id, file_path, arg_max(stage, CASE stage WHEN 'INGEST' THEN 1 WHEN 'CLEAN' THEN 2 WHEN 'EMBED' THEN 3 ELSE 4 END) AS stage FROM s WHERE status = 'SUCCESS' GROUP BY job_id, file_path")
def last_completed_stage(spark, sf_dir):
    return state.last_completed(_state(spark, sf_dir))


@query(f"WITH s AS ({STATE_SQL}) SELECT stage, CASE stage WHEN 'INGEST' THEN 'PARSE_001' WHEN 'CLEAN' THEN 'CLEAN_002' ELSE 'SINK_003' END AS \"errorCode\", count(*) AS n_failures, count(DISTINCT file_path) AS n_files FROM s WHERE status = 'FAILED' GROUP BY stage")
def failure_report(spark, sf_dir):
    code = F.when(F.col("stage") == "INGEST", "PARSE_001").when(F.col("stage") == "CLEAN", "CLEAN_002").otherwise("SINK_003")
    failures = _state(spark, sf_dir).where("status = 'FAILED'").select(F.col("file_path").alias("filePath"), "stage", code.alias("errorCode"))
    return state.failure_report(failures)


@query(f"WITH s AS ({STATE_SQL}), f AS (SELECT file_path, count(*) FILTER (WHERE status = 'FAILED') AS bad FROM s GROUP BY file_path) SELECT (SELECT count(*) FROM documents) AS total_files, count(*) FILTER (WHERE bad = 0) AS succeeded, count(*) FILTER (WHERE bad > 0) AS failed, (SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) FROM documents) AS total_chunks FROM f")
def processing_report(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").agg(F.count("*").alias("total_files"), F.sum(F.size(F.split("text", "\n", -1)).cast("long")).alias("total_chunks"))
    bad = _state(spark, sf_dir).groupBy("file_path").agg(F.max((F.col("status") == "FAILED").cast("int")).alias("bad"))
    return bad.agg(F.sum(1 - F.col("bad")).alias("succeeded"), F.sum("bad").cast("long").alias("failed")).crossJoin(docs)


VEC_SQL = "CAST(embedding AS DOUBLE[])"


@query(f"""SELECT vec_id, round(list_cosine_similarity(v, b), 6) AS similarity, list_cosine_similarity(v, b) < 0.7 AS boundary FROM (SELECT vec_id, v, lag(v) OVER (ORDER BY vec_id) AS b FROM (SELECT vec_id, {VEC_SQL} AS v FROM embeddings)) WHERE b IS NOT NULL""")
def adjacent_similarity_boundary(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = rows.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("b"))  # ids are consecutive, so a join replaces a global window
    s = cosine(F.col("embedding"), F.col("b"))
    return rows.join(before, "vec_id").select("vec_id", F.round(s, 6).alias("similarity"), (s < chunking.BOUNDARY).alias("boundary"))


@query(f"SELECT vec_id, round(1 - list_cosine_similarity({VEC_SQL}, [{', '.join('1.0' if i % 2 else '-0.5' for i in range(64))}]), 6) AS distance FROM embeddings ORDER BY 1 - list_cosine_similarity({VEC_SQL}, [{', '.join('1.0' if i % 2 else '-0.5' for i in range(64))}]), vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    out = embedding.top_k(rows, [1.0 if i % 2 else -0.5 for i in range(64)], 10)
    return out.select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query(f"""WITH e AS (SELECT vec_id, {VEC_SQL} AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, list_cosine_similarity(r.v, q.v) AS c FROM e q, e r WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(c, 6) AS similarity, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, id) AS k FROM s) WHERE k <= 5""")
def vector_topk_per_query(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    out = embedding.top_k_per_query(rows, queries, 5, "vec_id")
    return out.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query()
def vector_literal(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", T.vector_literal(F.col("embedding")).alias("literal"))


@query()
def embedded_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    chunks = chunking.structure_aware(docs, "doc_id")
    out = embedding.embedded_chunks(chunks, embedding.embedder(embedding.HashingProvider(16)))
    return out.select("id", "documentId", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 3).alias("norm"), F.size("metadata").alias("n_meta"))


@query()
def chunks_semantic(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = chunking.semantic(docs, "doc_id", "text", embedding.embedder(embedding.HashingProvider(16)), 0.2)
    return out.select("doc_id", "ordinal", F.sha2("text", 256).alias("h"))


@query()
def html_text(spark, sf_dir):
    x = files.html_to_text(F.col("html"))
    return read(spark, sf_dir, "pages").select("page_id", x.alias("x")).select("page_id", F.length("x.text").cast("long").alias("n"), F.sha2("x.text", 256).alias("h"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages")
def html_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", files.html_title(F.col("html")).alias("title"))


@query(r"SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'html' WHEN regexp_matches(url, '\.[^./\\]+$') THEN lower(regexp_extract(url, '\.([^./\\]+)$', 1)) ELSE 'unknown' END AS format FROM pages")
def file_format_label(spark, sf_dir):
    mime = F.when(F.col("page_id") % 3 == 0, "text/html")
    return read(spark, sf_dir, "pages").select("page_id", T.format_label(mime, F.col("url")).alias("format"))


@query(r"SELECT page_id, CASE WHEN regexp_matches(b, '^.+\.[^.]*$') THEN regexp_replace(b, '\.[^.]*$', '') ELSE b END AS stem FROM (SELECT page_id, regexp_extract(url, '([^/\\]*)$', 1) AS b FROM pages)")
def file_stem(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", T.file_stem(F.col("url")).alias("stem"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'UTF-8' WHEN doc_id % 3 = 1 THEN 'UTF-16LE' ELSE 'UTF-8' END AS encoding FROM documents")
def encoding_detect(spark, sf_dir):
    mark = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.lit("EFBBBF"))).when(F.col("doc_id") % 3 == 1, F.unhex(F.lit("FFFE"))).otherwise(F.unhex(F.lit("")))
    return read(spark, sf_dir, "documents").select("doc_id", T.detect_encoding(F.concat(mark, F.col("text").cast("binary"))).alias("encoding"))


@query(r"""SELECT doc_id, sha256(regexp_replace('api_key: abc' || doc_id || ' ' || text, '(?i)((?:api_?key|password)\w*["'']?\s*[:=]\s*["'']?)[^\s"'',}]+', '\1****', 'g')) AS h FROM documents""")
def secret_masking(spark, sf_dir):
    t = F.concat(F.lit("api_key: abc"), F.col("doc_id").cast("string"), F.lit(" "), "text")
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.mask_secrets(t), 256).alias("h"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS "documentId", sha256(text) AS h, 0 AS version FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), sha256('new ' || text), 1 FROM documents WHERE doc_id % 4 = 0""")
def jsonl_roundtrip_replace(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    key = F.col("doc_id").cast("string").alias("documentId")
    old = docs.select(key, "text", F.lit(0).alias("version"))
    new = docs.where("doc_id % 4 = 0").select(key, F.concat(F.lit("new "), "text").alias("text"), F.lit(1).alias("version"))
    return sinks.replaced(old, new).select("documentId", F.sha2("text", 256).alias("h"), "version")


@query(SECTION_SQL + """, o AS (SELECT *, CASE WHEN trim(title) <> '' AND coalesce(lag(title) OVER (PARTITION BY doc_id ORDER BY section) = title, false) = false
 THEN (CASE WHEN starts_with(title, '#') THEN title ELSE repeat('#', greatest(1, level)) || ' ' || title END) || chr(10) || chr(10) ELSE '' END || text || chr(10) || chr(10) AS b FROM sec WHERE text <> '')
SELECT CAST(doc_id AS VARCHAR) AS "documentId", sha256(string_agg(b, '' ORDER BY section)) AS h FROM o GROUP BY doc_id""")
def markdown_render(spark, sf_dir):
    s = _sections(spark, sf_dir)
    chunks = s.select(F.col("doc_id").cast("string").alias("documentId"), F.lit(None).cast("string").alias("sourcePath"), F.col("section").alias("ordinal"), F.col("title").alias("sectionTitle"), F.col("level").alias("sectionLevel"), "text", F.lit("").alias("id"), F.lit(0).alias("startPage"), F.lit(0).alias("charCount"))
    return sinks.markdown(chunks).select("documentId", F.sha2("markdown", 256).alias("h"))


@query("SELECT doc_id, source, n_chars FROM documents ORDER BY source, doc_id LIMIT 50 OFFSET 100")
def chunk_page(spark, sf_dir):
    return sinks.page(read(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), 3, 50, ("source", "doc_id"))


NAMES = {"Apache": "物品", "License": "物品", "the": "概念", "and": "概念", "Version 2.0": "概念"}
ENTITY_SQL = f"""WITH w(name, type) AS (VALUES {", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in NAMES.items())}),
h AS (SELECT CAST(doc_id AS VARCHAR) AS "chunkId", doc_id, name, type, instr(text, name) AS at_ FROM documents, w WHERE contains(text, name)),
e AS (SELECT "chunkId", doc_id, name, type, CAST(row_number() OVER (PARTITION BY "chunkId" ORDER BY at_, name) - 1 AS INTEGER) AS pos, 'ent-' || substr(sha256(name), 1, 12) AS id FROM h)"""


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return graph.chunk_entities(graph.dictionary_entities(chunks, NAMES))


@query(ENTITY_SQL + ' SELECT "chunkId", id, name, type, pos FROM e')
def entities_dictionary(spark, sf_dir):
    return _entities(spark, sf_dir).select("chunkId", "id", "name", "type", "pos")


@query(ENTITY_SQL + ' SELECT id, min(name) AS name, min(type) AS type, name AS "normalizedKey" FROM e GROUP BY id, name')
def entity_merge(spark, sf_dir):
    rows = _entities(spark, sf_dir).withColumn("chunkOrder", F.col("chunkId").cast("long"))
    return graph.merge_entities(rows).select("id", "name", "type", "normalizedKey")


RELATION_SQL = ENTITY_SQL + """, r AS (SELECT s."chunkId" AS source, s.id AS a, t.id AS b, 'rel-' || substr(sha256(s.id || t.id || '相关'), 1, 12) AS id
 FROM e s JOIN e t ON s."chunkId" = t."chunkId" AND s.name = 'the' AND t.name IN ('and', 'License'))"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _entities(spark, sf_dir)
    found = e.where("name = 'the'").select("chunkId", F.col("name").alias("source"), F.explode(F.array(F.lit("and"), F.lit("License"), F.lit("absent"))).alias("target"), F.lit("相关").alias("type"), F.lit(None).cast("double").alias("confidence"))
    return graph.resolve_relations(found, e)


@query(RELATION_SQL + ' SELECT id, a AS "sourceEntityId", b AS "targetEntityId", \'相关\' AS type, source, 0.8::DOUBLE AS confidence FROM r')
def relations_resolved(spark, sf_dir):
    return _relations(spark, sf_dir)


@query(RELATION_SQL + ", d AS (SELECT DISTINCT a, b, id FROM r) SELECT x AS id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT a AS x, 1 AS o, 0 AS i FROM d UNION ALL SELECT b, 0, 1 FROM d) GROUP BY x")
def graph_degree(spark, sf_dir):
    e = _entities(spark, sf_dir)
    return graph.degrees(graph.valid_edges(_relations(spark, sf_dir), e))


GLYPH_SQL = """g AS (SELECT l_orderkey AS doc, l_linenumber % 2 AS page, l_linenumber AS seq, CAST((l_partkey * 7) % 600 AS DOUBLE) AS x, CAST((l_suppkey * 37) % 800 AS DOUBLE) AS y, CAST(10 + l_linenumber % 3 AS DOUBLE) AS "fontSize", l_returnflag AS text FROM lineitem)"""


def _glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("doc"), (c("l_linenumber") % 2).alias("page"), c("l_linenumber").alias("seq"), ((c("l_partkey") * 7) % 600).cast("double").alias("x"),
        ((c("l_suppkey") * 37) % 800).cast("double").alias("y"), (10 + c("l_linenumber") % 3).cast("double").alias("fontSize"), c("l_returnflag").alias("text"),
    )


@query(f"""WITH {GLYPH_SQL} SELECT doc, l > 0.20 AND r > 0.20 AND 1 - l - r < 0.15 - 1e-12 AS "twoColumn" FROM (SELECT doc, avg(CASE WHEN x < 255 THEN 1 ELSE 0 END) AS l, avg(CASE WHEN x > 345 THEN 1 ELSE 0 END) AS r FROM g GROUP BY doc)""")
def layout_two_column(spark, sf_dir):
    return layout.two_columns(_glyphs(spark, sf_dir), 600.0)


@query(f"""WITH {GLYPH_SQL} SELECT doc, page, seq, CASE WHEN y > 760 THEN 'HEADER' ELSE 'FOOTER' END AS type FROM g WHERE y > 760 OR y < 40""")
def layout_regions(spark, sf_dir):
    return layout.margin_regions(_glyphs(spark, sf_dir), 800.0).select("doc", "page", "seq", "type")


@query(f"""WITH {GLYPH_SQL}, m AS (SELECT doc, max("fontSize") AS a FROM g GROUP BY doc), n AS (SELECT g.doc, max("fontSize") AS b FROM g JOIN m ON g.doc = m.doc WHERE "fontSize" < a - 0.5 GROUP BY g.doc)
SELECT g.doc, page, seq, CASE WHEN abs("fontSize" - a) <= 0.5 THEN 'H1' ELSE 'H2' END AS type FROM g JOIN m ON g.doc = m.doc LEFT JOIN n ON g.doc = n.doc WHERE abs("fontSize" - a) <= 0.5 OR abs("fontSize" - b) <= 0.5""")
def layout_headings(spark, sf_dir):
    return layout.heading_regions(_glyphs(spark, sf_dir)).select("doc", "page", "seq", "type")


@query(rf"""WITH {GLYPH_SQL}, p AS (SELECT doc, page, coalesce(string_agg(text, '' ORDER BY y DESC, seq, text) FILTER (WHERE x < 300), '') || chr(10) || coalesce(string_agg(text, '' ORDER BY y DESC, seq, text) FILTER (WHERE x >= 300), '') || chr(10) AS t FROM g GROUP BY doc, page)
SELECT doc, {sql_strip("string_agg(t, '' ORDER BY page)")} AS text FROM p GROUP BY doc""")
def two_column_text(spark, sf_dir):
    return layout.column_text(_glyphs(spark, sf_dir), 600.0)


@query("SELECT o_orderkey AS doc, (o_custkey % 40) > 0 AND floor((o_orderkey % 300) / nullif(o_custkey % 40, 0)) < 10 AS scanned FROM orders")
def scanned_pdf_flag(spark, sf_dir):
    chars, pages = F.col("o_orderkey") % 300, F.col("o_custkey") % 40
    flag = (pages > 0) & layout.is_scanned(chars, F.when(pages > 0, pages).otherwise(1))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), flag.alias("scanned"))


@query("""WITH p AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS page, (l_partkey % 10) / 10.0 AS share, l_suppkey % 3 AS images, l_partkey % 150 AS chars FROM lineitem),
n AS (SELECT doc, count(*) AS n, sum(chars) AS chars, least(5, count(*)) AS k FROM p GROUP BY doc),
s AS (SELECT n.*, unnest(list_transform(range(0, k), lambda i: CAST(floor(i * n / k) AS BIGINT))) AS page FROM n)
SELECT s.doc, any_value(s.chars) <= 500 AND any_value(n) <= 100 AND count(*) FILTER (WHERE images >= 1 AND share > 0.3) > floor(count(*) / 2) AS "imageBased" FROM s LEFT JOIN p ON p.doc = s.doc AND p.page = s.page GROUP BY s.doc""")
def image_pdf_flag(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    pages = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), (F.row_number().over(w) - 1).cast("long").alias("page"), F.lit(10).alias("pageArea"), (F.col("l_partkey") % 10).alias("imageArea"), (F.col("l_suppkey") % 3).alias("imageCount"), (F.col("l_partkey") % 150).alias("chars")
    )
    return layout.image_based(pages)


@query(f"SELECT DISTINCT sha256({sql_whitespace('text')}) AS content_hash FROM documents")
def streaming_first_seen(spark, sf_dir):
    """Documents as a stream of files; each content is let through once."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docforge-"))
    base = f"{sc.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    schema = read(spark, sf_dir, "documents").schema
    stream = first_seen(document_stream(spark, f"{sf_dir}/documents.parquet", schema), "text")
    run_available(stream.select(F.col("contentHash").alias("content_hash")), lambda df, _: df.write.mode("append").parquet(f"{base}/out"), f"{base}/state").awaitTermination()
    return spark.read.schema("content_hash string").parquet(f"{base}/out")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, identify, drop exact duplicates, clean, and count the sections of every document."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", T.normalize(F.col("text")).alias("text"))
    docs = docs.withColumn("contentHash", T.content_hash(F.col("text")))
    kept = dedup.first_by_hash(docs, "contentHash", "doc_id", "doc_id").where(~F.col("isDuplicate"))
    chunks = chunking.sections(cleaning.clean(kept.select("doc_id", "text")), "doc_id")
    return chunks.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum(F.length("text")).alias("n_chars"))
