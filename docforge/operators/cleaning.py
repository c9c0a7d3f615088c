"""Cleaning steps: Column to Column, native, in a replaceable order.

Steps on lines work on the array of a text's lines.  What repeats within a
text is found by sorting the array and looking a fixed number of places ahead,
which is O(n log n) and needs no exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, lines, normalize, strip

# Patterns, phrases and limits that decide what is noise.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
PAGE_NUMBER = r"(?mi)^\s*(第\s*\d+\s*页|Page\s*\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|\d{1,4})\s*\r?\n?"
PAGE_NUMBER_LINE = r"(?mi)^\s*(第\s*\d+\s*页|Page\s*\d+|-\s*\d+\s*-|\d+\s*/\s*\d+|\d{1,4})\s*$\r?\n?"
SEPARATOR = r"(?m)^\s*[-=*~_]{5,}\s*$"
REPEATED_PUNCTUATION = r"([。！？，；：、])\1{2,}"
PRINT_MARK = r"^(列印|打印)\s*(日期|页数|頁數|时间|時間)(\s*/\s*(时间|時間))?\s*[：:].*$"
DOWNLOAD_MARK = "(知盈医学|豆丁网|道客巴巴|百度文库|万部医学书籍|下载器所生成|更多资料|本资料来自)"
CURATOR_MARK = r"(QQ[：:]?\s*\d{5,12}|整理与配图|第\s*\d+\s*页\s*共\s*\d+\s*页)"
BLOCK_CHARS, BLOCK_LINES, BLOCK_TIMES, BLOCK_LEAST_LINES = 30, 3, 3, 6
MARK_CHARS, MARK_TIMES, MARK_PART = 30, 5, 2
UNIT_CHARS, UNIT_TIMES, UNIT_LINE = 8, 3, 4

Step = Callable[[Column], Column]


def remove_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH, "")


def remove_page_numbers(c: Column, strict: bool = False) -> Column:
    """Delete page numbers at line starts; strict: only where they fill the line."""
    return F.regexp_replace(c, PAGE_NUMBER_LINE if strict else PAGE_NUMBER, "")


def remove_separators(c: Column) -> Column:
    return F.regexp_replace(c, SEPARATOR, "")


def collapse_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, REPEATED_PUNCTUATION, "$1")


def frequent(values: Column, times: int) -> Column:
    """Distinct non-null values of an array that occur at least so often."""
    return let(
        F.array_sort(F.filter(values, lambda x: x.isNotNull())),
        lambda s: F.array_distinct(F.filter(s, lambda x, i: F.coalesce(F.get(s, i + (times - 1)) == x, F.lit(False)))),
    )


def blocks(rows: Column) -> Column:
    """The block of three stripped lines that starts at each line, or null where it does not count."""

    def block(x: Column, i: Column) -> Column:
        text = F.concat_ws("\n", strip(x), strip(F.get(rows, i + 1)), strip(F.get(rows, i + 2)))
        long_enough = (i + BLOCK_LINES <= F.size(rows)) & (strip(x) != "")
        return F.when(long_enough, F.when(F.length(text) >= BLOCK_CHARS, text))

    return F.transform(rows, block)


def remove_repeated_blocks(c: Column) -> Column:
    """Keep the first of every three-line block that occurs three times or more."""

    def scan(rows: Column, keys: Column, often: Column) -> Column:
        start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

        def step(s: Column, p: Column) -> Column:
            again = (s["skip"] == 0) & F.array_contains(often, p["k"]) & F.array_contains(s["seen"], p["k"])
            fresh = (s["skip"] == 0) & F.array_contains(often, p["k"]) & ~F.array_contains(s["seen"], p["k"])
            again, fresh = F.coalesce(again, F.lit(False)), F.coalesce(fresh, F.lit(False))
            return F.struct(
                F.when(again, F.lit(BLOCK_LINES - 1)).when(s["skip"] > 0, s["skip"] - 1).otherwise(F.lit(0)).alias("skip"),
                F.when(fresh, F.concat(s["seen"], F.array(p["k"]))).otherwise(s["seen"]).alias("seen"),
                F.when(again | (s["skip"] > 0), s["out"]).otherwise(F.concat(s["out"], F.array(p["x"]))).alias("out"),
            )

        pairs = F.zip_with(rows, keys, lambda x, k: F.struct(x.alias("x"), k.alias("k")))
        return F.aggregate(pairs, start, step, lambda s: F.array_join(s["out"], "\n"))

    def body(rows: Column) -> Column:
        return let(blocks(rows), lambda keys: let(frequent(keys, BLOCK_TIMES), lambda often: F.when(F.size(often) == 0, c).otherwise(scan(rows, keys, often))))

    return let(lines(c), lambda rows: F.when(F.size(rows) < BLOCK_LEAST_LINES, c).otherwise(body(rows)))


def _unit_pattern() -> str:
    """A unit of up to UNIT_CHARS characters, not blank, three times or more: one branch for each run of leading space."""
    branches = [rf"\p{{javaWhitespace}}{{{k}}}\P{{javaWhitespace}}(?s:.){{0,{UNIT_CHARS - 1 - k}}}" for k in range(UNIT_CHARS)]
    return "(" + "|".join(branches) + rf")\1{{{UNIT_TIMES - 1},}}"


UNIT = _unit_pattern()


def collapse_units(line: Column) -> Column:
    """Within one stripped line, a unit repeated three times or more is kept once."""
    s = strip(line)
    return F.when(F.length(s) >= UNIT_LINE, F.regexp_replace(s, UNIT, "$1")).otherwise(s)


def watermarks(rows: Column, times: int = MARK_TIMES) -> Column:
    """Short lines that occur often."""
    return frequent(F.filter(rows, lambda x: (F.length(x) >= 1) & (F.length(x) <= MARK_CHARS)), times)


def remove_watermarks(rows: Column, marks: Column) -> Column:
    """Drop watermark lines and short lines made of watermarks only (longest removed first)."""
    parts = F.array_sort(F.filter(marks, lambda m: F.length(m) >= MARK_PART), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))

    def composed(line: Column, parts: Column) -> Column:
        rest = F.aggregate(parts, line, lambda acc, m: F.replace(acc, m, F.lit("")))
        return (F.length(line) <= MARK_CHARS) & (strip(rest) == "") & (line != "")

    return let(parts, lambda p: F.filter(rows, lambda x: ~F.array_contains(marks, x) & ~composed(x, p)))


def collapse_adjacent(rows: Column) -> Column:
    """Drop empty lines, then lines equal to the one kept before."""
    return let(F.filter(rows, lambda x: x != ""), lambda r: F.filter(r, lambda x, i: (i == 0) | (F.get(r, i - 1) != x)))


def clean_lines(c: Column, times: int = MARK_TIMES) -> Column:
    """Unit compression, watermarks and adjacent duplicates."""
    rows = F.transform(F.split(c, "\n", -1), collapse_units)
    return let(rows, lambda r: let(watermarks(r, times), lambda m: F.array_join(collapse_adjacent(remove_watermarks(r, m)), "\n")))


def remove_print_marks(c: Column) -> Column:
    kept = F.filter(F.split(c, "\n", -1), lambda x: ~(strip(x).rlike(PRINT_MARK) | x.rlike(DOWNLOAD_MARK) | x.rlike(CURATOR_MARK)))
    return F.array_join(kept, "\n")


def steps(page_number_mode: str = "reference", watermark_times: int = MARK_TIMES, **flags: bool) -> dict[str, Step]:
    """The default chain, by name and in order; flags go to ``normalize``."""
    return {
        "zero_width": remove_zero_width,
        "page_numbers": lambda c: remove_page_numbers(c, page_number_mode == "strict"),
        "separators": remove_separators,
        "punctuation": collapse_punctuation,
        "normalize": lambda c: normalize(c, **flags),
        "repeated_blocks": remove_repeated_blocks,
        "lines": lambda c: clean_lines(c, watermark_times),
        "print_marks": remove_print_marks,
    }


def clean(df: DataFrame, text_col: str = "text", out: str = "text", chain: dict[str, Step] | None = None) -> DataFrame:
    """Apply the chain; a projection for each step keeps expressions small.  Null stays null."""
    work = "_clean"
    df = df.withColumn(work, F.col(text_col))
    for step in (steps() if chain is None else chain).values():
        df = df.withColumn(work, F.when(F.length(work) > 0, step(F.col(work))).otherwise(F.col(work)))
    return df.withColumn(out, F.col(work)).drop(work)
