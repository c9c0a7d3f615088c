"""Page layout over glyph tables (doc, page, seq, x, y, width, fontSize, text) and page tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# Page and glyph thresholds.
SCANNED_CHARS = 10
IMAGE_CHARS, IMAGE_PAGES, IMAGE_SAMPLE, IMAGE_AREA = 500, 100, 5, 0.3
OCR_PAGES, OCR_DPI, EXTRACT_DPI, IMAGE_PIXELS = 50, 300, 150, 50
COLUMN_GAP, COLUMN_SIDE, COLUMN_MIDDLE = 0.15, 0.20, 0.15
MARGIN, FONT_TOLERANCE = 0.05, 0.5
ALT_CHARS = 5


def is_scanned(chars: Column, pages: Column) -> Column:
    """Fewer than ten characters a page on average, in whole numbers."""
    return (pages > 0) & (F.floor(chars / pages) < SCANNED_CHARS)


def image_based(pages: DataFrame, doc_col: str = "doc") -> DataFrame:
    """``doc, imageBased``: of at most five evenly spaced pages, more than half are covered by images.

    pages: doc, page (from 0), pageArea, imageArea, imageCount, chars.
    """
    total = pages.groupBy(doc_col).agg(F.count("*").alias("_n"), F.sum("chars").alias("_chars"))
    sample = F.least(F.lit(IMAGE_SAMPLE).cast("long"), F.col("_n"))
    picked = F.transform(F.sequence(F.lit(0).cast("long"), sample - 1), lambda i: F.floor(i * F.col("_n") / sample))
    chosen = total.withColumn("page", F.explode(picked))
    heavy = (F.col("imageCount") >= 1) & (F.col("imageArea") > IMAGE_AREA * F.col("pageArea"))
    seen = chosen.join(pages.select(doc_col, "page", heavy.alias("_heavy")), [doc_col, "page"], "left")
    out = seen.groupBy(doc_col).agg(F.max("_n").alias("_n"), F.max("_chars").alias("_chars"), F.count("*").alias("_s"), F.sum(F.coalesce(F.col("_heavy"), F.lit(False)).cast("int")).alias("_h"))
    verdict = (F.col("_chars") <= IMAGE_CHARS) & (F.col("_n") <= IMAGE_PAGES) & (F.col("_h") > F.floor(F.col("_s") / 2))
    return out.select(doc_col, verdict.alias("imageBased"))


def needs_refusal(scanned: Column, image: Column, pages: Column) -> Column:
    """A long scanned document that is no picture book is not put through OCR."""
    return scanned & ~image & (pages > OCR_PAGES)


def two_columns(glyphs: DataFrame, width: float, doc_col: str = "doc") -> DataFrame:
    """``doc, twoColumn``."""
    middle, half = width / 2, width * COLUMN_GAP / 2
    left, right = F.col("x") < middle - half, F.col("x") > middle + half
    share = lambda c: F.avg(c.cast("int"))
    out = glyphs.groupBy(doc_col).agg(share(left).alias("_l"), share(right).alias("_r"), share(~left & ~right).alias("_m"))
    return out.select(doc_col, ((F.col("_l") > COLUMN_SIDE) & (F.col("_r") > COLUMN_SIDE) & (F.col("_m") < COLUMN_MIDDLE)).alias("twoColumn"))


def column_text(glyphs: DataFrame, width: float, doc_col: str = "doc", y_up: bool = True) -> DataFrame:
    """``doc, text``: of each page the left column, then the right, from top to bottom.

    A page is gathered on its own before its document, so the ordered lists stay
    of the size of a page and of a page count.
    """
    side = F.when(F.col("x") < width / 2, 0).otherwise(1)
    down = -F.col("y") if y_up else F.col("y")
    rows = glyphs.select(doc_col, "page", side.alias("s"), down.alias("d"), "seq", "text")
    page = rows.groupBy(doc_col, "page").agg(F.array_sort(F.collect_list(F.struct("s", "d", "seq", "text"))).alias("g"))
    half = lambda k: F.array_join(F.transform(F.filter("g", lambda x: x["s"] == k), lambda x: x["text"]), "")
    page = page.select(doc_col, "page", F.concat(half(0), F.lit("\n"), half(1), F.lit("\n")).alias("t"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "")
    return page.groupBy(doc_col).agg(strip(joined).alias("text"))


def margin_regions(glyphs: DataFrame, height: float, y_up: bool = True, repeated_on: int | None = None, doc_col: str = "doc") -> DataFrame:
    """Header and footer glyphs with ``type``; ``repeated_on`` keeps texts that stand there on so many pages."""
    top, bottom = F.col("y") > (1 - MARGIN) * height, F.col("y") < MARGIN * height
    if not y_up:
        top, bottom = bottom, top
    out = glyphs.withColumn("type", F.when(top, "HEADER").when(bottom, "FOOTER")).where("type is not null")
    if repeated_on:
        often = out.groupBy(doc_col, "type", "text").agg(F.countDistinct("page").alias("_n")).where(F.col("_n") >= repeated_on).drop("_n")
        out = out.join(often, [doc_col, "type", "text"], "left_semi")
    return out


def heading_regions(glyphs: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Glyphs of the largest font as H1 and of the next as H2, each within the tolerance."""
    first = glyphs.groupBy(doc_col).agg(F.max("fontSize").alias("_a"))
    row = glyphs.join(first, doc_col)
    second = row.where(F.col("fontSize") < F.col("_a") - FONT_TOLERANCE).groupBy(doc_col).agg(F.max("fontSize").alias("_b"))
    row = row.join(second, doc_col, "left")
    kind = F.when(F.abs(F.col("fontSize") - F.col("_a")) <= FONT_TOLERANCE, "H1").when(F.abs(F.col("fontSize") - F.col("_b")) <= FONT_TOLERANCE, "H2")
    return row.withColumn("type", kind).where("type is not null").drop("_a", "_b")


def page_alt_text(content: Column, page: Column) -> Column:
    """The n-th short line of Han characters, for page n."""
    short = F.filter(F.transform(F.split(content, "\n", -1), strip), lambda x: (F.length(x) > 0) & (F.length(x) <= ALT_CHARS) & x.rlike(r"^\p{IsHan}+$"))
    return F.get(short, page - 1)


def insert_image_markers(content: Column, images: Column) -> Column:
    """After the first line equal to an image's alt text comes its marker; images: array of (page, filePath, altText), used in order."""

    def step(s: Column, line: Column) -> Column:
        image = F.get(images, s["next"])
        hit = F.coalesce(strip(line) == image["altText"], F.lit(False))
        marker = F.concat(F.lit("<!-- image page="), image["page"].cast("string"), F.lit(" file="), image["filePath"], F.lit(" alt="), image["altText"], F.lit(" -->"))
        return F.struct(
            F.when(hit, s["next"] + 1).otherwise(s["next"]).alias("next"),
            F.when(hit, F.concat(s["out"], F.array(line, marker))).otherwise(F.concat(s["out"], F.array(line))).alias("out"),
        )

    start = F.struct(F.lit(0).alias("next"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.split(content, "\n", -1), start, step, lambda s: F.array_join(s["out"], "\n"))


def ocr_text(pages: DataFrame, doc_col: str = "doc") -> DataFrame:
    """``doc, text, status`` from recognised pages (doc, page, text; null text: the page failed)."""
    line = F.when(F.col("text").isNull(), F.concat(F.lit("[第"), F.col("page").cast("string"), F.lit("页 OCR 失败]\n"))).when(F.col("text").endswith("\n"), F.col("text")).otherwise(F.concat("text", F.lit("\n")))
    out = pages.select(doc_col, "page", line.alias("t")).groupBy(doc_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "t"))), lambda x: x["t"]), "").alias("text"))
    return out.withColumn("status", F.when(strip(F.col("text")) == "", "FAILED").otherwise("SUCCESS"))
