"""File sources: scan, route to a parser, text and metadata as a documents table."""

from __future__ import annotations

import io
import os
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from typing import Any
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.text import content_hash, decode_bytes, document_id, normalize, slices

#: The file types that are taken in.
EXTENSIONS = ("pdf", "doc", "docx", "ppt", "pptx", "xls", "xlsx", "txt", "md", "html", "htm", "rtf", "odt", "jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif")
IMAGES = ("jpg", "jpeg", "png", "tif", "tiff", "bmp", "gif")
PREVIEW = ("pdf", "docx", "pptx", "xlsx", "txt", "md", "html")
MIME = {
    "pdf": "application/pdf", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "odt": "application/vnd.oasis.opendocument.text", "txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html",
}
PARSED = "path string, content string, author string, created string, title string, contentType string, pageCount int, parser string, error string"

#: (bytes, path) -> fields of PARSED; what is missing is null.
Parser = Callable[[bytes, str], dict[str, Any]]


def scan(spark: SparkSession, paths: list[str], extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """``path, modificationTime, length, content`` of the files below the paths, each once, in order of path.

    Names that start with a dot are left out, folders of such a name are not; a
    path that does not exist is skipped.
    """
    out = None
    for path in dict.fromkeys(paths):
        try:
            part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
        except Exception as error:  # noqa: BLE001  an unreadable input is no reason to drop the others
            if "PATH_NOT_FOUND" not in str(error):
                raise
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    name = F.element_at(F.split("path", "/"), -1)
    return out.where(~name.startswith(".") & extension(F.col("path")).isin(*extensions)).dropDuplicates(["path"])


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


class _Body(HTMLParser):
    BLOCK = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 tr table section article header footer nav aside pre blockquote hr dl dt dd form main figure".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.title: list[str] = []
        self.off = 0
        self.in_title = False

    def handle_starttag(self, tag: str, attrs: object) -> None:
        if tag in ("script", "style"):
            self.off += 1
        elif tag == "title":
            self.in_title = True
        elif tag in self.BLOCK:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.off = max(0, self.off - 1)
        elif tag == "title":
            self.in_title = False
        elif tag in self.BLOCK:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if self.in_title:
            self.title.append(data)
        elif not self.off:
            self.parts.append(data)


def html_text(html: str | None) -> tuple[str, str]:
    """Body text, with a line for each block, and title."""
    p = _Body()
    p.feed(html or "")
    p.close()
    rows = (re.sub(r"[ \t\r\f\v]+", " ", x).strip() for x in "".join(p.parts).split("\n"))
    return "\n".join(x for x in rows if x), "".join(p.title).strip()


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("title", StringType())]))
def html_to_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        parts = []
        for start, length in slices(pages):
            found = [html_text(x.as_py()) for x in pages.slice(start, length)]
            parts.append(pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], names=["text", "title"]))
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("text", pa.string()), ("title", pa.string())]))


def html_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_extract(c, r"(?is)<title[^>]*>(.*?)</title>", 1), r"\s+", " "))


def parse_plain(data: bytes, path: str) -> dict[str, Any]:
    return {"content": decode_bytes(data)}


def parse_html(data: bytes, path: str) -> dict[str, Any]:
    text, title = html_text(decode_bytes(data))
    return {"content": text, "title": title}


def parse_office(data: bytes, path: str) -> dict[str, Any]:
    """Text and core properties of zipped XML documents: a paragraph, cell row or slide line is a line."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        parts = [n for n in names if re.fullmatch(r"word/document\.xml|content\.xml", n)]
        parts += sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml|xl/worksheets/sheet\d+\.xml", n)), key=lambda n: (len(n), n))
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.itertext()) for t in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        lines = [line for n in parts for line in _xml_lines(ElementTree.fromstring(z.read(n)), shared)]
        meta = {}
        for n in ("docProps/core.xml", "meta.xml"):
            if n in names:
                meta = {_local(e.tag): (e.text or "").strip() for e in ElementTree.fromstring(z.read(n)).iter()}
    created = meta.get("created") or meta.get("creation-date") or ""
    return {"content": "\n".join(lines), "author": meta.get("creator") or None, "created": created[:19] or None, "title": meta.get("title") or None}


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _xml_lines(root: ElementTree.Element, shared: list[str]) -> Iterator[str]:
    for e in root.iter():
        kind = _local(e.tag)
        if kind in ("p", "h"):
            yield "".join(x.text or "" for x in e.iter() if _local(x.tag) in ("t", "span", "p", "h", "a"))
        elif kind == "row":
            cells = []
            for c in (x for x in e if _local(x.tag) == "c"):
                value = next((x.text or "" for x in c.iter() if _local(x.tag) in ("v", "t")), "")
                cells.append(shared[int(value)] if c.get("t") == "s" and value.isdigit() and int(value) < len(shared) else value)
            yield "\t".join(cells)


def missing(what: str) -> Parser:
    """A parser that is a plug-in slot: every file of it is a failure that says so."""

    def parse(data: bytes, path: str) -> dict[str, Any]:
        raise NotImplementedError(f"no {what} is installed")

    return parse


def default_parsers() -> dict[str, Parser]:
    """By extension; PDF, legacy Office and image recognition are slots to be filled."""
    return {
        **dict.fromkeys(("txt", "md"), parse_plain),
        **dict.fromkeys(("html", "htm"), parse_html),
        **dict.fromkeys(("docx", "pptx", "xlsx", "odt"), parse_office),
        **dict.fromkeys(("doc", "ppt", "xls", "rtf"), missing("legacy Office parser")),
        "pdf": missing("PDF parser"),
        **dict.fromkeys(IMAGES, missing("OCR engine")),
    }


def ocr_parser(recognise: Callable[[bytes, str], str], languages: tuple[str, ...] = ("chi_sim", "eng")) -> Parser:
    """A parser for images from an engine that takes bytes and languages joined by ``+``."""
    return lambda data, path: {"content": recognise(data, "+".join(languages)).strip()}


def parse(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """PARSED rows; a parser's error becomes a column, so one file never fails another."""
    known = parsers or default_parsers()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                kind = os.path.splitext(path)[1][1:].lower()
                row = dict.fromkeys((x.split()[0] for x in PARSED.split(", ")), None) | {"path": path, "contentType": MIME.get(kind), "pageCount": 0, "parser": kind}
                try:
                    row |= known.get(kind, parse_plain)(bytes(data), path)
                except Exception as error:  # noqa: BLE001
                    row["error"] = f"{type(error).__name__}: {error}"[:500]
                rows.append(row)
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in PARSED.split(", ")])

    return files.select("path", "content").mapInPandas(run, PARSED)


def documents(files: DataFrame, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """The documents table of a scan: ids from the normalised content, so equal content has one id."""
    parsed = parse(files, parsers).join(files.select("path", "length"), "path")
    text = F.coalesce("content", F.lit(""))
    hash_ = content_hash(normalize(text))
    status = F.when(F.col("error").isNotNull(), "FAILED").when(F.trim(text) == "", "PARTIAL").otherwise("SUCCESS")
    extra = F.map_filter(F.create_map(F.lit("title"), F.col("title"), F.lit("contentType"), F.col("contentType")), lambda k, v: v.isNotNull())
    return parsed.select(
        document_id(hash_).alias("id"), F.col("path").alias("sourcePath"), F.element_at(F.split("path", "/"), -1).alias("fileName"),
        F.coalesce(F.element_at(F.split("contentType", "[/.]"), -1), extension(F.col("path"))).alias("format"), text.alias("content"),
        F.struct(F.coalesce("length", F.lit(-1)).alias("fileSize"), "pageCount", "author", F.try_to_timestamp(F.replace("created", F.lit("T"), F.lit(" "))).alias("createdTime"), F.col("parser").alias("parserUsed"), extra.alias("extra")).alias("metadata"),
        hash_.alias("contentHash"), status.alias("status"), F.col("error").alias("error"),
    )


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """JSONL chunks with ``_corrupt`` for lines that cannot be read; blank lines are skipped."""
    schema = "id string, documentId string, sourcePath string, text string, ordinal int, metadata struct<sectionTitle:string,sectionLevel:int,startPage:int,charCount:int,blockType:string>, _corrupt string"
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def first_supported(files: DataFrame, folder: str) -> DataFrame:
    """The first file that can be previewed directly in a folder."""
    inside = F.regexp_extract("path", r"^(.*)/[^/]*$", 1).endswith(folder.rstrip("/"))
    return files.where(inside & extension(F.col("path")).isin(*PREVIEW)).orderBy("path").limit(1)


def listing(folder: str) -> list[dict[str, Any]]:
    """Entries of a local folder, folders first, then by name without regard to case."""
    rows = [{"name": e.name, "path": e.path, "isDirectory": e.is_dir(), "size": 0 if e.is_dir() else e.stat().st_size} for e in os.scandir(folder)]
    return sorted(rows, key=lambda r: (not r["isDirectory"], r["name"].lower()))
