"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Full-width forms that stay (Chinese punctuation of the U+FF00 block).
KEPT_FULLWIDTH = "，；：？！（）"
_WIDE = "　" + "".join(chr(c) for c in range(0xFF01, 0xFF5F) if chr(c) not in KEPT_FULLWIDTH)
_NARROW = " " + "".join(chr(ord(c) - 0xFEE0) for c in _WIDE[1:])
#: Byte order marks and what they announce.
MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Characters of text that a worker turns into Python objects at once.
SLICE_CHARS = 1 << 18


def slices(column: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """``start, length`` of runs of rows of about so many bytes of text; a longer row is a run of its own."""
    most = most or SLICE_CHARS
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    start, base = 0, 0
    while start < len(ends):
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, end - start
        start, base = end, int(ends[end - 1])


def strip(c: Column) -> Column:
    """Remove Java white space from both ends (U+3000 goes, U+00A0 stays)."""
    return F.regexp_replace(c, r"^\p{javaWhitespace}+|\p{javaWhitespace}+\z", "")


def lines(c: Column) -> Column:
    """Split at line feeds; trailing empty lines are dropped."""
    return F.split(F.regexp_replace(c, r"\n+\z", ""), "\n", -1)


def fullwidth_to_halfwidth(c: Column) -> Column:
    return F.translate(c, _WIDE, _NARROW)


@lru_cache(maxsize=1)
def _icu_table(_key: int) -> tuple[str, str]:
    spark = SparkSession.active()
    icu = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    han = [chr(c) for c in range(0x3400, 0xA000)]
    plain = icu.transliterate("\n".join(han)).split("\n")
    pairs = [(a, b) for a, b in zip(han, plain, strict=True) if a != b and len(b) == 1 and a != "乾"]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def traditional_to_simplified(c: Column, table: tuple[str, str] | None = None) -> Column:
    """Character by character, from the ICU table that Spark ships; ambiguous characters are left."""
    source, target = table or _icu_table(0)
    return F.translate(c, source, target)


def trim_whitespace(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ \t]+", " ")
    c = F.regexp_replace(c, r"\r\n?", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def normalize(c: Column, fullwidth: bool = True, simplified: bool = True, whitespace: bool = True) -> Column:
    if fullwidth:
        c = fullwidth_to_halfwidth(c)
    if simplified:
        c = traditional_to_simplified(c)
    return trim_whitespace(c) if whitespace else c


def content_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def document_id(hash_: Column) -> Column:
    return F.concat(F.lit("doc-"), F.substring(hash_, 1, 12))


def chunk_id(document: Column, ordinal: Column) -> Column:
    return F.concat(document, F.lit("#"), ordinal.cast("string"))


def entity_id(key: Column) -> Column:
    return F.concat(F.lit("ent-"), F.substring(F.sha2(key, 256), 1, 12))


def relation_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(F.lit("rel-"), F.substring(F.sha2(F.concat(source, target, kind), 256), 1, 12))


def file_stem(path: Column) -> Column:
    """Base name without its last extension; a leading dot is no extension; null reads ``unknown``."""
    base = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.coalesce(F.regexp_replace(base, r"(?<=.)\.[^.]*$", ""), F.lit("unknown"))


def format_label(mime: Column, path: Column) -> Column:
    """Last token of a MIME type, else the lower-case extension, else ``unknown``."""
    token = F.element_at(F.split(mime, "[/.]"), -1)
    extension = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(F.length(mime) > 0, token).when(F.length(extension) > 0, extension).otherwise(F.lit("unknown"))


def strip_code_fence(c: Column) -> Column:
    """Remove a Markdown code fence round a text that starts with one."""
    body = F.regexp_replace(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*", ""), r"\s*```\s*\z", "")
    return F.when(F.trim(c).startswith("```"), body).otherwise(c)


def vector_literal(v: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(v, lambda x: x.cast("string")), ","), F.lit("]"))


def detect_bytes(data: bytes | None) -> str:
    """Encoding of bytes: a mark, else strict UTF-8, GBK, Big5, else UTF-8."""
    if not data:
        return "UTF-8"
    for mark, name in MARKS:
        if data.startswith(mark):
            return name
    for codec, name in (("utf-8", "UTF-8"), ("gbk", "GBK"), ("big5", "Big5")):
        try:
            if "\ufffd" not in data.decode(codec) or codec != "utf-8":
                return name
        except UnicodeDecodeError:
            pass
    return "UTF-8"


def decode_bytes(data: bytes | None) -> str:
    """Text of bytes by their detected encoding; malformed input is replaced."""
    if not data:
        return ""
    name = detect_bytes(data)
    for mark, _ in MARKS:
        if data.startswith(mark):
            data = data[len(mark) :]
            break
    return data.decode(name, "replace")


@F.pandas_udf(StringType())
def _detect(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(detect_bytes)


@F.pandas_udf(StringType())
def _decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(decode_bytes)


def detect_encoding(c: Column) -> Column:
    """Natively for marks and valid UTF-8; the codecs run only for the rest."""
    plain = F.is_valid_utf8(c.cast("string")) & ~F.coalesce(c.cast("string").contains("\ufffd"), F.lit(False))
    marked = F.lit(None).cast("string")
    for mark, name in reversed(MARKS):
        marked = F.when(F.hex(F.substring(c, 1, len(mark))) == mark.hex().upper(), F.lit(name)).otherwise(marked)
    return F.when(c.isNull() | (F.octet_length(c) == 0), F.lit("UTF-8")).when(marked.isNotNull(), marked).when(plain, F.lit("UTF-8")).otherwise(_detect(c))


def decode(c: Column) -> Column:
    return _decode(c)


def mask_secrets(c: Column) -> Column:
    """Mask the values of keys that name an API key or a password."""
    return F.regexp_replace(c, r"(?i)((?:api_?key|password)\w*[\"']?\s*[:=]\s*[\"']?)[^\s\"',}]+", "$1****")
