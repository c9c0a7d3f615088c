"""Gates and filters on documents and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip

# A binary marker, the replacement character and its tolerated share.
BINARY_MARKER, REPLACEMENT, MOST_REPLACED = "bjbj", "\ufffd", 0.02
STAGES = ("INGEST", "CLEAN", "EMBED", "SINK")


def garbled(chunks: DataFrame, doc_col: str = "documentId", text_col: str = "text", most: float = MOST_REPLACED) -> DataFrame:
    """``doc, n_chunks, n_chars, n_replaced, garbled``: one aggregation, combined before the shuffle."""
    t = F.col(text_col)
    out = chunks.groupBy(doc_col).agg(
        F.count("*").alias("n_chunks"),
        F.coalesce(F.sum(F.length(t)), F.lit(0)).cast("long").alias("n_chars"),
        F.coalesce(F.sum(F.length(t) - F.length(F.replace(t, F.lit(REPLACEMENT), F.lit("")))), F.lit(0)).cast("long").alias("n_replaced"),
        F.coalesce(F.max(t.contains(BINARY_MARKER)), F.lit(False)).alias("_marked"),
    )
    share = F.when(F.col("n_chars") > 0, F.col("n_replaced") / F.col("n_chars")).otherwise(F.lit(0.0))
    return out.withColumn("garbled", F.col("_marked") | (share > most)).drop("_marked")


def gate(chunks: DataFrame, doc_col: str = "documentId", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Chunks of sound documents, and the failures of the others."""
    bad = garbled(chunks, doc_col, text_col).where("garbled").select(doc_col)
    failures = bad.select(F.lit(None).cast("string").alias("filePath"), F.col(doc_col).alias("documentId"), F.lit("CLEAN").alias("stage"), F.lit("GARBLED_OUTPUT").alias("errorCode"), F.lit("text is garbled").alias("message"))
    return chunks.join(bad, doc_col, "left_anti"), failures


def parse_status(content: Column) -> Column:
    """PARTIAL for blank content, else SUCCESS."""
    return F.when(F.coalesce(strip(content), F.lit("")) == "", "PARTIAL").otherwise("SUCCESS")


def with_chunks(docs: DataFrame, chunks: DataFrame, doc_col: str = "documentId") -> DataFrame:
    """Documents that produced a chunk."""
    return docs.join(chunks.select(doc_col), doc_col, "left_semi")


def pending(files: DataFrame, state: DataFrame, embedding: bool = False) -> DataFrame:
    """Files whose needed stages have not all succeeded; state: job_files rows of one job."""
    needed = [s for s in STAGES if embedding or s != "EMBED"]
    done = state.where((F.col("status") == "SUCCESS") & F.col("stage").isin(needed)).groupBy("file_path").agg(F.countDistinct("stage").alias("n")).where(F.col("n") == len(needed))
    return files.join(done.select("file_path"), "file_path", "left_anti")
