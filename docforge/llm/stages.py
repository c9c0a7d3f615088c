"""A corpus pipeline of five stages, each written as Parquet and read again before the next.

Every stage takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept; all but the last return the columns of ``documents``.  Ids
may be null or repeated: decisions are made for rows, by place in a written
copy or by content, never by id alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, similar, suffix_dedup, toxicity
from .common import materialised, shared_dir, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on the labelled rows of ``docs``."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select(*COLUMNS), model).where(F.col("score") < toxicity.PASS).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the row with the smallest id stays.

    Pairs are found by SimHash (multi-index hashing) and verified by their exact Jaccard similarity; groups are connected components.

    Rows without an id come after those with one, equal rows in the order of
    the written copy.  Texts without a word are equal to each other only if
    they are the same text.
    """
    rows = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("_body"))
    copies = rows.groupBy("_body").agg(F.min("doc_id").alias("doc_id"))
    # a node for each distinct text: its hash; the smallest id of a group is found after linking
    groups = materialised(similar.similar_groups(rows, "_body", "text", 5))
    root = copies.join(groups.select(F.col("node").alias("_body"), "root"), "_body", "left").withColumn("root", F.coalesce("root", "_body"))
    keep = root.groupBy("root").agg(F.min_by("_body", F.struct(F.col("doc_id").isNull(), "doc_id", "_body")).alias("_body"), F.min("doc_id").alias("least")).select("_body", "least")
    kept = rows.join(keep, "_body").where(F.col("doc_id").eqNullSafe(F.col("least")))
    one = F.min_by(F.struct(*COLUMNS), F.struct("lang", "source", "n_chars"))  # of rows equal in id and text
    return kept.groupBy("_body").agg(one.alias("_row")).select("_row.*")


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes in strings of 200 bytes that start more than once are cut; a document stays, if only with an empty text."""
    cut = suffix_dedup.cut_repeats(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of any benchmark item occurs go."""
    found = decontam.find_overlaps(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))
    return found.where(F.size("items") == 0).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest of each kept document's ids and of their decoding."""
    return bpe.round_trip(docs)


STAGES = [
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("contaminated", contaminated),
    ("encoded", encoded),
]

#: No stage before the last can be expressed in SQL; the pipeline is tested stage by stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
