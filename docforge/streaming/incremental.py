"""Incremental runs as a stream of new files or documents, with state in the checkpoint."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.text import content_hash, normalize


def document_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files below a folder, or one file as a stream; ``files_per_trigger`` is the back-pressure."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    return reader.parquet(path)


def first_seen(stream: DataFrame, text_col: str = "text", event_time: str | None = None, delay: str = "1 day") -> DataFrame:
    """Rows whose normalised content is new; with an event time, hashes are forgotten after the delay."""
    hashed = stream.withColumn("contentHash", content_hash(normalize(stream[text_col])))
    if event_time:
        return hashed.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["contentHash"])
    return hashed.dropDuplicates(["contentHash"])


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what is there in batches, then end; a batch that was written is not written again by its number."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
