"""Job state, failures and reports as tables."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATE = "job_id string, file_path string, content_hash string, document_id string, stage string, status string, updated_at timestamp"
FAILURES = "filePath string, documentId string, stage string, errorCode string, message string"
STAGES = ("INGEST", "CLEAN", "EMBED", "SINK")
#: Codes of failures and what they say.
CODES = {
    "CONFIG_001": "configuration is malformed", "CONFIG_002": "a required setting is missing", "CONFIG_003": "settings depend on one another", "CONFIG_004": "a setting is invalid",
    "CONFIG_005": "no component of this name", "CONFIG_006": "an environment variable is unresolved",
    "PARSE_001": "document parsing failed", "PARSE_002": "PDF text extraction failed", "PARSE_003": "PDF is damaged", "PARSE_004": "scanned PDF is too long for OCR",
    "OCR_001": "OCR failed", "LAYOUT_001": "layout analysis failed", "CLEAN_001": "encoding conversion failed", "CLEAN_002": "text cleaning failed", "CHUNK_001": "chunking failed", "DEDUP_001": "de-duplication failed",
    "EMBED_001": "embedding failed", "EMBED_002": "embedding was throttled", "EMBED_003": "embedding has another dimension", "SINK_001": "vector write failed", "SINK_002": "vector store is unreachable", "SINK_003": "file write failed",
    "SEC_001": "file type is not allowed", "SEC_002": "file is too large", "SEC_003": "path leaves its folder", "SEC_004": "authentication failed",
    "JOB_001": "a job is running", "JOB_002": "no such job", "JOB_003": "job state does not allow this",
}


class StateTable:
    """Appended status rows below a path; the latest row of (job, file, stage) holds."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, rows: DataFrame) -> None:
        """rows: the columns of STATE but ``updated_at``."""
        rows.withColumn("updated_at", F.current_timestamp()).select(*(x.split()[0] for x in STATE.split(", "))).write.mode("append").parquet(self.path)

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def all(self) -> DataFrame:
        return self.spark.read.schema(STATE).parquet(self.path) if self._exists() else self.spark.createDataFrame([], STATE)

    def current(self, job: str) -> DataFrame:
        return latest(self.all().where(F.col("job_id") == job))

    def has_unfinished(self, job: str) -> bool:
        return not self.current(job).where("status <> 'SUCCESS'").isEmpty()

    def clean(self, job: str) -> None:
        kept = self.all().where(F.col("job_id") != job)
        kept.write.mode("overwrite").parquet(f"{self.path}.new")
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.delete(path(self.path), True)
        fs.rename(path(f"{self.path}.new"), path(self.path))


def latest(state: DataFrame) -> DataFrame:
    keys = ["job_id", "file_path", "stage"]
    return state.groupBy(*keys).agg(F.max_by(F.struct("content_hash", "document_id", "status"), "updated_at").alias("x"), F.max("updated_at").alias("updated_at")).select(*keys, "x.*", "updated_at")


def by_stage(state: DataFrame) -> DataFrame:
    """One row a file with a status column for each stage."""
    return state.groupBy("job_id", "file_path").pivot("stage", list(STAGES)).agg(F.first("status"))


def last_completed(state: DataFrame) -> DataFrame:
    """``job_id, file_path, stage``: the furthest stage that succeeded."""
    place = F.array_position(F.array(*(F.lit(s) for s in STAGES)), F.col("stage"))
    return state.where("status = 'SUCCESS'").groupBy("job_id", "file_path").agg(F.max_by("stage", place).alias("stage"))


def failure_report(failures: DataFrame) -> DataFrame:
    """``stage, errorCode, n_failures, n_files``."""
    return failures.groupBy("stage", "errorCode").agg(F.count("*").alias("n_failures"), F.countDistinct("filePath").alias("n_files"))


def processing_report(files: DataFrame, chunks: DataFrame, failures: DataFrame) -> dict[str, Any]:
    """Totals under the customary keys, and beside them what these leave out."""
    total, kept = files.count(), chunks.agg(F.count("*").alias("c"), F.countDistinct("documentId").alias("d")).first()
    failed = failures.select("filePath", "documentId").distinct().count()
    return {"total_files": total, "succeeded": kept["d"], "failed": failed, "total_chunks": kept["c"], "without_chunks_or_duplicate": total - kept["d"] - failed}


class Events:
    """Listeners called on the driver as stages end; a listener's error stops nothing."""

    def __init__(self) -> None:
        self._listeners: list[Callable[[str, dict[str, Any]], None]] = []

    def listen(self, listener: Callable[[str, dict[str, Any]], None]) -> None:
        self._listeners.append(listener)

    def emit(self, kind: str, **data: Any) -> None:
        for listener in self._listeners:
            try:
                listener(kind, data)
            except Exception:  # noqa: BLE001, S112
                continue
