"""Job and document status from append-only events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions import patterns as P


LATEST = "upload_id string, status string, since timestamp, seq long, n_events long"


def latest_status(merged: bool = False) -> list[Column]:
    """Aggregates of events per upload: the latest by time and then sequence; with ``merged``, of such results."""
    time = "since" if merged else "ts"
    at = F.struct(time, "seq")
    return [
        F.max_by("status", at).alias("status"),
        F.max(time).alias("since"),
        F.max_by("seq", at).alias("seq"),
        (F.sum("n_events") if merged else F.count("*")).alias("n_events"),
    ]


def current_status(events: DataFrame) -> DataFrame:
    """Latest status per upload, by time and then sequence."""
    return events.groupBy("upload_id").agg(*latest_status()).drop("seq")


def status_bucket(status: Column) -> Column:
    failed = [s for s in P.STATUSES if s.endswith("_FAILED")]
    done = ["NEEDS_REVIEW", "READY", "APPROVED", "POSTED_TO_INVENTORY", "POSTED_TO_ACCOUNTING"]
    return (
        F.when(status.isin(P.PROCESSING_STATUSES), "processing")
        .when(status.isin(done), "done")
        .when(status.isin(failed), "failed")
        .otherwise("other")
    )


def status_buckets(current: DataFrame) -> DataFrame:
    """Uploads per status, with its bucket and whether it can be reviewed."""
    return (
        current.groupBy("status")
        .agg(F.count("*").alias("n_uploads"))
        .select(
            "status",
            status_bucket(F.col("status")).alias("bucket"),
            F.col("status").isin(P.REVIEWABLE_STATUSES).alias("reviewable"),
            "n_uploads",
        )
    )


def dedupe_jobs(requests: DataFrame) -> DataFrame:
    """One OCR job per upload: the first request counts."""
    return requests.groupBy("upload_id").agg(
        F.concat(F.lit("ocr:"), F.col("upload_id")).alias("job_id"),
        F.min("ts").alias("queued_at"),
    )


def failed_after_retries(events: DataFrame, attempts: int = P.JOB_ATTEMPTS) -> DataFrame:
    """Uploads whose job failed as often as it may be tried."""
    failed = F.count_if(F.col("status") == "OCR_FAILED")
    return events.groupBy("upload_id").agg(failed.alias("n_failed")).where(F.col("n_failed") >= attempts)


def stuck_documents(current: DataFrame, now: Column, seconds: int = P.OCR_TIMEOUT_SECONDS) -> DataFrame:
    """Uploads in OCR processing for longer than the limit."""
    age = F.unix_timestamp(now) - F.unix_timestamp("since")
    return current.where((F.col("status") == "PROCESSING_OCR") & (age > seconds)).select(
        "upload_id", "since", age.alias("age_seconds")
    )
