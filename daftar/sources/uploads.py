"""Uploads: admission, listing, removal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import patterns as P


def scan_uploads(spark: SparkSession, folder: str) -> DataFrame:
    """A catalog of the files in a folder and below: path, file_name, mime_type, size_bytes, created_at.

    Only what the storage says of a file is read, never its content. The type follows from the
    ending, where that is one of an accepted type.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    ending = F.lower(F.regexp_extract("path", r"(\.[^./]*)\z", 1))
    kinds = F.when(ending.isin(".jpg", ".jpeg"), "image/jpeg").when(ending == ".png", "image/png").when(ending == ".pdf", "application/pdf")
    return files.select(
        "path", F.regexp_extract("path", r"([^/]*)\z", 1).alias("file_name"), kinds.alias("mime_type"),
        F.col("length").alias("size_bytes"), F.col("modificationTime").alias("created_at"),
    )


def admit_uploads(files: DataFrame, max_mb: int = P.MAX_UPLOAD_MB) -> DataFrame:
    """Adds ``extension`` and ``reject_reason`` (NULL = accepted) to a catalog of files.

    Checked in this order: type, size, extension.
    """
    extension = F.lower(F.regexp_extract("file_name", r"(?s)[^/](\.[^./]*)\z", 1))
    return files.withColumn("extension", extension).withColumn(
        "reject_reason",
        F.when(~F.coalesce(F.col("mime_type").isin(P.UPLOAD_MIME_TYPES), F.lit(False)), "invalid file type")
        .when(F.col("size_bytes") > max_mb * 1024 * 1024, "file too large")
        .when(~F.col("extension").isin(P.UPLOAD_EXTENSIONS), "invalid file extension"),
    )


def accepted_uploads(files: DataFrame, max_mb: int = P.MAX_UPLOAD_MB) -> DataFrame:
    admitted = admit_uploads(files, max_mb)
    return admitted.where(F.col("reject_reason").isNull()).drop("reject_reason").withColumn("status", F.lit("QUEUED"))


def list_uploads(uploads: DataFrame) -> DataFrame:
    """All uploads, newest first."""
    return uploads.orderBy(F.desc("created_at"), "upload_id")


def delete_uploads(uploads: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploads left after removal, and the requested ids that do not exist.

    Extractions of a removed upload stay.
    """
    ids = keys.select("upload_id").distinct()
    return uploads.join(ids, "upload_id", "left_anti"), ids.join(uploads, "upload_id", "left_anti")
