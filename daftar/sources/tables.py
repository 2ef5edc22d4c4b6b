"""Stage tables on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_table(df: DataFrame, base: str, name: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> str:
    """Write one stage table as Parquet and return its path."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    path = f"{base.rstrip('/')}/{name}"
    writer.parquet(path)
    return path


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base.rstrip('/')}/{name}")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing to the cluster's shared checkpoint folder, and read back.

    The folder is ``spark.checkpoint.dir``; it survives the loss of executors. Where it
    is not set (tests) the frame is kept by the session instead, so it is still made once.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        return df.persist()
    from uuid import uuid4

    return spark.read.parquet(write_table(df, base, f"{name}-{uuid4().hex}", mode="errorifexists"))
