"""Storage that driver and executors share, and Arrow batches of a bounded size."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; it then gets a temporary folder. On
    a cluster an unset folder is an error, since executors do not share local disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to storage that driver and executors share")
    base = "file://" + tempfile.mkdtemp(prefix="daftar-llm-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    # the schema is known: reading without it would list and open files again
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files behind a staged table that nothing reads any more."""
    spark, base = df.sparkSession, shared_folder(df.sparkSession)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        assert folder.split(":", 1)[-1].lstrip("/").startswith(base.split(":", 1)[-1].lstrip("/")), folder
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Hand texts to Python in batches of few rows, so that memory follows row size, not table size.

    Python workers also get this package's folder on their path; a cluster that does not
    have it there ships the package with the job.
    """
    home = str(Path(__file__).resolve().parents[2])
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if home not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [home, path]))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def bounded_sample(df: DataFrame, n: int, *by: str | Column) -> DataFrame:
    """``n`` rows in the order of a hash of ``by``, the same for the same rows.

    Rows are counted first and most are left out where they are read, so that what meets in
    one task is about twice the sample, whatever the size of the table.
    """
    total, place = df.count(), F.pmod(F.xxhash64(*by), F.lit(1 << 40))
    some = df.filter(place < int((1 << 40) * min(1.0, 2 * n / total))) if total > 4 * n else df
    return some.orderBy(place, *by).limit(n)
