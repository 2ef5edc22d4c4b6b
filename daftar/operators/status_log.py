"""The status of uploads as a log of events and a compacted snapshot of it.

Whatever changes a status appends events: verdicts, approvals, postings, jobs. Each append is a
numbered batch. Now and then the batches since the last compaction are merged into the snapshot,
bucket by bucket; the current status is the snapshot and the few batches after it, so no reader goes
through all events.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators.status import LATEST, latest_status
from daftar.sources.snapshots import Snapshot, numbered, written

EVENT = "upload_id string, status string, ts timestamp, seq long"


def verdict_events(verdicts: DataFrame, ts: Column, seq: Column) -> DataFrame:
    """READY or NEEDS_REVIEW, as validation found."""
    return _events(verdicts, F.col("status"), ts, seq)


def approval_events(approved: DataFrame, ts: Column, seq: Column) -> DataFrame:
    return _events(approved, F.lit("APPROVED"), ts, seq)


def _events(df: DataFrame, status: Column, ts: Column, seq: Column) -> DataFrame:
    return df.select("upload_id", status.alias("status"), ts.cast("timestamp").alias("ts"), seq.cast("long").alias("seq"))


@dataclass(frozen=True)
class StatusLog:
    path: str
    buckets: int = 64

    @property
    def snapshot(self) -> Snapshot:
        return Snapshot(f"{self.path}/snapshot", LATEST, ("upload_id",), self.buckets)

    def append(self, events: DataFrame, batch: int) -> None:
        """Add a batch of events (upload_id, status, ts, seq); the same batch again replaces itself."""
        compacted = self.snapshot.latest(events.sparkSession)
        if compacted is not None and batch <= compacted:
            return  # it was written before, or it would not be in the snapshot
        events.select("upload_id", "status", "ts", "seq").write.mode("overwrite").parquet(f"{self.path}/log/batch={batch}")

    def since(self, spark: SparkSession, batch: int | None) -> list[int]:
        """Batches after one, oldest first."""
        log = f"{self.path}/log"
        return sorted(n for n in numbered(spark, log) if (batch is None or n > batch) and written(spark, log, n))

    def events(self, spark: SparkSession, of: list[int]) -> DataFrame:
        paths = [f"{self.path}/log/batch={n}" for n in of]
        return spark.read.schema(EVENT).parquet(*paths) if paths else spark.createDataFrame([], EVENT)

    def compact(self, spark: SparkSession) -> None:
        """Merge the batches since the last compaction into the snapshot; a retry starts from the same snapshot."""
        new = self.since(spark, self.snapshot.latest(spark))
        if new:
            changes = self.events(spark, new).groupBy("upload_id").agg(*latest_status())
            self.snapshot.merge(changes, new[-1], latest_status(merged=True))
            self.snapshot.vacuum(spark)

    def current(self, spark: SparkSession) -> DataFrame:
        """upload_id, status, since, n_events: the snapshot and the batches after it."""
        at = self.snapshot.latest(spark)
        new = self.since(spark, at)
        changes = self.events(spark, new).groupBy("upload_id").agg(*latest_status())
        if at is None:
            return changes.drop("seq")
        known = self.snapshot.read(spark, at)
        return (known.unionByName(changes).groupBy("upload_id").agg(*latest_status(merged=True)) if new else known).drop("seq")
