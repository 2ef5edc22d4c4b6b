"""The intake, status and monitoring flows as Structured Streaming jobs."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from daftar.operators.rollups import windowed_counts
from daftar.operators.status import LATEST, latest_status
from daftar.operators.validate import filled, validate_invoices
from daftar.plans.pipeline import extract_invoices
from daftar.sources.ocr import result_lines, scan_ocr_json
from daftar.sources.snapshots import Snapshot


def work_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder on the storage the cluster shares (spark.checkpoint.dir).

    Only a local session, as in tests, may leave it unset; it then gets a local folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to storage that driver and executors share")
    if not base:
        base = tempfile.mkdtemp(prefix="daftar-")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


FIRST_SEEN = "supplier_vat_number string, invoice_number string, created_at timestamp, extraction_id string"


def first_seen(target: str, buckets: int = 1024) -> Snapshot:
    """The earliest stored extraction of every (VAT number, invoice number)."""
    return Snapshot(f"{target.rstrip('/')}/first-seen", FIRST_SEEN, ("supplier_vat_number", "invoice_number"), buckets)


def stream_documents(
    spark: SparkSession,
    source: str,
    target: str,
    checkpoint: str,
    mode: str = "text_first",
    mappings: DataFrame | None = None,
    index: Snapshot | None = None,
    **options,
) -> StreamingQuery:
    """New OCR JSON files to extractions, lines and verdicts.

    The JSON is parsed once per micro-batch, into ``documents``. Documents are independent of each
    other but for duplicates: those are looked for within the batch and in ``index``
    (:func:`first_seen` by default), which holds one slim row per invoice ever stored and of which
    a batch reads only the buckets of its own invoices; stored extractions are not read again. Documents
    without text get a header with every warning; results that cannot be read go to
    ``rejects``. With ``mappings``, lines carry suggested products. Each micro-batch owns one
    ``batch=`` folder per table and overwrites it, and the index changes by manifest, so a batch that is
    run again after a failure leaves the same result. ``options`` go to the extraction.
    """
    base = target.rstrip("/")
    index = index or first_seen(target)

    def store(df: DataFrame, name: str, batch_id: int) -> DataFrame:
        path = f"{base}/{name}/batch={batch_id}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def process(batch: DataFrame, batch_id: int) -> None:
        parsed = store(batch, "documents", batch_id)
        readable = F.col("doc_id").isNotNull() & F.col("_corrupt_record").isNull()
        raw = F.coalesce("_corrupt_record", F.to_json(F.struct("pages")))
        store(parsed.where(~readable).select(raw.alias("raw")), "rejects", batch_id)
        good = parsed.where(readable)
        found = extract_invoices(result_lines(good), F.current_timestamp(), mode, documents=good, mappings=mappings, **options)
        new = store(found.extractions, "extractions", batch_id)
        new_lines = store(found.lines, "lines", batch_id)
        numbered = new.where(filled("supplier_vat_number") & filled("invoice_number")).select(index.names)
        mine = index.touched(numbered)
        # of the stored invoices only the earliest of each number matters to a later arrival
        before = index.latest(batch.sparkSession, before=batch_id)
        known = new if before is None else new.unionByName(index.read(batch.sparkSession, before, mine), allowMissingColumns=True)
        verdicts = validate_invoices(known, new_lines, duplicates="arrival")
        store(verdicts.join(new.select("extraction_id"), "extraction_id", "left_semi"), "verdicts", batch_id)
        at = F.struct("created_at", "extraction_id")
        earliest = [F.min_by(c, at).alias(c) for c in ("created_at", "extraction_id")]
        index.merge(numbered, batch_id, earliest, mine)

    return (
        scan_ocr_json(spark, source, streaming=True)
        .writeStream.foreachBatch(process)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def status_snapshot(target: str, buckets: int = 64) -> Snapshot:
    """The stored status of every upload."""
    return Snapshot(target.rstrip("/"), LATEST, ("upload_id",), buckets)


def stream_status(events: DataFrame, target: str, checkpoint: str, lateness: str = "1 hour", buckets: int = 64) -> StreamingQuery:
    """Latest status per upload from a stream of job events, kept in :func:`status_snapshot`.

    The stream's own state is one key per event, against repeated deliveries, and each expires when
    the watermark passes its time plus ``lateness``; nothing is held per upload. What a micro-batch
    adds is merged into the buckets of its uploads, so an event for an upload of any age
    finds the status stored: an older event adds to its count, and only a newer one, by time and
    sequence, changes its status. Events behind the watermark (``lateness`` behind the newest event of
    earlier batches) are dropped, since a repeat could no longer be told from them.
    """
    snapshot = status_snapshot(target, buckets)
    fresh = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["upload_id", "seq"])

    def process(batch: DataFrame, batch_id: int) -> None:
        changes = batch.groupBy("upload_id").agg(*latest_status()).persist()
        try:
            snapshot.merge(changes, batch_id, latest_status(merged=True))
        finally:
            changes.unpersist()
        snapshot.vacuum(batch.sparkSession)

    return (
        fresh.writeStream.foreachBatch(process).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def read_status(spark: SparkSession, target: str, buckets: int = 64) -> DataFrame:
    """upload_id, status, since, n_events as the newest committed batch left them."""
    return status_snapshot(target, buckets).read(spark).drop("seq")


def stream_jobs(requests: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """One OCR job per upload from a stream of requests."""
    return (
        requests.withWatermark("ts", lateness)
        .dropDuplicatesWithinWatermark(["upload_id"])
        .select("upload_id", F.concat(F.lit("ocr:"), F.col("upload_id")).alias("job_id"))
    )


def stream_error_rate(events: DataFrame, size: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Errors per window and code; events later than the watermark are dropped."""
    errors = events.where(F.col("error_code").isNotNull()).withWatermark("ts", lateness)
    return windowed_counts(errors, size, slide, "error_code")


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over everything available and leave its result as a Parquet table.

    In update mode each micro-batch leaves its changed rows in a ``batch=`` folder of its
    own (overwritten when the batch is run again); see :func:`read_updates`.
    """
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{target}/batch={n}")).start()
    query.awaitTermination()


def read_updates(spark: SparkSession, target: str, *keys: str) -> DataFrame:
    """Current rows of a table written in update mode."""
    changes = spark.read.option("basePath", target).parquet(f"{target}/batch=*")
    values = [c for c in changes.columns if c not in keys and c != "batch"]
    newest = changes.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return newest.select(*keys, "v.*")
