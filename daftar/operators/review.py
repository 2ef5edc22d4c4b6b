"""Review, patching and approval of invoices, many at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.functions import patterns as P
from daftar.operators.validate import approval_gate, filled, given, validate_invoices

HEADER_PATCH = {
    "supplier_name": "string",
    "supplier_vat_number": "string",
    "invoice_number": "string",
    "invoice_date": "date",
    "subtotal": "decimal(12,2)",
    "vat_amount": "decimal(12,2)",
    "total": "decimal(12,2)",
    "currency": "string",
}
LINE_PATCH = {
    "product_id": "string",
    "quantity": "decimal(12,3)",
    "unit": "string",
    "unit_price": "decimal(12,2)",
    "line_total": "decimal(12,2)",
}


def latest_extraction(extractions: DataFrame) -> DataFrame:
    """Newest extraction of every upload (ties: smallest id)."""
    # newest first and smallest id: one aggregate, combined before the exchange
    newest = extractions.groupBy("upload_id").agg(
        F.min_by("extraction_id", F.struct((-F.unix_micros(F.col("created_at").cast("timestamp"))).alias("t"), "extraction_id")).alias("extraction_id")
    )
    return extractions.join(newest.select("extraction_id"), "extraction_id", "left_semi")


def review_view(uploads: DataFrame, extractions: DataFrame, lines: DataFrame) -> DataFrame:
    """What a reviewer sees: one row per line (or one for an empty invoice), freshly validated."""
    latest = latest_extraction(extractions)
    # duplicates are looked for among all extractions, the verdict is shown for the latest
    verdict = validate_invoices(extractions, lines).select(
        "extraction_id", "is_valid", "needs_review", F.col("confidence").alias("verdict_confidence"), "n_errors", "n_warnings"
    )
    return (
        latest.join(uploads.select("upload_id", "mime_type", F.col("status").alias("upload_status")), "upload_id")
        .join(verdict, "extraction_id")
        .join(lines.select("extraction_id", "line_no", "raw_name", "quantity", "unit_price", "line_total", "product_id"), "extraction_id", "left")
    )


def _apply(df: DataFrame, patches: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Each field as its newest patch says. Equal times: the larger patch_id if there is one, else the larger value."""
    tie = [F.col("patch_id")] if "patch_id" in patches.columns else []
    single = patches.select(F.col(key).alias("_key"), "patched_at", *tie, F.explode("fields").alias("_name", "_value"))
    # the value in a struct, so that a newest NULL counts
    newest = single.where(F.col("_name").isin(*fields)).groupBy("_key", "_name").agg(
        F.max_by(F.struct("_value"), F.struct("patched_at", *tie, "_value")).alias("_v")
    )
    # at most one entry per field that can be patched
    latest = newest.groupBy("_key").agg(F.map_from_entries(F.collect_list(F.struct("_name", "_v._value"))).alias("_f"))
    out = []
    for name in df.columns:
        if name in fields:
            set_here = F.coalesce(F.map_contains_key("_f", name), F.lit(False))
            new = F.try_element_at("_f", F.lit(name)).try_cast(fields[name])
            out.append(F.when(set_here, new).otherwise(F.col(name)).alias(name))
        else:
            out.append(F.col(name))
    return df.join(latest, F.col(key) == F.col("_key"), "left").select(*out)


def apply_header_patch(extractions: DataFrame, patches: DataFrame) -> DataFrame:
    """Patch the newest extraction of each upload; a key present with NULL clears the field, an absent key keeps it."""
    newest = latest_extraction(extractions).select("extraction_id", "upload_id")
    targets = patches.join(newest, "upload_id")
    return _apply(extractions, targets, "extraction_id", HEADER_PATCH)


def apply_line_patch(lines: DataFrame, patches: DataFrame) -> DataFrame:
    return _apply(lines, patches, "line_id", LINE_PATCH)


def approval_decisions(extractions: DataFrame, uploads: DataFrame, approved: DataFrame) -> DataFrame:
    """Latest extractions with ``reject_reason``; NULL means the invoice can be approved.

    ``approved`` holds the upload_ids that already have a purchase invoice.
    """
    done = approved.select("upload_id").distinct().withColumn("_done", F.lit(True))
    gate = approval_gate(extractions)
    reason = (
        F.when(F.col("errors").isNotNull(), F.concat(F.lit("Cannot approve: "), F.col("errors")))
        .when(F.col("_status").isin(P.APPROVAL_BLOCKERS), "Cannot approve a failed invoice")
        .when(~filled("invoice_number"), "Invoice number is required")
        .when(~given("total"), "Total amount is required")
        .when(F.col("_done"), "Invoice already approved")
    )
    return (
        latest_extraction(extractions)
        .join(gate, "extraction_id")
        .join(uploads.select("upload_id", F.col("status").alias("_status")), "upload_id")
        .join(done, "upload_id", "left")
        .withColumn("reject_reason", reason)
        .drop("errors", "_status", "_done")
    )


def approve_batch(decisions: DataFrame) -> DataFrame:
    """Purchase invoices of everything that passed."""
    return decisions.where(F.col("reject_reason").isNull()).select(
        F.concat(F.lit("pi-"), F.col("upload_id")).alias("purchase_invoice_id"),
        "upload_id",
        "extraction_id",
        "supplier_name",
        "supplier_vat_number",
        "invoice_number",
        "invoice_date",
        "subtotal",
        "vat_amount",
        "total",
        "currency",
        F.lit("APPROVED").alias("status"),
    )


def approve_lines(purchase_invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Mapped lines of approved invoices; lines without a product do not go along."""
    return (
        lines.where(filled("product_id"))
        .join(purchase_invoices.select("purchase_invoice_id", "extraction_id"), "extraction_id")
        .select(
            "purchase_invoice_id",
            "line_id",
            "product_id",
            "raw_name",
            F.coalesce("quantity", F.lit(1).cast("decimal(12,3)")).alias("quantity"),
            "unit",
            F.coalesce("unit_price", F.lit(0).cast("decimal(12,2)")).alias("unit_price"),
            F.coalesce("line_total", F.lit(0).cast("decimal(12,2)")).alias("line_total"),
        )
    )


def dropped_lines(purchase_invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """How many lines each approval left behind."""
    return (
        lines.where(~filled("product_id"))
        .join(purchase_invoices.select("purchase_invoice_id", "extraction_id"), "extraction_id")
        .groupBy("purchase_invoice_id")
        .agg(F.count("*").alias("n_dropped"))
    )


def reject_batch(extractions: DataFrame, rejections: DataFrame) -> DataFrame:
    """Audit rows for rejected uploads; a rejection changes no status."""
    from daftar.operators.posting import audit_rows

    latest = latest_extraction(extractions).select("upload_id", "extraction_id")
    return audit_rows(
        rejections.join(latest, "upload_id"), "invoice_extraction", "extraction_id", "REJECTED", ["reason"]
    )
