"""Validation of extracted invoices, set-based.

Line facts are aggregated per extraction and joined once; duplicates come from a count
per (VAT number, invoice number), never from comparing invoices pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions import patterns as P
from daftar.functions.text import MONEY

WIDE = "decimal(20,4)"


def tolerance() -> Column:
    return F.lit(P.ARITHMETIC_TOLERANCE).cast("decimal(12,2)")


def given(c: Column | str) -> Column:
    """An amount that is present: NULL and zero both count as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c != 0, F.lit(False))


def filled(c: str) -> Column:
    return F.coalesce(F.col(c) != "", F.lit(False))


def duplicate_keys(extractions: DataFrame) -> DataFrame:
    """(VAT number, invoice number) pairs carried by more than one extraction."""
    return (
        extractions.where(filled("supplier_vat_number") & filled("invoice_number"))
        .groupBy("supplier_vat_number", "invoice_number")
        .agg(F.count("*").alias("n_same"), F.min(F.struct("created_at", "extraction_id")).alias("first"))
        .where(F.col("n_same") > 1)
    )


def flag_duplicates(extractions: DataFrame, mode: str = "symmetric") -> DataFrame:
    """Adds ``is_duplicate``: every member of a group, or (``arrival``) all but the first."""
    if mode not in ("symmetric", "arrival"):
        raise ValueError(f"unknown mode {mode!r}")
    late = F.struct("created_at", "extraction_id") > F.col("first")
    repeated = F.col("n_same").isNotNull()
    return (
        extractions.join(duplicate_keys(extractions), ["supplier_vat_number", "invoice_number"], "left")
        .withColumn("is_duplicate", F.coalesce(repeated & late if mode == "arrival" else repeated, F.lit(False)))
        .drop("n_same", "first")
    )


def line_mismatch() -> Column:
    product = F.col("quantity").cast(WIDE) * F.col("unit_price")
    return (
        given("quantity")
        & given("unit_price")
        & given("line_total")
        & (F.abs(product - F.col("line_total")) > tolerance())
    )


def line_stats(lines: DataFrame) -> DataFrame:
    unmapped = ~filled("product_id") & ~filled("suggested_product_id")
    return lines.groupBy("extraction_id").agg(
        F.count("*").alias("n_lines"),
        F.sum(F.coalesce("line_total", F.lit(0).cast(MONEY))).alias("items_sum"),
        F.count_if(line_mismatch()).alias("n_mismatch"),
        F.count_if(unmapped).alias("n_unmapped"),
    )


def header_checks(extractions: DataFrame) -> DataFrame:
    """Flags that need the header alone."""
    total_off = (
        given("subtotal")
        & given("vat_amount")
        & given("total")
        & (F.abs(F.col("subtotal") + F.col("vat_amount") - F.col("total")) > tolerance())
    )
    well_formed = F.rlike("supplier_vat_number", F.lit(P.java_regex(P.FIFTEEN_DIGITS, "")))
    return extractions.select(
        "*",
        (~filled("invoice_number")).alias("no_number"),
        F.col("invoice_date").isNull().alias("no_date"),
        (~given("total")).alias("no_total"),
        (filled("supplier_vat_number") & ~well_formed).alias("vat_malformed"),
        (~filled("supplier_vat_number") & (F.coalesce("currency", F.lit("SAR")) == "SAR")).alias("vat_missing"),
        total_off.alias("total_off"),
    )


def check_invoices(extractions: DataFrame, lines: DataFrame, duplicates: str = "symmetric") -> DataFrame:
    """Every flag and count the verdict rests on, one row per extraction."""
    checked = flag_duplicates(header_checks(extractions), duplicates)
    joined = checked.join(line_stats(lines), "extraction_id", "left")
    n = F.coalesce("n_lines", F.lit(0))
    items_off = (
        (n > 0) & given("subtotal") & (F.abs(F.col("items_sum") - F.col("subtotal")) > tolerance())
    )
    return joined.select(
        *checked.columns,
        n.alias("n_lines"),
        "items_sum",
        F.coalesce("n_mismatch", F.lit(0)).alias("n_mismatch"),
        F.coalesce("n_unmapped", F.lit(0)).alias("n_unmapped"),
        F.coalesce(items_off, F.lit(False)).alias("items_off"),
    )


def validate_invoices(extractions: DataFrame, lines: DataFrame, duplicates: str = "symmetric") -> DataFrame:
    """Verdict per extraction: validity, review flag, confidence, next status."""
    one = lambda c: F.col(c).cast("int")
    errors = one("no_number") + one("no_date") + one("no_total") + one("is_duplicate")
    warnings = (
        one("vat_malformed") + one("vat_missing") + one("total_off") + one("items_off")
        + F.col("n_mismatch") + (F.col("n_unmapped") > 0).cast("int")
    )
    counted = check_invoices(extractions, lines, duplicates).select(
        "extraction_id", "upload_id", "supplier_vat_number",
        errors.cast("bigint").alias("n_errors"),
        warnings.cast("bigint").alias("n_warnings"),
    )
    valid = F.col("n_errors") == 0
    clean = valid & (F.col("n_warnings") == 0)
    return counted.select(
        "*",
        valid.alias("is_valid"),
        (~clean).alias("needs_review"),
        F.when(clean, "1.0").when(valid, "0.7").otherwise("0.3").cast("decimal(5,2)").alias("confidence"),
        F.when(clean, "READY").otherwise("NEEDS_REVIEW").alias("status"),
    )


def validation_messages(extractions: DataFrame, lines: DataFrame, duplicates: str = "symmetric") -> DataFrame:
    """One row per finding: extraction_id, severity, kind, line_no, message."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))

    def finding(cond: Column | str, severity: str, kind: str, *message: Column) -> Column:
        cond = F.col(cond) if isinstance(cond, str) else cond
        return F.when(
            cond,
            F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("kind"), F.concat(*message).alias("message")),
        )

    expected = (F.col("subtotal") + F.col("vat_amount")).cast("decimal(13,2)").cast("string")
    checked = check_invoices(extractions, lines, duplicates)
    found = F.array_compact(
        F.array(
            finding("no_number", "error", "number", F.lit(P.NUMBER_REQUIRED)),
            finding("no_date", "error", "date", F.lit(P.DATE_REQUIRED)),
            finding("no_total", "error", "total", F.lit(P.TOTAL_REQUIRED)),
            finding("vat_malformed", "warning", "vat_format", F.lit(P.VAT_NUMBER_FORMAT)),
            finding("vat_missing", "warning", "vat_missing", F.lit(P.VAT_NUMBER_REQUIRED)),
            finding(
                "total_off", "warning", "total_mismatch",
                F.lit("Total mismatch: subtotal("), text("subtotal"), F.lit(") + VAT("), text("vat_amount"),
                F.lit(") = "), expected, F.lit(" but total is "), text("total"),
            ),
            finding(
                "items_off", "warning", "items_mismatch",
                F.lit("Items sum("), F.col("items_sum").cast("decimal(20,2)").cast("string"),
                F.lit(") ≠ subtotal("), text("subtotal"), F.lit(")"),
            ),
            finding(
                "is_duplicate", "error", "duplicate",
                F.lit("Duplicate invoice detected: "), text("supplier_vat_number"), F.lit(" / "), text("invoice_number"),
            ),
            finding(
                F.col("n_unmapped") > 0, "warning", "unmapped",
                F.col("n_unmapped").cast("string"), F.lit(P.LINES_UNMAPPED),
            ),
        )
    )
    of_headers = checked.select("extraction_id", F.explode(found).alias("f")).select(
        "extraction_id", "f.severity", "f.kind", F.lit(None).cast("int").alias("line_no"), "f.message"
    )
    of_lines = lines.where(line_mismatch()).select(
        "extraction_id",
        F.lit("warning").alias("severity"),
        F.lit("line_mismatch").alias("kind"),
        F.col("line_no").cast("int").alias("line_no"),
        F.concat(F.lit('Line item "'), text("raw_name"), F.lit('" total mismatch')).alias("message"),
    )
    # lines count only as part of an extraction that exists
    return of_headers.unionByName(of_lines.join(extractions.select("extraction_id"), "extraction_id", "left_semi"))


def validation_summary(messages: DataFrame) -> DataFrame:
    """How often each finding occurs, and in how many extractions."""
    per_extraction = messages.groupBy("extraction_id", "severity", "kind").agg(F.count("*").alias("n"))
    return per_extraction.groupBy("severity", "kind").agg(
        F.sum("n").alias("n_messages"), F.count("*").alias("n_extractions")
    )


def verdict_summary(verdicts: DataFrame, *by: str) -> DataFrame:
    """Shares of valid invoices and of invoices to review."""
    grouped = verdicts.rollup(*by) if by else verdicts.groupBy()
    return grouped.agg(
        F.count("*").alias("n_extractions"),
        F.round(F.avg(F.col("is_valid").cast("int")), 6).alias("valid_rate"),
        F.round(F.avg(F.col("needs_review").cast("int")), 6).alias("review_rate"),
    )


def approval_gate(extractions: DataFrame, detailed: bool = False) -> DataFrame:
    """Errors that block approval; here a wrong total is one of them. With ``detailed``, they state amounts and numbers."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    mismatch, duplicate = F.lit("Total mismatch"), F.lit("Duplicate invoice")
    if detailed:
        expected = (F.col("subtotal") + F.col("vat_amount")).cast("decimal(13,2)").cast("string")
        mismatch = F.concat(mismatch, F.lit(": "), text("subtotal"), F.lit(" + "), text("vat_amount"), F.lit(" = "), expected, F.lit(", not "), text("total"))
        duplicate = F.concat(duplicate, F.lit(": "), text("supplier_vat_number"), F.lit(" / "), text("invoice_number"))
    parts = F.array_compact(
        F.array(
            F.when(F.col("no_number"), P.NUMBER_REQUIRED),
            F.when(F.col("no_date"), P.DATE_REQUIRED),
            F.when(F.col("no_total"), P.TOTAL_REQUIRED),
            F.when(F.col("total_off"), mismatch),
            F.when(F.col("is_duplicate"), duplicate),
        )
    )
    return flag_duplicates(header_checks(extractions)).select(
        "extraction_id", F.nullif(F.array_join(parts, "; "), F.lit("")).alias("errors")
    )


def posting_gate(lines: DataFrame, key: str = "purchase_invoice_id") -> DataFrame:
    """Line faults per invoice that block posting to inventory."""
    positive = lambda c: F.coalesce(F.col(c) > 0, F.lit(False))
    return lines.groupBy(key).agg(
        F.count("*").alias("n_lines"),
        F.count_if(~filled("product_id")).alias("n_unmapped"),
        F.count_if(~positive("quantity")).alias("n_bad_quantity"),
        F.count_if(~positive("line_total")).alias("n_bad_total"),
    )


def route_status(verdicts: DataFrame) -> DataFrame:
    """Status events that follow from the verdicts."""
    return verdicts.select("upload_id", "status")
