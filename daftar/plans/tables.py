"""Structured inputs derived from the given tables, for the steps after extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions.text import MONEY
from daftar.plans.rendered import order_items, order_totals, table


def _text(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def extractions(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """Extracted headers with faults: missing fields, odd VAT numbers, wrong totals, duplicates.

    Three consecutive orders share an upload, the latest by order date being current. With
    ``every``, orders without items have one too, of amounts zero.
    """
    k = F.col("order_key")
    unless = lambda n, c: F.when(k % n != 0, c)
    return order_totals(spark, sf, every).select(
        F.concat(F.lit("ex-"), _text("order_key")).alias("extraction_id"),
        F.concat(F.lit("up-"), _text(F.floor(k / 3))).alias("upload_id"),
        F.concat(F.lit("Customer "), _text("o_custkey")).alias("supplier_name"),
        F.when(k % 29 == 0, "12345").otherwise(unless(13, F.col("vat_number"))).alias("supplier_vat_number"),
        unless(7, _text(k % 40)).alias("invoice_number"),
        unless(31, F.col("o_orderdate").cast("date")).alias("invoice_date"),
        "subtotal",
        F.col("vat").alias("vat_amount"),
        unless(37, F.col("total")).alias("total"),
        F.when(k % 41 == 0, "USD").otherwise("SAR").alias("currency"),
        F.col("o_orderdate").alias("created_at"),
    )


def extraction_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Their lines; parts with a key divisible by 10 are not mapped to a product."""
    pk = F.col("part_key")
    ex = F.concat(F.lit("ex-"), _text("order_key"))
    return order_items(spark, sf).select(
        ex.alias("extraction_id"),
        F.concat(ex, F.lit("-"), _text("item_no")).alias("line_id"),
        F.col("item_no").alias("line_no"),
        F.col("name").alias("raw_name"),
        F.col("qty").alias("quantity"),
        F.when(pk % 4 == 0, "Box").when(pk % 4 == 1, "pcs").when(pk % 4 == 2, "كرتون").alias("unit"),
        F.round(F.col("amount") / F.col("qty"), 2).cast(MONEY).alias("unit_price"),
        F.col("amount").alias("line_total"),
        F.when(pk % 10 != 0, F.concat(F.lit("p-"), _text("part_key"))).alias("product_id"),
        F.lit(None).cast("string").alias("suggested_product_id"),
    )


def uploads(spark: SparkSession, sf: str) -> DataFrame:
    """One upload per three orders, with the status its orders ask for."""
    k = F.col("o_orderkey")
    return (
        table(spark, sf, "orders")
        .groupBy(F.floor(k / 3).alias("u"))
        .agg(F.max("o_orderdate").alias("created_at"))
        .select(
            F.concat(F.lit("up-"), _text("u")).alias("upload_id"),
            F.when(F.col("u") % 17 == 0, "OCR_FAILED").otherwise("NEEDS_REVIEW").alias("status"),
            F.lit("image/png").alias("mime_type"),
            "created_at",
        )
    )


def approved_uploads(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads that already have a purchase invoice."""
    return uploads(spark, sf).where(F.substring("upload_id", -1, 1) == "5").select("upload_id")


def purchase_invoices(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """Purchase invoices, one per order with lines (or ``every`` order); some without date, number or VAT."""
    k = F.col("order_key")
    return order_totals(spark, sf, every).select(
        F.concat(F.lit("pi-"), _text("order_key")).alias("purchase_invoice_id"),
        F.concat(F.lit("ex-"), _text("order_key")).alias("extraction_id"),
        "vat_number",
        F.col("vat_number").alias("supplier_vat_number"),
        F.when(k % 7 != 0, _text("order_key")).alias("invoice_number"),
        F.when(k % 31 != 0, F.col("o_orderdate").cast("date")).alias("invoice_date"),
        "subtotal",
        F.when(k % 23 != 0, F.col("vat")).alias("vat_amount"),
        "total",
    )


def purchase_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of the purchase invoices; a product is missing, or a quantity zero, now and then."""
    pk = F.col("part_key")
    return order_items(spark, sf).select(
        F.concat(F.lit("pi-"), _text("order_key")).alias("purchase_invoice_id"),
        F.when(pk % 50 != 0, F.concat(F.lit("p-"), _text("part_key"))).alias("product_id"),
        F.col("name").alias("raw_name"),
        F.when(pk % 60 != 7, F.col("qty")).otherwise(0).cast("decimal(12,3)").alias("quantity"),
        F.lit("pcs").alias("unit"),
        F.round(F.col("amount") / F.col("qty"), 2).cast(MONEY).alias("unit_price"),
        F.col("amount").alias("line_total"),
    )


def name_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor item names as lines: some known exactly, some with a further word."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    part = table(spark, sf, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    name = F.when(F.col("l_linenumber") % 2 == 1, F.concat_ws(" ", "p_name", "p_type")).otherwise(
        F.concat_ws(" ", "p_name", "p_brand", "p_type")
    )
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("line_id"),
        F.upper(name).alias("raw_name"),
        F.col("l_quantity").cast("decimal(12,3)").alias("quantity"),
        F.lit("box").alias("unit"),
        F.lit(None).cast("string").alias("suggested_product_id"),
    )


def mappings(spark: SparkSession, sf: str) -> DataFrame:
    """Known vendor item names: name and type, and name and brand, of every part."""
    part = table(spark, sf, "part")
    both = part.select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("n")).unionByName(
        part.select("p_partkey", F.lower(F.concat_ws(" ", "p_name", "p_brand")).alias("n"))
    )
    known = both.groupBy("n").agg(F.min("p_partkey").alias("pk"))
    return known.select(
        F.concat(F.lit("m-"), F.col("n")).alias("mapping_id"),
        F.lit(None).cast("string").alias("supplier_id"),
        F.col("n").alias("normalized_name"),
        F.concat(F.lit("p-"), _text("pk")).alias("product_id"),
        F.lit("box").alias("source_unit"),
        F.lit("kg").alias("target_unit"),
        F.lit(5).cast("decimal(12,4)").alias("conversion_factor"),
        F.lit("0.90").cast("decimal(5,2)").alias("confidence"),
        F.to_timestamp(F.lit("2020-01-01 00:00:00")).alias("updated_at"),
    )


def product_names(spark: SparkSession, sf: str) -> DataFrame:
    """Mappings of part names as they stand on invoices; names of parts with a key divisible by 10 are not known."""
    part = table(spark, sf, "part").select("p_partkey", F.lower("p_name").alias("n"))
    known = part.groupBy("n").agg(F.min("p_partkey").alias("pk")).where("pk % 10 <> 0")
    return known.select(
        F.concat(F.lit("n-"), F.col("n")).alias("mapping_id"),
        F.lit(None).cast("string").alias("supplier_id"),
        F.col("n").alias("normalized_name"),
        F.concat(F.lit("p-"), _text("pk")).alias("product_id"),
    )


def status_events(spark: SparkSession, sf: str) -> DataFrame:
    """Job events: status and error code from the event stream."""
    return as_status_events(table(spark, sf, "events"))


def as_status_events(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "view", "QUEUED")
        .when(kind == "click", "PROCESSING_OCR")
        .when(kind == "purchase", "READY")
        .when(kind == "signup", "NEEDS_REVIEW")
        .otherwise("OCR_FAILED")
    )
    code = F.when(F.col("event_id") % 2 == 0, "OCR_TIMEOUT").otherwise("OCR_EMPTY_RESULT")
    return events.select(
        F.concat(F.lit("up-"), _text("user_id")).alias("upload_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        status.alias("status"),
        F.when(kind == "error", code).alias("error_code"),
        "value",
    )
