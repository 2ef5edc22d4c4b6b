"""Posting approved invoices to inventory and accounting, and the audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions import patterns as P
from daftar.functions.text import MONEY
from daftar.operators.validate import filled, posting_gate


def not_yet_posted(purchase_invoices: DataFrame, posted: DataFrame) -> DataFrame:
    """Guard against posting an invoice twice."""
    return purchase_invoices.join(posted.select("purchase_invoice_id"), "purchase_invoice_id", "left_anti")


def inventory_rejects(purchase_invoices: DataFrame, lines: DataFrame) -> DataFrame:
    """Invoices that cannot be posted to inventory, and why."""
    n = lambda c: F.coalesce(c, F.lit(0))
    faults = F.array_compact(
        F.array(
            F.when(n("n_lines") == 0, P.NO_LINES_TO_POST),
            F.when(n("n_unmapped") > 0, F.concat(F.col("n_unmapped").cast("string"), F.lit(" line(s) have no product mapping"))),
            F.when(n("n_bad_quantity") > 0, F.concat(F.col("n_bad_quantity").cast("string"), F.lit(" line(s) have invalid quantity"))),
            F.when(n("n_bad_total") > 0, F.concat(F.col("n_bad_total").cast("string"), F.lit(" line(s) have invalid line total"))),
        )
    )
    return (
        purchase_invoices.select("purchase_invoice_id")
        .join(posting_gate(lines), "purchase_invoice_id", "left")
        .select("purchase_invoice_id", F.array_join(faults, "; ").alias("reason"))
        .where(F.col("reason") != "")
    )


def post_inventory(purchase_invoices: DataFrame, lines: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Stock movements of all invoices whose every line can be posted; those in ``posted`` (purchase_invoice_id) were before."""
    if posted is not None:
        purchase_invoices = not_yet_posted(purchase_invoices, posted)
    gate = posting_gate(lines).where("n_unmapped = 0 and n_bad_quantity = 0 and n_bad_total = 0")
    ready = purchase_invoices.select("purchase_invoice_id", "invoice_date").join(
        gate.select("purchase_invoice_id"), "purchase_invoice_id", "left_semi"
    )
    return lines.join(ready, "purchase_invoice_id").select(
        "purchase_invoice_id",
        "product_id",
        F.lit("IN").alias("movement_type"),
        "quantity",
        "unit",
        F.col("unit_price").alias("unit_cost"),
        F.col("line_total").alias("total_cost"),
        F.col("invoice_date").alias("movement_date"),
    )


def accounting_ready() -> Column:
    return F.col("invoice_date").isNotNull() & filled("invoice_number") & F.coalesce(F.col("total") > 0, F.lit(False))


def post_accounting(purchase_invoices: DataFrame, posted: DataFrame | None = None) -> DataFrame:
    """Journal lines, three per invoice; debits equal credits in every entry. Invoices in ``posted`` were entered before."""
    if posted is not None:
        purchase_invoices = not_yet_posted(purchase_invoices, posted)
    vat = F.coalesce("vat_amount", F.lit(0).cast(MONEY))
    amounts = [F.col("total") - vat, vat, F.col("total")]
    sides = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("entry_line"),
                F.lit(code).alias("account_code"),
                F.lit(name).alias("account_name"),
                F.lit(side).alias("side"),
                amount.cast(MONEY).alias("amount"),
            )
            for i, ((code, name, side), amount) in enumerate(zip(P.JOURNAL_ACCOUNTS, amounts))
        ]
    )
    return (
        purchase_invoices.where(accounting_ready())
        .select(
            F.concat(F.lit("je-"), F.col("purchase_invoice_id")).alias("journal_entry_id"),
            "purchase_invoice_id",
            F.col("invoice_date").alias("entry_date"),
            F.concat(F.lit("Purchase invoice "), F.col("invoice_number")).alias("description"),
            F.explode(sides).alias("s"),
        )
        .select("journal_entry_id", "purchase_invoice_id", "entry_date", "description", "s.*")
    )


def accounting_rejects(purchase_invoices: DataFrame) -> DataFrame:
    return purchase_invoices.where(~accounting_ready()).select(
        "purchase_invoice_id",
        F.when(F.col("invoice_date").isNull(), P.DATE_REQUIRED_FOR_ACCOUNTING)
        .when(~filled("invoice_number"), P.NUMBER_REQUIRED_FOR_ACCOUNTING)
        .otherwise(P.INVALID_TOTAL_FOR_ACCOUNTING)
        .alias("reason"),
    )


def audit_rows(
    df: DataFrame, entity: str, key: str, action: str, values: list, old: list | None = None, at: Column | None = None
) -> DataFrame:
    """Audit entries to append: one row per row of ``df``. With ``at``, also the old values (NULL if none) and the time."""
    user = F.col("user_id") if "user_id" in df.columns else F.lit(None).cast("string")
    before = F.to_json(F.struct(*old)) if old else F.lit(None).cast("string")
    return df.select(
        F.lit(entity).alias("entity_type"),
        F.col(key).alias("entity_id"),
        F.lit(action).alias("action"),
        *([before.alias("old_value")] if at is not None else []),
        F.to_json(F.struct(*values)).alias("new_value"),
        user.alias("user_id"),
        *([at.alias("created_at")] if at is not None else []),
    )


def inventory_audit(movements: DataFrame, at: Column) -> DataFrame:
    """One entry per invoice posted to inventory, with its number of movements."""
    n = movements.groupBy("purchase_invoice_id").agg(F.count("*").alias("movementsCreated"))
    return audit_rows(n, "purchase_invoice", "purchase_invoice_id", "POSTED_TO_INVENTORY", ["movementsCreated"], at=at)


def accounting_audit(journal: DataFrame, at: Column) -> DataFrame:
    """One entry per invoice posted to accounting, with its journal entry."""
    entries = journal.where("entry_line = 1").withColumn("journalEntryId", F.col("journal_entry_id"))
    return audit_rows(entries, "purchase_invoice", "purchase_invoice_id", "POSTED_TO_ACCOUNTING", ["journalEntryId"], at=at)


def approval_audit(approved: DataFrame, at: Column) -> DataFrame:
    """One entry per approved invoice; its upload's status before is the old value, if ``approved`` has it."""
    old = [F.col("old_status").alias("status")] if "old_status" in approved.columns else None
    values = [F.col("invoice_number").alias("invoiceNumber"), "total"]
    return audit_rows(approved, "purchase_invoice", "purchase_invoice_id", "APPROVED", values, old, at)


def review_audit(before: DataFrame, after: DataFrame, key: str, fields: list[str], at: Column) -> DataFrame:
    """One entry per row that a manual review changed, with the changed fields before and after."""
    b, a = (df.select(F.col(key), F.struct(*fields).alias(n)) for df, n in ((before, "b"), (after, "a")))
    changed = [~F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}")) for f in fields]
    any_change = F.array_contains(F.array(*changed), True)
    only = lambda side: [F.when(c, F.col(f"{side}.{f}")).alias(f) for f, c in zip(fields, changed)]
    return audit_rows(b.join(a, key).where(any_change), "invoice_extraction", key, "MANUAL_REVIEW_UPDATE", only("a"), only("b"), at)
