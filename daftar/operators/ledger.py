"""Posting that happens once: tables of a batch appear together or not at all.

A batch writes its movements, journal lines, audit entries and status events, then which invoices
are posted now, and last a commit that makes all of them visible. Readers follow commits only, so
a batch that stopped half way is not seen; run again it overwrites what it left. A batch that is
already committed is not run a second time, and an invoice that any committed batch posted is
left out of later ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.operators import posting
from daftar.sources.snapshots import Snapshot, numbered, written

TABLES = {
    "movements": """purchase_invoice_id string, product_id string, movement_type string, quantity decimal(12,3), unit string,
                    unit_cost decimal(12,2), total_cost decimal(12,2), movement_date date""",
    "journal": """journal_entry_id string, purchase_invoice_id string, entry_date date, description string, entry_line int,
                  account_code string, account_name string, side string, amount decimal(12,2)""",
    "audit": """entity_type string, entity_id string, action string, old_value string, new_value string, user_id string,
                created_at timestamp""",
    "statuses": "upload_id string, status string, ts timestamp, seq long",
}
POSTED = "purchase_invoice_id string, inventory boolean, accounting boolean"


@dataclass(frozen=True)
class Ledger:
    path: str
    buckets: int = 64

    @property
    def posted(self) -> Snapshot:
        """Which invoices were posted, and where to."""
        return Snapshot(f"{self.path}/posted", POSTED, ("purchase_invoice_id",), self.buckets)

    def committed(self, spark: SparkSession) -> list[int]:
        """Committed batches, newest first."""
        return [n for n in numbered(spark, f"{self.path}/commits") if written(spark, f"{self.path}/commits", n)]

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """Rows of ``table`` of all committed batches."""
        paths = [f"{self.path}/{table}/batch={n}" for n in self.committed(spark)]
        return spark.read.schema(TABLES[table]).parquet(*paths) if paths else spark.createDataFrame([], TABLES[table])

    def post(self, purchase_invoices: DataFrame, lines: DataFrame, batch: int, at: Column) -> None:
        """Post what can be posted of ``purchase_invoices`` (with upload_id) to inventory and accounting, once."""
        spark = purchase_invoices.sparkSession
        before = self.committed(spark)
        if batch in before:
            return
        newest = before[0] if before else None
        mine = self.posted.touched(purchase_invoices)
        done = self.posted.read(spark, newest, mine) if before else spark.createDataFrame([], POSTED)
        movements = self._write(posting.post_inventory(purchase_invoices, lines, done.where("inventory")), "movements", batch)
        journal = self._write(posting.post_accounting(purchase_invoices, done.where("accounting")), "journal", batch)
        audit = posting.inventory_audit(movements, at).unionByName(posting.accounting_audit(journal, at))
        self._write(audit, "audit", batch)
        steps = [(movements, "inventory", "POSTED_TO_INVENTORY", 0), (journal.where("entry_line = 1"), "accounting", "POSTED_TO_ACCOUNTING", 1)]
        uploads = purchase_invoices.select("purchase_invoice_id", "upload_id")
        statuses, marks = None, None
        for rows, kind, status, nth in steps:
            ids = rows.select("purchase_invoice_id").distinct()
            # both happen at the time of the batch: accounting comes second
            event = ids.join(uploads, "purchase_invoice_id").select(
                "upload_id", F.lit(status).alias("status"), at.alias("ts"), F.lit(2 * batch + nth).cast("long").alias("seq")
            )
            mark = ids.select("purchase_invoice_id", *[F.lit(kind == k).alias(k) for k in ("inventory", "accounting")])
            statuses, marks = (event, mark) if statuses is None else (statuses.unionByName(event), marks.unionByName(mark))
        self._write(statuses, "statuses", batch)
        either = [F.max(c).alias(c) for c in ("inventory", "accounting")]
        self.posted.merge(marks, batch, either, mine, base=newest)
        self._write(audit.groupBy("action").agg(F.count("*").alias("n")), "commits", batch)

    def _write(self, df: DataFrame, table: str, batch: int) -> DataFrame:
        path = f"{self.path}/{table}/batch={batch}"
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
