"""Posting once, the status log, and audit entries."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from daftar.operators import posting
from daftar.operators.ledger import Ledger
from daftar.operators.status import current_status
from daftar.operators.status_log import StatusLog, approval_events, verdict_events



def at():
    return F.lit(dt.datetime(2024, 3, 1)).cast("timestamp")


def invoices(spark, *ids):
    rows = [(f"pi-{i}", f"up-{i}", str(i), dt.date(2024, 1, 1), Decimal("10.00"), Decimal("1.50"), Decimal("11.50")) for i in ids]
    return spark.createDataFrame(
        rows, "purchase_invoice_id string, upload_id string, invoice_number string, invoice_date date, subtotal decimal(12,2), vat_amount decimal(12,2), total decimal(12,2)"
    )


def lines(spark, *ids):
    rows = [(f"pi-{i}", None if i == 9 else "p-1", "x", Decimal("2.000"), "pcs", Decimal("5.00"), Decimal("10.00")) for i in ids for _ in range(2)]
    return spark.createDataFrame(
        rows, "purchase_invoice_id string, product_id string, raw_name string, quantity decimal(12,3), unit string, unit_price decimal(12,2), line_total decimal(12,2)"
    )


def counts(spark, ledger):
    return {t: ledger.read(spark, t).count() for t in ("movements", "journal", "audit", "statuses")}


def test_a_batch_that_was_killed_posts_once(spark, tmp_path, monkeypatch):
    ledger, every = Ledger(str(tmp_path / "ledger"), 4), (1, 2, 3, 9)
    ledger.post(invoices(spark, 1), lines(spark, *every), 0, at())
    first = {"movements": 2, "journal": 3, "audit": 2, "statuses": 2}
    assert counts(spark, ledger) == first
    write = Ledger._write
    # killed after each of the batch's tables: nothing of it is seen, and the next try begins anew
    for last in ("movements", "journal", "audit", "statuses", "commits"):

        def until(self, df, table, batch, last=last):
            if table == last:
                raise RuntimeError("killed")
            return write(self, df, table, batch)

        monkeypatch.setattr(Ledger, "_write", until)
        with pytest.raises(RuntimeError):
            ledger.post(invoices(spark, 1, 2, 3, 9), lines(spark, *every), 1, at())
        monkeypatch.setattr(Ledger, "_write", write)
        assert counts(spark, ledger) == first
    # a further batch after the stopped one is not misled by what that had marked as posted
    ledger.post(invoices(spark, 1, 2), lines(spark, *every), 2, at())
    assert counts(spark, ledger) == {"movements": 4, "journal": 6, "audit": 4, "statuses": 4}
    ledger.post(invoices(spark, *every), lines(spark, *every), 3, at())
    done = {"movements": 6, "journal": 12, "audit": 7, "statuses": 7}
    assert counts(spark, ledger) == done
    ledger.post(invoices(spark, *every), lines(spark, *every), 3, at())  # committed before
    ledger.post(invoices(spark, *every), lines(spark, *every), 4, at())
    assert counts(spark, ledger) == done
    movements = ledger.read(spark, "movements").groupBy("purchase_invoice_id").count().collect()
    assert {r.purchase_invoice_id: r["count"] for r in movements} == {"pi-1": 2, "pi-2": 2, "pi-3": 2}
    got = {(r.entity_id, r.action): (r.old_value, r.new_value, r.created_at) for r in ledger.read(spark, "audit").collect()}
    assert got["pi-9", "POSTED_TO_ACCOUNTING"] == (None, '{"journalEntryId":"je-pi-9"}', dt.datetime(2024, 3, 1))
    assert got["pi-1", "POSTED_TO_INVENTORY"][1] == '{"movementsCreated":2}' and ("pi-9", "POSTED_TO_INVENTORY") not in got
    latest = {r.upload_id: r.status for r in current_status(ledger.read(spark, "statuses")).collect()}
    assert latest == dict.fromkeys(["up-1", "up-2", "up-3", "up-9"], "POSTED_TO_ACCOUNTING")


def test_an_invoice_that_cannot_be_posted_is_tried_again(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "ledger"), 4)
    undated = invoices(spark, 9).withColumn("invoice_date", F.lit(None).cast("date"))
    ledger.post(undated, lines(spark, 9), 0, at())
    assert counts(spark, ledger) == {"movements": 0, "journal": 0, "audit": 0, "statuses": 0}
    ledger.post(invoices(spark, 9), lines(spark, 9), 1, at())
    ledger.post(invoices(spark, 9), lines(spark, 9), 2, at())
    assert counts(spark, ledger) == {"movements": 0, "journal": 3, "audit": 1, "statuses": 1}


def test_an_empty_ledger(spark, tmp_path):
    ledger = Ledger(str(tmp_path / "ledger"), 4)
    assert counts(spark, ledger) == {"movements": 0, "journal": 0, "audit": 0, "statuses": 0}
    ledger.post(invoices(spark), lines(spark), 0, at())
    assert ledger.committed(spark) == [0] and counts(spark, ledger)["audit"] == 0


def test_reviews_and_approvals_leave_old_and_new_values(spark):
    before = spark.createDataFrame([("e1", "1", 5, "a"), ("e2", None, 6, "b")], "extraction_id string, invoice_number string, total int, x string")
    after = spark.createDataFrame([("e1", "2", 5, "c"), ("e2", None, 6, "d")], before.schema)
    rows = posting.review_audit(before, after, "extraction_id", ["invoice_number", "total"], at()).collect()
    assert [(r.entity_id, r.action, r.old_value, r.new_value) for r in rows] == [("e1", "MANUAL_REVIEW_UPDATE", '{"invoice_number":"1"}', '{"invoice_number":"2"}')]
    approved = invoices(spark, 4).withColumn("old_status", F.lit("READY"))
    row = posting.approval_audit(approved, at()).first()
    assert (row.action, row.old_value, row.new_value) == ("APPROVED", '{"status":"READY"}', '{"invoiceNumber":"4","total":11.50}')


def test_the_status_log_equals_a_scan_of_all_events(spark, tmp_path):
    log, all_events = StatusLog(str(tmp_path / "log"), 4), None

    def same():
        got, want = ({tuple(r) for r in df.select("upload_id", "status", "since", "n_events").collect()} for df in (log.current(spark), current_status(all_events)))
        return got == want

    for batch in range(6):
        ids = spark.range(20 * batch, 20 * batch + 60).withColumn("upload_id", F.concat(F.lit("u"), F.col("id") % 70))
        ts = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 1000)
        events = (approval_events if batch % 2 else lambda df, t, s: verdict_events(df.withColumn("status", F.lit("READY")), t, s))(ids, ts, F.col("id") * 10 + batch)
        log.append(events, batch)
        log.append(events, batch)  # twice is once
        all_events = events if all_events is None else all_events.unionByName(events)
        assert same()
        if batch in (0, 3):
            log.compact(spark)
            log.compact(spark)
            assert same() and log.since(spark, log.snapshot.latest(spark)) == []
            log.append(events, batch)  # late retry of a compacted batch
            assert same()
    assert log.since(spark, log.snapshot.latest(spark)) == [4, 5]
