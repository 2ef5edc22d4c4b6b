"""Validation, mapping, review, posting and roll-ups on small cases."""

import datetime
import json
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from daftar.operators import mapping, posting, review, rollups, status, validate

DAY = datetime.date(2024, 1, 2)
EX = (
    "extraction_id string, upload_id string, supplier_name string, supplier_vat_number string, invoice_number string, "
    "invoice_date date, subtotal decimal(12,2), vat_amount decimal(12,2), total decimal(12,2), currency string, created_at timestamp"
)
LN = (
    "extraction_id string, line_id string, line_no int, raw_name string, quantity decimal(12,3), unit string, "
    "unit_price decimal(12,2), line_total decimal(12,2), product_id string, suggested_product_id string"
)
VAT = "310227420600003"


def at(s):
    return datetime.datetime(2024, 1, 1, 0, 0, s)


@pytest.fixture(scope="module")
def data(spark):
    ex = spark.createDataFrame(
        [
            ("ok", "u1", "S", VAT, "1", DAY, D("10"), D("1.5"), D("11.5"), "SAR", at(1)),
            ("edge", "u2", "S", VAT, "2", DAY, D("10"), D("1.5"), D("11.6"), "SAR", at(1)),
            ("off", "u3", "S", VAT, "3", DAY, D("10"), D("1.5"), D("11.61"), "SAR", at(1)),
            ("empty", "u4", None, None, "", None, None, None, D("0"), None, at(1)),
            ("usd", "u5", "S", "", "5", DAY, D("10"), D("0"), D("9"), "USD", at(1)),
            ("dup1", "u6", "S", "123", "6", DAY, None, None, D("9"), "SAR", at(1)),
            ("dup2", "u6", "S", "123", "6", DAY, None, None, D("9"), "SAR", at(2)),
        ],
        EX,
    )
    ln = spark.createDataFrame(
        [
            ("ok", "l1", 1, "tea", D("2"), None, D("5"), D("10"), "p1", None),
            ("edge", "l2", 1, "tea", D("2"), None, D("5"), D("10.10"), None, "s1"),
            ("off", "l3", 1, "cake", D("2"), None, D("5"), D("10.11"), None, None),
            ("usd", "l4", 1, "bun", D("0"), None, D("5"), D("-1"), "p2", None),
        ],
        LN,
    )
    return ex, ln


def test_verdicts(data):
    got = {r.extraction_id: (r.n_errors, r.n_warnings, float(r.confidence), r.status) for r in validate.validate_invoices(*data).collect()}
    assert got == {
        "ok": (0, 0, 1.0, "READY"),
        "edge": (0, 0, 1.0, "READY"),  # differences of exactly 0.1 are within tolerance
        "off": (0, 4, 0.7, "NEEDS_REVIEW"),
        "empty": (3, 1, 0.3, "NEEDS_REVIEW"),
        "usd": (0, 1, 0.7, "NEEDS_REVIEW"),
        "dup1": (1, 1, 0.3, "NEEDS_REVIEW"),
        "dup2": (1, 1, 0.3, "NEEDS_REVIEW"),
    }
    late = validate.validate_invoices(*data, duplicates="arrival").where("n_errors > 0").select("extraction_id").collect()
    assert sorted(r[0] for r in late) == ["dup2", "empty"]
    with pytest.raises(ValueError):
        validate.flag_duplicates(data[0], "sometimes")


def test_messages(data):
    got = {(r.extraction_id, r.kind): r.message for r in validate.validation_messages(*data).collect()}
    assert got["off", "total_mismatch"] == "Total mismatch: subtotal(10.00) + VAT(1.50) = 11.50 but total is 11.61"
    assert got["off", "items_mismatch"] == "Items sum(10.11) ≠ subtotal(10.00)"
    assert got["off", "line_mismatch"] == 'Line item "cake" total mismatch'
    assert got["off", "unmapped"] == "1 line item(s) have no product mapping"
    assert got["dup1", "duplicate"] == "Duplicate invoice detected: 123 / 6"
    assert got["dup1", "vat_format"] and got["empty", "vat_missing"] and len(got) == 15 - 2


def test_approval_and_posting(spark, data):
    ex, ln = data
    uploads = spark.createDataFrame(
        [(f"u{i}", "OCR_FAILED" if i == 2 else "READY", "image/png") for i in range(1, 7)], "upload_id string, status string, mime_type string"
    )
    done = spark.createDataFrame([("u5",)], "upload_id string")
    decided = review.approval_decisions(ex, uploads, done)
    got = {r.extraction_id: r.reject_reason for r in decided.collect()}
    assert got == {
        "ok": None,
        "edge": "Cannot approve a failed invoice",
        "off": "Cannot approve: Total mismatch",
        "empty": "Cannot approve: Invoice number is required; Invoice date is required; Total amount is required",
        "usd": "Invoice already approved",
        "dup2": "Cannot approve: Duplicate invoice",
    }
    pi = review.approve_batch(decided)
    lines = review.approve_lines(pi, ln)
    moves = posting.post_inventory(pi, lines).collect()
    assert [(m.product_id, m.movement_type, m.quantity, m.total_cost) for m in moves] == [("p1", "IN", D("2.000"), D("10.00"))]
    journal = posting.post_accounting(pi)
    assert [(r.account_code, r.side, r.amount) for r in journal.orderBy("entry_line").collect()] == [
        ("1200", "DR", D("10.00")), ("2400", "DR", D("1.50")), ("2100", "CR", D("11.50")),
    ]
    assert rollups.unbalanced_entries(journal).isEmpty()
    assert posting.not_yet_posted(pi, posting.post_inventory(pi, lines)).isEmpty()
    assert posting.inventory_rejects(pi, lines.limit(0)).first().reason == "No lines to post to inventory"
    view = review.review_view(uploads, ex, ln).collect()
    assert len(view) == 6 and {r.extraction_id for r in view} == {"ok", "edge", "off", "empty", "usd", "dup2"}
    rejected = review.reject_batch(ex, spark.createDataFrame([("u6", "blurred", "me")], "upload_id string, reason string, user_id string")).first()
    assert (rejected.entity_id, rejected.action, json.loads(rejected.new_value), rejected.user_id) == ("dup2", "REJECTED", {"reason": "blurred"}, "me")


def test_missing_vat_posts_a_zero_row(spark):
    pi = spark.createDataFrame(
        [("p", DAY, "7", None, D("5")), ("q", None, "7", None, D("5")), ("r", DAY, "", None, D("5")), ("s", DAY, "7", None, D("0"))],
        "purchase_invoice_id string, invoice_date date, invoice_number string, vat_amount decimal(12,2), total decimal(12,2)",
    )
    assert [r.amount for r in posting.post_accounting(pi).orderBy("entry_line").collect()] == [D("5"), D("0"), D("5")]
    assert {r.purchase_invoice_id: r.reason[:14] for r in posting.accounting_rejects(pi).collect()} == {
        "q": "Invoice date i", "r": "Invoice number", "s": "Invalid total ",
    }


def test_patches(spark, data):
    ex, ln = data
    patches = spark.createDataFrame(
        [("u1", {"total": "12", "supplier_name": None, "nonsense": "x"}, at(2)), ("u1", {"total": "99"}, at(1))],
        "upload_id string, fields map<string,string>, patched_at timestamp",
    )
    got = review.apply_header_patch(ex, patches).where("upload_id = 'u1'").first()
    assert (got.total, got.supplier_name, got.invoice_number) == (D("12.00"), None, "1")
    lp = spark.createDataFrame([("l3", {"product_id": "p9", "quantity": None}, at(1))], "line_id string, fields map<string,string>, patched_at timestamp")
    got = review.apply_line_patch(ln, lp).where("line_id = 'l3'").first()
    assert (got.product_id, got.quantity, got.line_total) == ("p9", None, D("10.11"))


def test_similar_names_against_all_pairs(spark):
    rng = random.Random(3)
    hot, rare = ["red", "big", "tea"], [f"w{i}" for i in range(14)]
    make = lambda: " ".join(rng.choices(hot * 4 + rare, k=rng.randint(1, 7)))
    left, right = {make() for _ in range(250)} | {"", "a  b"}, {make() for _ in range(250)} | {"", "a  b"}

    def score(a, b):
        x, y = set(a.split(" ")), set(b.split(" "))
        return len(x & y) / len(x | y)

    expected = {(a, b): score(a, b) for a in left for b in right if score(a, b) > 0.5}
    as_df = lambda names: spark.createDataFrame([(n,) for n in names], "name string")
    rows = mapping.similar_names(as_df(left), as_df(right)).collect()
    assert len(rows) == len(expected) > 300  # every pair once
    assert {(r.name, r.match): r.score for r in rows} == pytest.approx(expected)


MAP = (
    "mapping_id string, supplier_id string, normalized_name string, product_id string, source_unit string, target_unit string, "
    "conversion_factor decimal(12,4), confidence decimal(5,2), updated_at timestamp"
)


def test_suggestions(spark):
    m = spark.createDataFrame(
        [("m0", "s1", "red plate", "p0", "box", "kg", D("5"), D("1"), at(1)), ("m1", "s2", "red plate", "p1", None, None, None, D("1"), at(1))]
        + [(f"m{i}", None, f"large red plate {'x' * i}", f"p{i}", None, None, None, D("1"), at(1)) for i in range(2, 9)],
        MAP,
    )
    lines = spark.createDataFrame(
        [("a", "RED  Plate", None), ("b", "Red Plate", "s2"), ("c", "large red plate", None), ("d", "green cup", None)],
        "line_id string, raw_name string, supplier_id string",
    )
    got = {}
    for r in mapping.suggest_mappings(lines, m).collect():
        got.setdefault(r.line_id, []).append((r.mapping_id, r.method))
    assert sorted(got["a"]) == [("m0", "exact"), ("m1", "exact")] and got["b"] == [("m1", "exact")]
    # scores 3/4 for the longer names, 2/3 for the shorter: five best, ties by id
    assert sorted(got["c"]) == [(f"m{i}", "fuzzy") for i in range(2, 7)] and "d" not in got
    best = {r.line_id: r.suggested_product_id for r in mapping.fill_suggestions(lines, m).collect()}
    assert best == {"a": "p0", "b": "p1", "c": "p2", "d": None}


def test_upsert(spark):
    m = spark.createDataFrame(
        [("m0", "s1", "red plate", "p0", "box", "kg", D("5"), D("0.5"), at(1)), ("m1", None, "red plate", "p1", "box", "kg", D("5"), D("0.5"), at(1))], MAP
    )
    saves = spark.createDataFrame(
        [("Red Plate", None, "p7", "LITER", None, at(3)), ("red plate", None, "p6", None, None, at(2)), ("Cup", "s1", "p8", None, "bag", at(2))],
        "raw_name string, supplier_id string, product_id string, source_unit string, target_unit string, updated_at timestamp",
    )
    got = {(r.supplier_id, r.normalized_name): r for r in mapping.upsert_mappings(m, saves).collect()}
    assert len(got) == 3 and got["s1", "red plate"].product_id == "p0" and got["s1", "red plate"].confidence == D("0.50")
    r = got[None, "red plate"]
    assert (r.mapping_id, r.product_id, r.target_unit, r.conversion_factor, r.confidence) == ("m1", "p7", "ml", D("1000"), D("1"))
    assert (got["s1", "cup"].product_id, got["s1", "cup"].target_unit) == ("p8", "bag")


def test_status_rules(spark):
    rows = [("a", 1, 1, "QUEUED"), ("a", 2, 5, "PROCESSING_OCR"), ("b", 3, 4, "OCR_FAILED"), ("b", 4, 4, "READY")] + [("c", 5 + i, i, "OCR_FAILED") for i in range(3)]
    events = spark.createDataFrame(rows, "upload_id string, seq long, s int, status string").withColumn("ts", F.timestamp_seconds("s"))
    current = status.current_status(events)
    assert {r.upload_id: r.status for r in current.collect()} == {"a": "PROCESSING_OCR", "b": "READY", "c": "OCR_FAILED"}
    assert {r.status: (r.bucket, r.reviewable) for r in status.status_buckets(current).collect()} == {
        "PROCESSING_OCR": ("processing", False), "READY": ("done", True), "OCR_FAILED": ("failed", False),
    }
    assert [r.upload_id for r in status.failed_after_retries(events).collect()] == ["c"]
    stuck = lambda s: status.stuck_documents(current, F.timestamp_seconds(F.lit(s))).count()
    assert (stuck(125), stuck(126)) == (0, 1)


def test_stock(spark):
    rows = [("p", datetime.date(2024, 1, d), D(q), D(c)) for d, q, c in [(1, "2", "4"), (1, "1", "5"), (3, "1", "1")]]
    moves = spark.createDataFrame(rows, "product_id string, movement_date date, quantity decimal(12,3), total_cost decimal(12,2)")
    assert rollups.stock_ledger(moves).first().mean_unit_cost == D("2.5")
    assert [(r.movement_date.day, r.balance, r.balance_cost) for r in rollups.stock_balance(moves).orderBy("movement_date").collect()] == [
        (1, D("3.000"), D("9.00")), (3, D("4.000"), D("10.00")),
    ]


def test_patches_add_up_and_meet_the_newest_extraction(spark):
    ex = spark.createDataFrame(
        [("old", "u", at(1), "A", "1"), ("new", "u", at(2), "B", "2")],
        "extraction_id string, upload_id string, created_at timestamp, supplier_name string, invoice_number string",
    )
    patches = spark.createDataFrame(
        [("u", {"supplier_name": "C"}, at(3)), ("u", {"invoice_number": "9"}, at(4)), ("u", {"supplier_name": None}, at(5))],
        "upload_id string, fields map<string,string>, patched_at timestamp",
    )
    got = {r.extraction_id: (r.supplier_name, r.invoice_number) for r in review.apply_header_patch(ex, patches).collect()}
    assert got == {"old": ("A", "1"), "new": (None, "9")}


def test_nothing_is_posted_twice(spark):
    from daftar.operators.posting import post_accounting

    pi = spark.createDataFrame(
        [("p1", at(1).date(), "1", "10.00", None), ("p2", at(1).date(), "2", "10.00", None)],
        "purchase_invoice_id string, invoice_date date, invoice_number string, total string, vat_amount string",
    ).selectExpr("purchase_invoice_id", "invoice_date", "invoice_number", "cast(total as decimal(12,2)) total", "cast(vat_amount as decimal(12,2)) vat_amount")
    done = spark.createDataFrame([("p1",)], "purchase_invoice_id string")
    assert {r.purchase_invoice_id for r in post_accounting(pi, done).collect()} == {"p2"}
