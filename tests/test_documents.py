"""Sources, document assembly, OCR pass choice, QR payloads."""

import base64
import json

import pytest
from pyspark.sql import functions as F

from daftar.operators.assemble import (
    choose_ocr_pass,
    document_markdown,
    document_summary,
    empty_document_warning,
    low_confidence_documents,
    page_summary,
    select_ocr_pass,
)
from daftar.operators.chunks import document_chunks
from daftar.operators.headers import extract_headers, header_lines
from daftar.operators.keyword_amounts import amount_by_keywords
from daftar.operators.qr import decode_qr_table
from daftar.sources.ocr import flatten_legacy_result, flatten_ocr_result, rejected_results, result_lines, scan_ocr_json
from daftar.sources.tables import read_table, write_table
from daftar.sources.uploads import accepted_uploads, admit_uploads, delete_uploads, list_uploads

ARABIC = [
    ("فاتورة# 101347", 0.95, 10.0, 10.0, 200.0, 30.0),
    ("باباكا تشوكلت", 0.92, 10.0, 40.0, 200.0, 60.0),
    ("SAR 17.00", 0.98, 220.0, 40.0, 300.0, 60.0),
    ("المجموع الفرعي SAR 86.96", 0.96, 10.0, 200.0, 300.0, 220.0),
]
LINES = "doc_id string, page_no int, line_no int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"


def corners(x1, y1, x2, y2):
    return [[x1, y1], [x2, y1], [x2, y2], [x1, y2]]


def test_engine_forms_agree(spark):
    new = spark.createDataFrame(
        [("a", 1, [t for t, *_ in ARABIC], [c for _, c, *_ in ARABIC], [corners(*b) for _, _, *b in ARABIC])],
        "doc_id string, page_no int, rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>",
    )
    page = [(corners(*b), t, c) for t, c, *b in ARABIC]
    old = spark.createDataFrame(
        [("a", [page, page])],
        "doc_id string, pages array<array<struct<polygon:array<array<double>>,text:string,confidence:double>>>",
    )
    expected = [("a", 1, i, *line) for i, line in enumerate(ARABIC)]
    assert sorted(map(tuple, flatten_ocr_result(new).collect())) == expected
    assert sorted(map(tuple, flatten_legacy_result(old).collect())) == expected


def test_missing_scores_and_boxes(spark):
    df = spark.createDataFrame(
        [("a", 1, ["x", "y"], [0.5], []), ("b", 1, [], [], [])],
        "doc_id string, page_no int, rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>",
    )
    got = sorted(map(tuple, flatten_ocr_result(df).collect()))
    assert got == [("a", 1, 0, "x", 0.5, 0.0, 0.0, 500.0, 25.0), ("a", 1, 1, "y", 0.0, 0.0, 30.0, 500.0, 55.0)]


def test_scan_json(spark, tmp_path):
    box = {"x1": 1, "y1": 2, "x2": 3, "y2": 4}
    doc = {
        "doc_id": "d",
        "pages": [
            {"pageNumber": 1, "lines": [{"text": "a", "confidence": 0.5, "box": box}]},
            {"pageNumber": 2, "lines": [{"text": "b", "confidence": 0.7, "box": box}]},
        ],
    }
    (tmp_path / "one.json").write_text(json.dumps(doc) + "\n{broken\n", encoding="utf8")
    scanned = scan_ocr_json(spark, str(tmp_path)).cache()
    assert [(r.page_no, r.line_no, r.text) for r in result_lines(scanned).orderBy("line_no").collect()] == [(1, 0, "a"), (2, 1, "b")]
    assert [r[0] for r in rejected_results(scanned).collect()] == ["{broken"]


def test_summaries(spark):
    rows = [("d", 1, 0, "a", 0.5, 0.0, 9.0, 0.0, 0.0), ("d", 2, 1, "b", 1.0, 0.0, 1.0, 0.0, 0.0), ("d", 2, 2, "c", 1.0, 0.0, 9.0, 0.0, 0.0)]
    # far enough down to fall into another slice of the joined text
    rows += [("d", 2, 5000, "z", 0.9, 0.0, 0.5, 0.0, 0.0)]
    lines = spark.createDataFrame(rows, LINES)
    docs = spark.createDataFrame([("d",), ("e",)], "doc_id string")
    pages = {r.page_no: r for r in page_summary(lines).collect()}
    assert (pages[1].raw_text, pages[2].raw_text, pages[2].confidence) == ("a", "b\nc\nz", 0.9667)
    whole = {r.doc_id: r for r in document_summary(lines, docs).collect()}
    assert (whole["d"].raw_text, whole["d"].confidence) == ("a\nb\nc\nz", 0.85)
    assert (whole["e"].raw_text, whole["e"].n_lines, whole["e"].confidence) == ("", 0, 0.0)
    assert document_markdown(lines).first().markdown == "z\nb\na\nc"
    assert [tuple(r) for r in empty_document_warning(docs, lines).collect()] == [("e", "OCR produced no text lines")]
    assert low_confidence_documents(document_summary(lines, docs)).select("doc_id").collect() == [("e",)]


def test_pass_choice(spark):
    def lines(**docs):
        return spark.createDataFrame(
            [(d, 2, i, f"{d}{i}", c, 0.0, 0.0, 0.0, 0.0) for d, cs in docs.items() for i, c in enumerate(cs)], LINES
        )

    docs = spark.createDataFrame(
        [(d, "vl" if d == "other" else "hybrid") for d in ("up", "same", "good", "none", "other", "lost")], "doc_id string, engine string"
    )
    standard = lines(up=[0.5], same=[0.6], good=[0.9], other=[0.1], lost=[0.7])
    enhanced = lines(up=[0.9, 0.7], same=[0.6], good=[1.0], none=[1.0], other=[0.9])
    choice = choose_ocr_pass(docs, standard, enhanced)
    got = {r.doc_id: (r.used_enhanced, r.confidence, r.warning) for r in choice.collect()}
    assert got["up"] == (True, 0.8, None)
    assert got["same"] == (False, 0.6, "Enhanced fallback did not improve confidence (0.60 vs 0.60)")
    assert got["lost"][2] == "Enhanced fallback did not improve confidence (0.00 vs 0.70)"
    assert got["good"] == (False, 0.9, None) and got["none"] == (False, 0.0, None) and not got["other"][0]
    chosen = select_ocr_pass(choice, standard, enhanced).select("doc_id", "page_no", "text").collect()
    assert ("up", 1, "up1") in chosen and ("same", 2, "same0") in chosen and len(chosen) == 6
    off = choose_ocr_pass(docs, standard, enhanced, enabled=False)
    assert not any(r.used_enhanced or r.warning for r in off.collect())


def record(tag, value):
    return bytes([tag, len(value)]) + value


@pytest.mark.parametrize(
    "payload, expected",
    [
        (base64.b64encode(record(1, b"Test") + record(2, b"310227420600003")).decode(), ("Test", "310227420600003", None)),
        ("not-base64!!", (None, None, None)),
        (base64.b64encode(record(1, b"A") + record(1, b"B") + bytes([2, 9]) + b"short").decode(), ("B", None, None)),
        (base64.b64encode(record(4, b"12.50") + record(9, b"x") + b"\x05").decode(), (None, None, "12.50")),
        (" " + base64.b64encode(record(1, "مورد".encode())).decode() + "\n", ("مورد", None, None)),
        (base64.b64encode(record(1, b"\xff")).decode(), ("�", None, None)),
        (base64.b64encode(b"".join(record(7, b"") for _ in range(100)) + record(2, b"9")).decode(), (None, "9", None)),
        ("", (None, None, None)),
        (None, (None, None, None)),
    ],
)
def test_qr(spark, payload, expected):
    r = decode_qr_table(spark.createDataFrame([("d", payload)], "doc_id string, payload string")).first()
    assert (r.seller_name, r.vat_number, r.total) == expected


def test_uploads(spark, tmp_path):
    mb = 1024 * 1024
    files = spark.createDataFrame(
        [
            ("a", "x.JPG", "image/jpeg", 20 * mb, 1), ("b", "x.jpg", "image/gif", 1, 2), ("c", "x.png", "image/png", 20 * mb + 1, 3),
            ("d", "x.gif", "image/png", 1, 3), ("e", ".png", "image/png", 1, 4), ("f", "x.y.pdf", "application/pdf", 1, 5), ("g", "x.pdf", None, 1, 6),
        ],
        "upload_id string, file_name string, mime_type string, size_bytes long, t int",
    ).withColumn("created_at", F.timestamp_seconds("t"))
    got = {r.upload_id: r.reject_reason for r in admit_uploads(files).collect()}
    assert got == {
        "a": None, "b": "invalid file type", "c": "file too large", "d": "invalid file extension",
        "e": "invalid file extension", "f": None, "g": "invalid file type",
    }
    assert [r.upload_id for r in list_uploads(files).collect()] == ["g", "f", "e", "c", "d", "b", "a"]
    keys = spark.createDataFrame([("a",), ("zz",)], "upload_id string")
    left, unknown = delete_uploads(accepted_uploads(files), keys)
    assert [r.upload_id for r in left.collect()] == ["f"] and [r.upload_id for r in unknown.collect()] == ["zz"]
    write_table(files, str(tmp_path), "uploads")
    assert read_table(spark, str(tmp_path), "uploads").count() == 7


def test_lines_of_several_pages_count_through(spark):
    df = spark.createDataFrame(
        [("a", 2, ["p2a", "p2b\nmore"], [0.5, 0.25], []), ("a", 1, ["p1a", "p1b"], [], []), ("a", 3, ["p3a"], [], [])],
        "doc_id string, page_no int, rec_texts array<string>, rec_scores array<double>, dt_polys array<array<array<double>>>",
    )
    got = sorted((r.line_no, r.page_no, r.text, r.y1) for r in flatten_ocr_result(df).collect())
    assert got == [(0, 1, "p1a", 0.0), (1, 1, "p1b", 30.0), (2, 2, "p2a", 0.0), (3, 2, "p2b", 30.0), (4, 2, "more", 30.0), (5, 3, "p3a", 0.0)]


def test_empty_pages_and_rounding(spark):
    lines = spark.createDataFrame([("a", 1, 0, "x", 0.03125), ("b", 1, 0, "x", 0.125), ("b", 1, 1, "y", 0.375)], "doc_id string, page_no int, line_no int, text string, confidence double")
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "doc_id string, page_no int")
    got = sorted((r.doc_id, r.page_no, r.raw_text, r.n_lines, r.confidence) for r in page_summary(lines, pages).collect())
    assert got == [("a", 1, "x", 1, round(0.03125, 4)), ("a", 2, "", 0, 0.0), ("b", 1, "x\ny", 2, 0.25)]
    docs = spark.createDataFrame([("a", "hybrid")], "doc_id string, engine string")
    half = lines.where("doc_id = 'b'").withColumn("doc_id", F.lit("a")).where("line_no = 0")
    warning = choose_ocr_pass(docs, half, half).first().warning
    assert warning == f"Enhanced fallback did not improve confidence ({0.125:.2f} vs {0.125:.2f})"


def test_rounding_follows_the_binary_value(spark):
    import random

    from daftar.functions.text import round_half_even

    rng = random.Random(1)
    values = [rng.random() for _ in range(3000)] + [k / 2**n for n in range(1, 12) for k in range(1, 2**n, 7)] + [k / 20000 for k in range(1, 20000, 37)]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", round_half_even(F.col("v"), 4).alias("r4"), round_half_even(F.col("v"), 2).alias("r2")).collect()
    assert all(r.r4 == round(r.v, 4) and r.r2 == round(r.v, 2) for r in rows)


@pytest.mark.parametrize("payload", ["AQJhYg===", "AQJhYg==AAAA", "AQJh=Yg==", "A=QJhYg==", "AQJhYg=x=", "AQJhYg", "AQJhYmM=zz", "=AQJhYmM="])
def test_reading_ends_at_the_first_complete_padding(spark, payload):
    try:
        raw = base64.b64decode(payload)
        want = raw[2 : 2 + raw[1]].decode() if len(raw) >= 2 and len(raw) >= 2 + raw[1] else None
    except ValueError:
        want = None
    got = decode_qr_table(spark.createDataFrame([("d", payload)], "doc_id string, payload string")).first()
    assert got.seller_name == want


BORDERS = {
    "plain": ["a", "الإجمالي SAR", ": 5.00", "b"],
    "blank": ["", "Total sar ", "", " ", "", ": 7.00 ", "VAT SAR:", ": 1.00"],
    "marks": ["ر.س", "\u200f: 3.00", "x ريال", ":", ": 4.00"],
    "chain": ["VAT SAR", ": SAR", ":sar", ": 2.00", ":SAR", ": 9.00", "c", "SAR"],
    "colon": [": 1.00", "SAR", "", "", "", "", "d"],
}


@pytest.mark.parametrize("size", [1, 2, 3, 4])
def test_currency_runs_over_chunk_borders(as_lines, size):
    lines = as_lines(BORDERS)

    def read(split):
        chunks = document_chunks(lines, header_lines, size, split).orderBy("chunk").collect()
        return {d: [t for c in chunks if c.doc_id == d for t in c.core] for d in BORDERS}, chunks

    (whole, _), (parts, chunks) = read(False), read(True)
    assert parts == whole and whole["plain"] == ["a", "الإجمالي SAR 5.00", "b"]
    for c in chunks:
        at, all_ = c.first_pos, whole[c.doc_id]
        if c.core:
            assert c.n_lines == len(all_) and all_[at : at + len(c.core)] == c.core
            assert c.before == all_[max(0, at - 12) : at] and c.after == all_[at + len(c.core) :][:12]
    for job in (extract_headers, lambda *a, **k: amount_by_keywords(*a, ["الإجمالي|total|vat"], **k)):
        assert sorted(job(lines, size=size, split=True).collect()) == sorted(job(lines, split=False).collect())


def test_long_documents_are_gathered_once(spark, as_lines, tmp_path, monkeypatch):
    """Borders, edges and chunks are read from rows that were gathered and made canonical once, not from the lines again."""
    as_lines(BORDERS).write.parquet(str(tmp_path / "lines"))
    lines, kept = spark.read.parquet(str(tmp_path / "lines")), []

    def stage(df, name):
        kept.append(df._jdf.queryExecution().executedPlan().toString())
        df.write.parquet(str(tmp_path / f"kept-{name}"))
        return spark.read.parquet(str(tmp_path / f"kept-{name}"))

    monkeypatch.setattr("daftar.operators.chunks.stage", stage, raising=False)
    parts = document_chunks(lines, header_lines, 2, True)
    plans = [*kept, parts._jdf.queryExecution().executedPlan().toString()]
    assert sum(p.count(f"{tmp_path}/lines") for p in plans) == 1, plans
