import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from samples import FOOTER_ONLY, NOISY_FOOTER, POSITIONED, RECEIPT_1, RECEIPT_2

from daftar.functions import patterns as P
from daftar.functions.text import AMOUNT, made_canonical, trim_all
from daftar.operators.headers import LABEL_HINT, ROLE_HINT, extract_headers, first_amount, header_lines, last_amount, warning_counts
from daftar.operators.keyword_amounts import amount_by_keywords, amount_near_keyword, amount_near_keyword_strict

DOCS = {
    "r1": RECEIPT_1,
    "r2": RECEIPT_2,
    "noisy": NOISY_FOOTER,
    "footer": FOOTER_ONLY,
    "table": [t for t, *_ in POSITIONED],
    "usd": ["Invoice no: A-17", "Grand Total", "USD 5", "SAR 20.00", "date 1.2.2020"],
    "computed": ["المجموع الفرعي SAR 10.00", "ضريبة القيمة المضافة SAR 1.50"],
    "same": ["Subtotal SAR 5.00", "VAT SAR 0.75", "الإجمالي SAR 5.00"],
    "badday": ["التاريخ: 2023-02-31"],
    "blank": ["", " "],
}
MONEY = ("subtotal", "vat_amount", "total")


@pytest.fixture(scope="module", params=[4096, 5, 9])
def found(request, as_lines):
    rows = extract_headers(as_lines(DOCS), size=request.param).collect()
    return {r.doc_id: r for r in rows}


def money(row):
    return tuple(None if row[c] is None else float(row[c]) for c in MONEY)


def test_receipts(found):
    r = found["r1"]
    assert (r.invoice_number, r.order_number, r.supplier_vat_number) == ("101347", "69", "310227420600003")
    assert money(r) == (86.96, 13.04, 100.0)
    assert r.invoice_date == datetime.date(2021, 11, 14)
    assert (r.currency, r.confidence, r.warnings) == ("SAR", Decimal("1.00"), [])
    assert r.supplier_name == "شركة شفرة نحاسية لتقديم المشروبات"
    r = found["r2"]
    assert (r.invoice_number, r.order_number, r.supplier_vat_number) == ("232130", "302", "302281309900003")
    assert money(r) == (43.47, 6.52, 50.0)
    assert r.invoice_date == datetime.date(2023, 12, 12)


def test_footers(found):
    assert money(found["noisy"]) == (43.47, 6.52, 50.0)
    assert money(found["footer"]) == (43.47, 6.52, 50.0)
    assert found["footer"].supplier_vat_number == "310227420600003"


def test_table(found):
    r = found["table"]
    assert (r.supplier_vat_number, r.invoice_date) == ("300987654300003", datetime.date(2025, 11, 10))
    assert money(r) == (250.0, 37.5, 287.5)


def test_rules(found):
    assert (found["usd"].invoice_number, found["usd"].currency) == ("A-17", "USD")
    assert found["usd"].invoice_date == datetime.date(2020, 2, 1)
    assert money(found["computed"]) == (10.0, 1.5, 11.5)
    assert money(found["same"]) == (5.0, None, 5.0)
    assert found["badday"].invoice_date is None
    assert "Invoice date is not a calendar date" in found["badday"].warnings
    assert found["blank"].confidence == 0 and len(found["blank"].warnings) == 4


def amounts(df):
    return {r.doc_id: float(r.amount) for r in df.collect()}


@pytest.mark.parametrize("size", [4096, 2])
def test_near_keyword(as_lines, size):
    docs = {
        "same": ["some text", "ضريبة القيمة المضافة SAR 13.04", "other"],
        "next": ["ضريبة القيمة المضافة", "SAR 13.04", "other"],
        "prev": ["other", "SAR 13.04", "ضريبة القيمة المضافة"],
        "none": ["no keyword here", "SAR 100.00"],
    }
    got = amounts(amount_near_keyword(as_lines(docs), "ضريبة", size=size))
    assert got == {"same": 13.04, "next": 13.04, "prev": 13.04}


@pytest.mark.parametrize("size", [4096, 2])
def test_strict(as_lines, size):
    arabic_first = {"a": ["المجموع الفرعي", "SAR 43.47", "Subtotal", "SAR 6.52"]}
    got = amount_near_keyword_strict(
        as_lines(arabic_first), r"المجموع\s*الفرعي|subtotal", exclude=["ضريبة|vat"], prefer_arabic=True, size=size
    )
    assert amounts(got) == {"a": 43.47}
    bounded = {"stop": ["الإجمالي", "ضريبة", "SAR 50.00"], "back": ["SAR 50.00", "الإجمالي"], "skip": ["SAR 9", "ضريبة", "الإجمالي"]}
    got = amount_near_keyword_strict(as_lines(bounded), "الإجمالي", before=2, after=3, exclude=["ضريبة"], size=size)
    assert amounts(got) == {"back": 50.0, "skip": 9.0}


@pytest.mark.parametrize("size", [4096, 2])
def test_by_keywords(as_lines, size):
    split = {"m": ["المجموع", "الفرعي", "SAR 86.96"]}
    assert amounts(amount_by_keywords(as_lines(split), [r"المجموع\s*الفرعي"], size=size)) == {"m": 86.96}
    twice = {"t": ["الإجمالي SAR 43.47", "Subtotal", "الإجمالي SAR 100.00"]}
    assert amounts(amount_by_keywords(as_lines(twice), ["الإجمالي"], prefer_last=True, size=size)) == {"t": 100.0}


def test_document_without_lines_gets_a_header(spark, as_lines):
    docs = spark.createDataFrame([("full",), ("empty",)], "doc_id string")
    got = {r.doc_id: r for r in extract_headers(as_lines({"full": ["Invoice No: 12"]}), documents=docs).collect()}
    assert len(got) == 2 and got["empty"].confidence == 0 and got["empty"].currency == "SAR"
    assert got["empty"].warnings == [
        "Invoice number not detected", "Invoice date not detected", "Total amount not detected", "Supplier VAT number not detected",
    ]


def test_search_ends_at_the_first_amount(spark):
    """Places behind the found one are not looked at."""
    places = F.array(*[F.lit(i) for i in range(4)])
    amount = lambda i: F.when(i == F.col("at"), F.lit("7.00").cast(AMOUNT))
    never = F.raise_error(F.lit("looked too far")).cast(AMOUNT)
    df = spark.createDataFrame([(0,), (2,), (9,)], "at int")
    found = df.select(
        first_amount(places, lambda i: F.when(i > F.col("at"), never).otherwise(amount(i))).alias("a"),
        last_amount(places, lambda i: F.when((F.col("at") < 4) & (i < F.col("at")), never).otherwise(amount(i))).alias("b"),
    )
    assert [tuple(r) for r in found.collect()] == [(Decimal("7.00"),) * 2] * 2 + [(None, None)]


def test_gated_patterns_match_what_they_matched(spark):
    texts = [
        "VAT", "xvat 5", "ſubtotal", "SUB  TOTAL", "va t", "caſh", "İnvoice", "ınvoice", "invoice", "Kg 5", "KG",
        "الإجمالي", "قبل  الضريبة", "رقم الضريبي", "الرقم الضريبي", "total\n", "", "sar", None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = [P.STRICT_SUBTOTAL, P.LOOSE_VAT, P.FOOTER_WORDS, P.STOP_WORDS, P.COLUMN_TITLES, "kg|pcs", "invoice|total$", "s?ar|vat", "s|", "(?!)", "a(?:b|c)|t"]
    assert P.gated("s?ar|vat") == P.java_regex("s?ar|vat") and P.gated(P.STOP_WORDS) != P.java_regex(P.STOP_WORDS)
    for flags in ("iu", "i", ""):
        for one in [*([w] for w in words), P.NOT_AN_AMOUNT_LINE, P.TOTAL_LABELS]:
            plain = P.java_regex("|".join(f"(?:{p})" for p in one), flags)
            got = df.select(F.rlike("t", F.lit(P.any_of(one, flags))).alias("a"), F.rlike("t", F.lit(plain)).alias("b")).collect()
            assert [r.a for r in got] == [r.b for r in got], (one, flags)


def test_header_patterns_begin_where_their_heads_stand(spark):
    texts = [
        "فاتورة# 12 طلب 7", "x # فاتوره 9", "رقم الفاتورة: A-1", "INVOICE no 5", "Tax Invoice No 6", "Order #8", "# 4 order", "رقم ضريبي 310227420600003",
        "الرقم الضريبى 310227420600003", "TRN: 310227420600003", "a 310227420600003", "تاريخ الفاتوره 2024-01-31", "وقت الطلب 2024/1/3", "Date 1/2/2024",
        "في 2024.1.2", "31-12-2023", "x 20240131", "شركة النور الكبرى\nx", "Sold by Acme Ltd", "vendor: Acme Ltd", "البائع: متجر النور", "nothing",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    tables = [P.INVOICE_NUMBER, P.ORDER_NUMBER, P.VAT_NUMBER, P.INVOICE_DATE, P.SUPPLIER_NAME]
    for pattern, flags, heads in (p for table in tables for p in table):
        found = df.select("v", *[F.regexp_extract("v", r, 1) for r in (P.headed(pattern, flags, heads), P.java_regex(pattern, flags))]).collect()
        assert all(r[1] == r[2] for r in found), pattern
        assert any(r[1] for r in found), pattern


def test_lines_are_canonical_one_by_one_but_for_a_colon_that_runs_over(spark):
    texts = ["a SAR\n: 5", "SAR:\n:5", "SAR \n\u200f \n:5 x", "b\n\n ٥ ر.س \n﷼: 3", "x\n:y", " SAR\t5\n\n", ""]
    df = spark.createDataFrame([([None, t, "c  d"],) for t in texts], "raw array<string>")
    whole = F.transform(F.split(made_canonical(F.array_join("raw", "\n")), "\n"), trim_all)
    for raw, lines, expected in df.select("raw", header_lines(F.col("raw")), F.filter(whole, lambda x: x != "")).collect():
        assert lines == expected, raw


def test_lines_of_no_role_word_have_no_role():
    import re

    for word in ("VISA", "v\u0131\u017fa", "Sub\u017fubTotal", "الضريبي", "نقد", "المضافة"):
        assert re.search(ROLE_HINT, f"x {word} y") and re.search(LABEL_HINT, f"x {word} y"), word
    for words in (P.STRICT_SUBTOTAL, P.STRICT_VAT, P.STRICT_TOTAL, P.LOOSE_VAT, *P.NOT_AN_AMOUNT_LINE, *P.STRICT_VAT_EXCLUDE, *P.STRICT_SUBTOTAL_EXCLUDE):
        assert all(re.search(ROLE_HINT, w.replace(r"\s*", "")) for w in words.split("|")), words
    assert not re.search(ROLE_HINT, "فاتورة# 12") and re.search(LABEL_HINT, "فاتورة# 12")


def test_warnings_are_counted_without_a_filter_on_them(spark):
    """The filter of a plain explode would be written out down to the lines, beyond any memory."""
    rows = [("a", ["x", "y"]), ("b", ["x"]), ("b", ["x"]), ("c", []), (None, None)]
    counts = warning_counts(spark.createDataFrame(rows, "doc_id string, warnings array<string>"))
    assert sorted(map(tuple, counts.collect())) == [("x", 3), ("y", 1)]
    assert "size(" not in counts._jdf.queryExecution().optimizedPlan().toString()
