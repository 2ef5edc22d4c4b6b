import pytest
from pyspark.sql import functions as F

from daftar.functions.text import (
    canonical_text,
    cell_number,
    date_from_digit_runs,
    leading_number,
    line_amount,
    made_canonical,
    parse_date,
    single_line,
    trim_all,
)


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v string").select(expr(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(
    "text, expected",
    [
        ("٠١٢ ۳۴", "012 34"),
        ("‏12 ريال", "12 SAR"),
        ("ر.س : 5", "SAR 5"),
        ("sar: 5", "SAR 5"),
        ("﷼٥٫٥", "SAR5.5"),
        ("إجمالى ضريبه فاتوره", "إجمالي ضريبة فاتورة"),
        ("a،b \t  c", "a,b c"),
        (" a\n\n\nb　", "a\nb"),
        ("", ""),
    ],
)
def test_canonical_text(spark, text, expected):
    assert one(spark, text, canonical_text) == expected


def test_lines_passed_as_they_are_are_canonical(spark):
    """Lines of all odd characters between, before and after plain ones."""
    odd = [*"\t\n\u00a0\u200b\u200f\ufeff٠۹،٫﷼:é\x01َى", " ", "  ", "ريال", "ر.س", "SAR:", "sar :", "إجمالى", "ضريبه", "فاتوره", "ه", ""]
    texts = [t for o in odd for t in (o, f"{o}a", f"b{o}", f"فاتورة{o}1", f"SAR{o}: 2", f"2 {o} SAR 3", f"ر{o}.س", None)]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    for v, passed, made in df.select("v", canonical_text("v"), made_canonical(F.col("v"))).collect():
        assert passed == made, repr(v)


def test_single_line_and_trim(spark):
    assert one(spark, "a\nb", single_line) == "a b"
    assert one(spark, "  x ﻿", trim_all) == "x"


@pytest.mark.parametrize(
    "text, expected", [("12abc", 12.0), ("1,234.5", 1234.5), ("1,23", 123.0), ("-.5x", -0.5), ("abc", None), ("1e2", 100.0), ("", None)]
)
def test_leading_number(spark, text, expected):
    assert one(spark, text, leading_number) == expected


@pytest.mark.parametrize(
    "text", ["٣٠٫٥٠", "1،234.5 ريال", "‏ ۱۲ x", "SAR 5", "ر.س 5", "12 ر.س", ",5", "- 3", "abc", "", "1 2 3", "٫5", "+٧", "5 e2"]
)
def test_cell_number_is_the_number_of_the_canonical_text(spark, text):
    canonical = one(spark, text, lambda c: leading_number(single_line(c), "decimal(20,2)"))
    assert one(spark, text, cell_number) == canonical


@pytest.mark.parametrize(
    "text, expected",
    [("SAR 17.00", 17.0), ("100.00 SAR", 100.0), ("some text 123", None), ("SAR 1,234.50", 123.0), ("SAR 12,50", 1250.0)],
)
def test_line_amount(spark, text, expected):
    got = one(spark, text, line_amount)
    assert (None if got is None else float(got)) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("2021/11/14", "2021-11-14"),
        ("14/11/2021", "2021-11-14"),
        ("4.1.2021", "2021-01-04"),
        ("20231212", "2023-12-12"),
        (" ١٤-١١-٢٠٢١ ", "2021-11-14"),
        ("2023-02-31", "2023-02-31"),
        ("14/13/2021", None),
        ("14/11/21", None),
        ("hello", None),
        ("20231212\n", "2023-12-12"),
    ],
)
def test_parse_date(spark, text, expected):
    assert one(spark, text, parse_date) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("041502320231212", "2023-12-12"),
        ("20231212", "2023-12-12"),
        ("310227420600003", None),
        ("x 99999999 y 20200102999", "2020-01-02"),
        ("1234567", None),
    ],
)
def test_date_from_digit_runs(spark, text, expected):
    assert one(spark, text, date_from_digit_runs) == expected
