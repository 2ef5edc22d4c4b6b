"""Text, number and date column expressions shared by all jobs.

All of them are plain JVM-side column expressions; nothing here runs Python per
row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from daftar.functions import patterns as P

MONEY = "decimal(12,2)"
AMOUNT = "decimal(20,2)"  # while extracting: room for any digit run an amount pattern can hit


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def matches(c: Column, pattern: str, flags: str = "iu") -> Column:
    return F.rlike(c, F.lit(P.gated(pattern, flags)))


def matches_any(c: Column, patterns: list[str], flags: str = "iu") -> Column:
    return F.rlike(c, F.lit(P.any_of(patterns, flags)))


def capture(c: Column, pattern: str, flags: str = "iu", group: int = 1) -> Column:
    """Captured group of the first match; NULL when there is none or it is empty."""
    return F.nullif(F.regexp_extract(c, P.java_regex(pattern, flags), group), F.lit(""))


def trim_all(c: Column) -> Column:
    """Trim every kind of Unicode white space, not only blanks."""
    return F.trim(c, F.lit(P.BLANKS))


def arabic_digits(c: Column | str) -> Column:
    return F.translate(as_col(c), P.ARABIC_INDIC_DIGITS + P.PERSIAN_DIGITS, "0123456789" * 2)


def round_half_even(c: Column, places: int) -> Column:
    """A double between 0 and 2 rounded on its exact binary value, ties to the even digit."""
    # exact: scaling by a power of two, then integers and decimals only; smaller values are
    # scaled further, so that all their bits above 2 ** -70 count
    small = c < 2.0**-9
    unit = F.when(small, F.lit(str(1 << 70))).otherwise(F.lit(str(1 << 62))).cast("decimal(22,0)")
    bits = F.floor(c * F.when(small, 2.0**70).otherwise(2.0**62)).cast("decimal(20,0)")
    scaled = bits * F.lit(10**places).cast("decimal(8,0)")
    whole = F.call_function("div", scaled, unit)
    rest = (scaled - whole.cast("decimal(8,0)") * unit) * 2
    up = (rest > unit) | ((rest == unit) & (whole % 2 == 1))
    return (whole + up.cast("int")) / 10.0**places


def _marked(c: Column) -> Column:
    """``c`` with its currency marks written as SAR."""
    for mark in P.CURRENCY_MARKS:
        c = F.replace(c, F.lit(mark), F.lit("SAR"))
    return c


def canonical_text(c: Column | str) -> Column:
    """Canonical invoice text: digits, bidi marks, spelling, currency, spaces.

    Most lines are canonical as they stand, which is far cheaper to see than to bring about.
    """
    c = as_col(c)
    return F.when(_plain(c), c).otherwise(made_canonical(c))


def made_canonical(c: Column) -> Column:
    # characters beyond the end of the target string are deleted by translate
    out = F.translate(
        c,
        P.ARABIC_INDIC_DIGITS + P.PERSIAN_DIGITS + P.BIDI_MARKS,
        "0123456789" * 2,
    )
    for wrong, right in P.SPELLING_FIXES:
        out = F.replace(out, F.lit(wrong), F.lit(right))
    out = F.regexp_replace(_marked(out), P.java_regex(P.CURRENCY_COLON, "i"), "SAR")
    for mark, plain in P.PUNCTUATION:
        out = F.replace(out, F.lit(mark), F.lit(plain))
    # (a single blank is left as it is)
    out = F.regexp_replace(out, r" [ \t]+|\t[ \t]*", " ")
    out = F.regexp_replace(out, r"\n{2,}", "\n")
    return trim_all(out)


def _plain(c: Column) -> Column:
    """Whether a line is canonical as it stands; some that are may be missed."""
    plain = F.rlike(c, F.lit(P.PLAIN_LINE))
    for part in P.PLAIN_UNLESS:
        plain = plain & ~F.contains(c, F.lit(part))
    return plain & ~(F.contains(c, F.lit(":")) & F.rlike(c, F.lit(P.java_regex(P.CURRENCY_COLON, "i"))))


def ends_with_currency(c: Column | str) -> Column:
    """Whether a colon that comes next would belong to a currency mark (``P.CURRENCY_COLON``)."""
    return matches(_marked(F.translate(as_col(c), P.BIDI_MARKS, "")), P.CURRENCY_AT_END, "i")


def single_line(c: Column | str) -> Column:
    return F.translate(canonical_text(c), "\n", " ")


def leading_number(c: Column | str, dtype: str = "double") -> Column:
    """Number at the start of the text, commas and white space dropped first."""
    bare = F.regexp_replace(as_col(c), f",|{P.WHITESPACE}", "")
    return F.nullif(F.regexp_extract(bare, P.LEADING_NUMBER, 1), F.lit("")).try_cast(dtype)


def cell_number(c: Column | str, dtype: str = AMOUNT) -> Column:
    """Number at the start of a table cell, as ``leading_number(single_line(c))``.

    Of the canonical form only digits, marks and separators can change a leading number,
    so one translation does; commas (Arabic ones too) are dropped, not kept.
    """
    digits = P.ARABIC_INDIC_DIGITS + P.PERSIAN_DIGITS
    plain = F.translate(as_col(c), digits + "٫" + P.BIDI_MARKS + "،,", "0123456789" * 2 + ".")
    bare = F.regexp_replace(plain, f"{P.WHITESPACE}+", "")
    return F.nullif(F.regexp_extract(bare, P.LEADING_NUMBER, 1), F.lit("")).try_cast(dtype)


def line_amount(c: Column, dtype: str = AMOUNT) -> Column:
    """Amount marked as SAR on one canonical line: prefix form first, then suffix."""
    text = F.coalesce(capture(c, P.SAR_BEFORE_AMOUNT, "i"), capture(c, P.SAR_AFTER_AMOUNT, "i"))
    return F.when(F.rlike(c, F.lit(P.SAR_MARK)), F.replace(text, F.lit(","), F.lit("")).try_cast(dtype))


def _iso(year: Column, month: Column, day: Column) -> Column:
    """ISO text when the parts are in range, else NULL. Empty parts give NULL."""
    # parts come from digit patterns; the leading zero spares empty ones a failed cast, which
    # is slow
    y, m, d = (F.concat(F.lit("0"), p).try_cast("int") for p in (year, month, day))
    ok = y.between(P.YEAR_MIN, P.YEAR_MAX) & m.between(1, 12) & d.between(1, 31)
    return F.when(ok, F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")))


def parse_date(c: Column | str) -> Column:
    """ISO date text of a whole value: compact, day first, or year first."""
    clean = arabic_digits(trim_all(as_col(c)))

    def part(pattern: str, group: int) -> Column:
        return F.regexp_extract(clean, P.java_regex(pattern, ""), group)

    return F.coalesce(
        _iso(*(part(P.COMPACT_DATE, g) for g in (1, 2, 3))),
        _iso(*(part(P.DAY_FIRST_DATE, g) for g in (3, 2, 1))),
        _iso(*(part(P.YEAR_FIRST_DATE, g) for g in (1, 2, 3))),
    )


def date_from_digit_runs(c: Column | str) -> Column:
    """First run of 8+ digits whose last, else first, eight digits are a date."""
    return date_from_ascii_runs(arabic_digits(c))


def date_from_ascii_runs(c: Column) -> Column:
    """As above, of a text whose digits are ASCII already."""
    runs = F.regexp_extract_all(c, F.lit(P.DIGIT_RUN), F.lit(0))

    def candidates(run: Column) -> Column:
        return F.array(F.right(run, F.lit(8)), F.left(run, F.lit(8)))

    def iso(run: Column) -> Column:
        return _iso(F.substring(run, 1, 4), F.substring(run, 5, 2), F.substring(run, 7, 2))

    dates = F.transform(F.flatten(F.transform(runs, candidates)), iso)
    return F.get(F.filter(dates, lambda d: d.isNotNull()), F.lit(0))
