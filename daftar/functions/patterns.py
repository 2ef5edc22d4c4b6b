"""Fixed values of the invoice rules: word lists, patterns, lookup tables, limits.

Everything in this module is data whose exact content decides results. The
patterns are written in the dialect the rules are stated in (``\\s`` covers all
Unicode white space, ``\\b`` is an ASCII word boundary, ``$`` is the very end)
and are turned into Java patterns by :func:`java_regex`.
"""

from __future__ import annotations

import re

# ---------------------------------------------------------------------------
# Dialect
# ---------------------------------------------------------------------------

WHITESPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
# the same characters one by one, for trimming
BLANKS = " \t\n\v\f\r\u00A0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202F\u205F\u3000\uFEFF"
WORD_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def java_regex(pattern: str, flags: str = "iu") -> str:
    """Java form of a rule pattern. ``flags`` are the inline case flags."""
    out = pattern.replace(r"\s", WHITESPACE).replace(r"\b", WORD_EDGE)
    if out.endswith("$"):
        out = out[:-1] + r"\z"
    out = out.replace("$|", r"\z|")
    return f"(?{flags})" + out if flags else out


def headed(pattern: str, flags: str, heads: str) -> str:
    """``java_regex`` that is tried only where one of the characters ``heads`` stands."""
    return (f"(?=[{heads}])" if heads else "") + java_regex(pattern, flags)


def any_of(patterns: list[str], flags: str = "iu") -> str:
    """One Java pattern matching where any of ``patterns`` matches."""
    return gated("|".join(f"(?:{p})" for p in patterns), flags, patterns)


# other characters that are a letter in another case
_ODD_CASES = {"s": "\u017F", "k": "\u212A", "i": "\u0130\u0131"}
_PLAIN_WORDS = re.compile(r"(?:[A-Za-z\u0621-\u064A |]|\\s\*|\.\*|\(\?:|\))*")


def _cases(letter: str) -> str:
    low = letter.lower()
    return "".join(sorted({low, low.upper()})) + _ODD_CASES.get(low, "")


def gated(pattern: str, flags: str = "iu", parts: list[str] | None = None) -> str:
    """``java_regex`` that tries its alternatives only where one of their first letters stands.

    Only if each alternative (of each of ``parts``) begins with a letter that is not optional.
    Plain words have both cases of each letter written out, which is far faster than the flags.
    """
    heads = [p for part in parts or [pattern] for p in part.split("|")]
    if not all(re.match(r"[A-Za-z\u0621-\u064A](?![?*{+])", p) for p in heads):
        return java_regex(pattern, flags)
    head = f"(?=[{''.join(sorted({c for p in heads for c in _cases(p[0])}))}])"
    if flags == "iu" and _PLAIN_WORDS.fullmatch(pattern):
        cased = re.sub(r"\\s|[A-Za-z]", lambda m: m[0] if m[0] == r"\s" else f"[{_cases(m[0])}]", pattern)
        return f"{head}(?:{java_regex(cased, '')})"
    body = java_regex(pattern, "")
    return f"{head}(?{flags}:{body})" if flags else f"{head}(?:{body})"


def any_word(words: list[str]) -> str:
    """Java pattern that finds any of ``words``, letters in either case; words of one first letter stand together."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[0].lower(), []).append("".join(f"[{_cases(c)}]" for c in w[1:].lower()))
    return "|".join(f"[{_cases(c)}](?:{'|'.join(rest)})" for c, rest in sorted(first.items()))


# ---------------------------------------------------------------------------
# Text normalization
# ---------------------------------------------------------------------------

ARABIC_INDIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
PERSIAN_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
BIDI_MARKS = "\u200F\u200E\u202A\u202B\u202C\uFEFF"
SPELLING_FIXES = [("إجمالى", "إجمالي"), ("ضريبه", "ضريبة"), ("فاتوره", "فاتورة")]
CURRENCY_MARKS = ["ر.س", "ريال", "﷼"]  # no end of one begins another
CURRENCY_COLON = r"SAR\s*:"
CURRENCY_AT_END = r"SAR\s*$"
PUNCTUATION = [("،", ","), ("٫", ".")]

# lines of these characters alone, no blank at either end, are canonical but for what PLAIN_UNLESS names
PLAIN_LINE = r"\A[!-~\u0621-\u0652](?:[ -~\u0621-\u0652]*[!-~\u0621-\u0652])?\z"
PLAIN_UNLESS = ["  ", *[wrong for wrong, _ in SPELLING_FIXES], *CURRENCY_MARKS[:2]]
# a line that a currency mark at the end of an earlier one may run over to
COLON_LINE = rf"\n[{WHITESPACE[1:-1]}{BIDI_MARKS}]*:"

LEADING_NUMBER = r"^([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"

COMPACT_DATE = r"^((?:19|20)\d{2})(\d{2})(\d{2})$"
DAY_FIRST_DATE = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{4})$"
YEAR_FIRST_DATE = r"^(\d{4})[/\-.](\d{1,2})[/\-.](\d{1,2})$"
DIGIT_RUN = r"[0-9]{8,}"
YEAR_MIN, YEAR_MAX = 1900, 2100

# ---------------------------------------------------------------------------
# Header patterns, tried in this order, with their case flags and the characters
# one of which a match begins with (none: any)
# ---------------------------------------------------------------------------

INVOICE_NUMBER = [
    (r"(?:فاتور[ةه]\s*#?|#\s*فاتور[ةه])\s*[:#-]?\s*([0-9A-Z/-]+)", "iu", "ف#"),
    (r"(?:رقم\s*الفاتور[ةه]|فاتور[ةه]\s*رقم)\s*[:#-]?\s*([0-9A-Z/-]+)", "iu", "رف"),
    (r"(?:invoice\s*(?:no|number|#)?|inv\s*no)\s*[:#-]?\s*([A-Z0-9/-]+)", "i", "iI"),
    (r"(?:tax\s*invoice\s*no)\s*[:#-]?\s*([A-Z0-9/-]+)", "i", "tT"),
]

ORDER_NUMBER = [
    (r"(?:طلب|order)\s*#?\s*([0-9]+)", "iu", "طoO"),
    (r"#\s*([0-9]+)\s*(?:طلب|order)", "iu", "#"),
]

VAT_NUMBER = [
    (r"(?:الرقم\s*الضريبي|رقم\s*ضريبي|الرقم\s*الضريبى)\s*[:#-]?\s*([0-9]{15})", "iu", "ار"),
    (r"(?:vat\s*(?:no|number)?|tax\s*(?:no|number)|trn)\s*[:#-]?\s*([0-9]{15})", "i", "vVtT"),
    (r"\b(3[0-9]{13}3)\b", "", "3"),
]

INVOICE_DATE = [
    (
        r"(?:وقت\s*الطباعة|وقت\s*الطلب|تاريخ\s*الفاتور[ةه]|التاريخ)\s*[:-]?\s*"
        r"(\d{4}[/.-]\d{1,2}[/.-]\d{1,2})",
        "iu", "وتا",
    ),
    (r"(?:invoice\s*date|date)\s*[:-]?\s*(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})", "i", "iIdD"),
    (r"(\d{4}[/.-]\d{1,2}[/.-]\d{1,2})", "", ""),
    (r"(\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4})", "", ""),
    (r"\b((?:19|20)\d{6})\b", "", "12"),
]

SUPPLIER_NAME = [
    (
        r"((?:شركة|مؤسسة)\s+[\u0600-\u06FF\s]{3,80})"
        r"(?=\n|\s+الرقم\s*الضريبي|\s+[0-9]{15})",
        "iu", "شم",
    ),
    (
        r"(?:supplier|vendor|sold\s*by|from)\s*[:-]?\s*"
        r"([A-Za-z\u0600-\u06FF][A-Za-z\u0600-\u06FF\s]{2,80})",
        "i", "sSvVfF",
    ),
    (r"(?:المورد|البائع)\s*[:-]\s*([\u0600-\u06FF][^\d:#\n]{3,80})", "iu", "ام"),
]

CURRENCY_USD = ["USD", "$"]
CURRENCY_EUR = ["EUR", "€"]

# ---------------------------------------------------------------------------
# Amounts and the keywords they stand next to
# ---------------------------------------------------------------------------

SAR_MARK = "[Ss\u017F][Aa][Rr]"
SAR_BEFORE_AMOUNT = r"SAR\s*([0-9]+(?:[,.][0-9]{1,2})?)"
SAR_AFTER_AMOUNT = r"([0-9]+(?:[,.][0-9]{1,2})?)\s*SAR"

SUBTOTAL_LABELS = [
    r"المجموع\s*الفرعي",
    r"الفرعي\s*المجموع",
    r"المجموع\s*قبل\s*الضريبة",
    r"الإجمالي\s*قبل\s*الضريبة",
    r"قبل\s*الضريبة",
    r"subtotal",
    r"sub\s*total",
    r"amount\s*before\s*vat",
]

VAT_LABELS = [
    r"ضريبة\s*القيمة\s*المضافة",
    r"المضافة\s*القيمة\s*.*ضريبة",
    r"القيمة\s*المضافة",
    r"المضافة\s*القيمة",
    r"vat",
    r"value\s*added\s*tax",
]

TOTAL_LABELS = [
    r"الإجمالي",
    r"المجموع\s*الكلي",
    r"المبلغ\s*المستحق",
    r"grand\s*total",
    r"total\s*amount",
    r"amount\s*due",
    r"total",
]

NOT_A_TOTAL = [
    r"المجموع\s*الفرعي",
    r"الفرعي\s*المجموع",
    r"subtotal",
    r"sub\s*total",
    r"ضريبة",
    r"vat",
    r"قبل\s*الضريبة",
    r"الدفع",
    r"payment",
    r"التقريب",
    r"rounding",
]

# ---------------------------------------------------------------------------
# The strict search, its keyword patterns (each one pattern) and the lines that bound it
# ---------------------------------------------------------------------------

STRICT_SUBTOTAL = r"المجموع\s*الفرعي|الفرعي\s*المجموع|المجموع\s*قبل\s*الضريبة|قبل\s*الضريبة|subtotal|sub\s*total|amount\s*before\s*vat"
STRICT_SUBTOTAL_EXCLUDE = [r"الإجمالي|total", r"ضريبة|vat", r"التقريب|rounding"]
STRICT_VAT = r"ضريبة\s*القيمة\s*المضافة|القيمة\s*المضافة|المضافة\s*القيمة|vat|value\s*added\s*tax"
STRICT_VAT_EXCLUDE = [r"المجموع\s*الفرعي|subtotal", r"الإجمالي|total", r"التقريب"]
LOOSE_VAT = r"ضريبة|VAT"
STRICT_TOTAL = r"الإجمالي|المجموع\s*الكلي|المبلغ\s*المستحق|grand\s*total|total\s*amount|amount\s*due"
TOTAL_MARK = r"الإجمالي"
NOT_AN_AMOUNT_LINE = [
    r"ضريبة|vat",
    r"المجموع\s*الفرعي|subtotal",
    r"الإجمالي|total",
    r"التقريب|rounding",
    r"الدفع|payment|card|cash|نقد|مدى|visa",
    r"الرقم\s*الضريبي",
]
ARABIC_LETTER = r"[\u0600-\u06FF]"

# search reach in lines: strict subtotal (back, forward), strict VAT, loose VAT,
# total (forward only), merged windows (forward past the window)
SUBTOTAL_REACH = (1, 2)
VAT_REACH = (2, 2)
LOOSE_VAT_REACH = 2
TOTAL_REACH = 2
MERGED_WIDTHS = (1, 2, 3)
MERGED_LOOKAHEAD = 3

# ---------------------------------------------------------------------------
# Line items
# ---------------------------------------------------------------------------

ITEM_LINE = r"^\s*([0-9]+(?:[,.][0-9]+)?)\s+(.+?)\s+SAR\s*([0-9]+(?:[,.][0-9]{1,2})?)\s*$"
BARE_QUANTITY = r"^\s*([0-9]+(?:[,.][0-9]+)?)\s*$"
JUNK_LINE = r"^[^\u0600-\u06FFa-zA-Z0-9]{0,2}$|^[a-zA-Z\u0600-\u06FF]{1,2}$"
COLUMN_TITLES = r"الكمية|وحدة|السعر|quantity|price|unit"
FOOTER_WORDS = (
    r"المجموع|الفرعي|Subtotal|ضريبة|VAT|الإجمالي|Total|عدد\s*المنتجات|"
    r"الرقم\s*الضريبي|شركة|مؤسسة|التقريب|Rounding|الدفع|payment"
)
STOP_WORDS = (
    r"المجموع|Subtotal|ضريبة|VAT|الإجمالي|Total|التقريب|Rounding|الدفع|payment|card|مدى|"
    r"visa|mastercard|cash|نقد|الرقم\s*الضريبي|شركة|مؤسسة|فاتور[ةه]|invoice|الطلب|order|"
    r"المنشئ|المغلق|وقت\s*الطباعة|وقت\s*الطلب|Simplified|استلام|pickup|delivery|توصيل"
)
MAX_QUANTITY = 999
ITEM_CONFIDENCE, PATCHED_CONFIDENCE, NO_AMOUNT_CONFIDENCE = "0.85", "0.75", "0.50"

ROW_Y_REACH = 15.0
TABLE_TITLES = [
    r"item|description|product|المنتج|الصنف|الوصف",
    r"qty|quantity|الكمية|كمية",
    r"unit|الوحدة",
    r"price|سعر|السعر",
    r"total|الإجمالي|مجموع",
]
UNIT_IN_NAME = r"\b(kg|g|ltr|ml|pcs|box|carton|كيلو|لتر|كرتون|صندوق|قطعة)\b"
WIDE_GAP = r"\s{2,}"
ROW_CONFIDENCE_MIN = 0.8

# ---------------------------------------------------------------------------
# Upload admission, OCR, validation, mapping, posting, status
# ---------------------------------------------------------------------------

UPLOAD_MIME_TYPES = ["image/jpeg", "image/png", "application/pdf"]
UPLOAD_EXTENSIONS = [".jpg", ".jpeg", ".png", ".pdf"]
MAX_UPLOAD_MB = 20

DEFAULT_BOX_STEP, DEFAULT_BOX_HEIGHT, DEFAULT_BOX_WIDTH = 30.0, 25.0, 500.0
OCR_MIN_CONFIDENCE = 0.75
OCR_FALLBACK_ENGINES = ["hybrid", "ppocrv5"]
OCR_ERROR_CODES = [
    "OCR_FILE_NOT_FOUND",
    "OCR_UNSUPPORTED_FILE_TYPE",
    "OCR_ENGINE_INIT_FAILED",
    "OCR_TIMEOUT",
    "OCR_EMPTY_RESULT",
    "OCR_VL_NOT_IMPLEMENTED",
]
QR_TAGS = {1: "seller_name", 2: "vat_number", 3: "timestamp", 4: "total", 5: "vat_amount"}

ARITHMETIC_TOLERANCE = "0.1"
FIFTEEN_DIGITS = r"^[0-9]{15}$"

UNIT_CONVERSIONS = [
    ("box", "kg", 5),
    ("carton", "kg", 12),
    ("كرتون", "kg", 12),
    ("صندوق", "kg", 5),
    ("كيلو", "kg", 1),
    ("liter", "ml", 1000),
    ("لتر", "ml", 1000),
    ("pcs", "piece", 1),
    ("قطعة", "piece", 1),
]
MAX_SUGGESTIONS = 5

JOURNAL_ACCOUNTS = [
    ("1200", "Inventory / Purchases", "DR"),
    ("2400", "VAT Input", "DR"),
    ("2100", "Accounts Payable", "CR"),
]

STATUSES = [
    "UPLOADED",
    "QUEUED",
    "PROCESSING_OCR",
    "OCR_COMPLETED",
    "EXTRACTING",
    "VALIDATING",
    "NEEDS_REVIEW",
    "READY",
    "APPROVED",
    "POSTED_TO_INVENTORY",
    "POSTED_TO_ACCOUNTING",
    "OCR_FAILED",
    "EXTRACTION_FAILED",
    "VALIDATION_FAILED",
    "POSTING_FAILED",
]
PROCESSING_STATUSES = [
    "QUEUED",
    "PROCESSING_OCR",
    "OCR_COMPLETED",
    "EXTRACTING",
    "VALIDATING",
]
REVIEWABLE_STATUSES = ["NEEDS_REVIEW", "READY"]
APPROVAL_BLOCKERS = ["OCR_FAILED", "EXTRACTION_FAILED", "VALIDATION_FAILED"]
JOB_ATTEMPTS = 3
OCR_TIMEOUT_SECONDS = 120

# ---------------------------------------------------------------------------
# Texts of findings and reasons
# ---------------------------------------------------------------------------

NO_INVOICE_NUMBER_SEEN = "Invoice number not detected"
NO_INVOICE_DATE_SEEN = "Invoice date not detected"
NO_TOTAL_SEEN = "Total amount not detected"
NO_VAT_NUMBER_SEEN = "Supplier VAT number not detected"

NUMBER_REQUIRED = "Invoice number is required"
DATE_REQUIRED = "Invoice date is required"
TOTAL_REQUIRED = "Total amount is required"
VAT_NUMBER_FORMAT = "Supplier VAT number should be 15 digits"
VAT_NUMBER_REQUIRED = "VAT number required for Saudi invoices"
LINES_UNMAPPED = " line item(s) have no product mapping"

NO_LINES_TO_POST = "No lines to post to inventory"
DATE_REQUIRED_FOR_ACCOUNTING = "Invoice date is required for accounting posting"
NUMBER_REQUIRED_FOR_ACCOUNTING = "Invoice number is required for accounting posting"
INVALID_TOTAL_FOR_ACCOUNTING = "Invalid total for accounting posting"
