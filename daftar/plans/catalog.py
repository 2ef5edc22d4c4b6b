"""Registered queries, each over whole tables, with the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from daftar.functions import patterns as P
from daftar.functions.text import canonical_text, date_from_digit_runs, leading_number, parse_date
from daftar.operators import assemble, headers, items_layout, items_text, mapping, posting, qr, review, rollups, status, validate
from daftar.operators.ledger import Ledger
from daftar.operators.status_log import StatusLog, approval_events, verdict_events
from daftar.operators.keyword_amounts import (
    amount_by_keywords,
    amount_near_keyword,
    amount_near_keyword_strict,
    document_amounts,
    line_amounts,
)
from daftar.plans import pipeline
from daftar.plans import tables as D
from daftar.plans.rendered import order_items, order_totals, positioned_invoices, statements, table, text_invoices
from daftar.session import configure
from daftar.sources import ocr
from daftar.sources import uploads as up
from daftar.sources.tables import read_table, stage, write_table
from daftar.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}


def _even4(value: str) -> str:
    """SQL that rounds a double on its exact binary value to four places, ties to the even digit."""
    scaled, unit = f"(CAST(({value}) * 4611686018427387904.0::DOUBLE AS HUGEINT) * 10000)", "4611686018427387904::HUGEINT"
    whole, rest = f"({scaled} // {unit})", f"(({scaled} % {unit}) * 2)"
    return f"(CAST({whole} + CAST({rest} > {unit} OR ({rest} = {unit} AND {whole} % 2 = 1) AS HUGEINT) AS DOUBLE) / 10000)"


def query(name: str, sql: str | None = None):
    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf: fn(configure(spark), sf)
        if sql is not None:
            CHECKS[name] = _with_bases(re.sub("<even4:(.*?)>", lambda m: _even4(m[1]), sql, flags=re.S))
        return fn

    return register


# -- shared SQL ------------------------------------------------------------------------


def _totals(join: str) -> str:
    return f"""
tt AS (
  SELECT k, ck, od, n, s, v, CAST(s + v AS DECIMAL(12,2)) AS tv,
         CAST(s + v + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS DECIMAL(12,2)) AS t,
         '3' || lpad(CAST(ck AS VARCHAR), 13, '0') || '3' AS vn
  FROM (SELECT *, CAST(round(s * CAST(0.15 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS v
        FROM (SELECT o_orderkey AS k, o_custkey AS ck, o_orderdate AS od, coalesce(ln, 0) AS n,
                     CAST(coalesce(ls, 0) AS DECIMAL(12,2)) AS s
              FROM orders {join} (
                SELECT l_orderkey AS lk, count(*) AS ln,
                       CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(12,2)) AS ls
                FROM lineitem GROUP BY l_orderkey) ON lk = o_orderkey))),
"""


_BASES = {
    "it": """
it AS (
  SELECT l_orderkey AS k, l_partkey AS pk, l_suppkey AS sk, p_name AS name,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
              l_quantity, l_extendedprice, l_shipdate) AS INTEGER) AS i,
         CAST(l_quantity AS DECIMAL(12,3)) AS qty, CAST(l_quantity AS BIGINT) AS q,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS amount,
         CAST((2 * CAST(round(l_extendedprice * 100) AS BIGINT) + CAST(l_quantity AS BIGINT))
              // (2 * CAST(l_quantity AS BIGINT)) AS DECIMAL(14,0)) / 100 AS price_d
  FROM lineitem JOIN part ON l_partkey = p_partkey),
""",
    "tt": _totals("JOIN"),
    # the same over all orders, those without items included
    "te": _totals("LEFT JOIN"),
    "tx": """
tx AS (
  SELECT CAST(k AS VARCHAR) AS doc_id, 0 AS line_no,
         'Supplier: Trader ' || translate(lpad(CAST(ck AS VARCHAR), CAST(greatest(3, length(CAST(ck AS VARCHAR))) AS INTEGER), '0'), '0123456789', 'ABCDEFGHIJ') AS text FROM tt
  UNION ALL SELECT CAST(k AS VARCHAR), 1, 'الرقم الضريبي ' || vn FROM tt WHERE k % 13 <> 0
  UNION ALL SELECT CAST(k AS VARCHAR), 2, 'فاتورة# ' || CAST(k AS VARCHAR) FROM tt WHERE k % 7 <> 0
  UNION ALL SELECT CAST(k AS VARCHAR), 3, 'التاريخ: ' || strftime(od, '%Y-%m-%d') FROM tt
  UNION ALL SELECT CAST(k AS VARCHAR), 4, 'الكمية وحدة السعر' FROM tt
  UNION ALL SELECT CAST(k AS VARCHAR), CAST(5 + 3 * n AS INTEGER), 'المجموع الفرعي SAR ' || CAST(s AS VARCHAR) FROM tt
  UNION ALL SELECT CAST(k AS VARCHAR), CAST(6 + 3 * n AS INTEGER), 'ضريبة القيمة المضافة (15%) SAR ' || CAST(v AS VARCHAR) FROM tt
  UNION ALL SELECT CAST(k AS VARCHAR), CAST(7 + 3 * n AS INTEGER), 'الإجمالي SAR ' || CAST(t AS VARCHAR) FROM tt
  UNION ALL SELECT CAST(k AS VARCHAR), 2 + 3 * i, CAST(q AS VARCHAR) || ' ' || name || ' SAR ' || CAST(amount AS VARCHAR) FROM it WHERE k % 19 <> 0
  UNION ALL SELECT CAST(k AS VARCHAR), 2 + 3 * i, CAST(q AS VARCHAR) FROM it WHERE k % 19 = 0
  UNION ALL SELECT CAST(k AS VARCHAR), 3 + 3 * i, name FROM it WHERE k % 19 = 0
  UNION ALL SELECT CAST(k AS VARCHAR), 4 + 3 * i, 'SAR ' || CAST(amount AS VARCHAR) FROM it WHERE k % 19 = 0),
""",
    # extractions and lines as in daftar.plans.tables
    "ex": """
ex AS (
  SELECT k, 'ex-' || k AS extraction_id, 'up-' || (k // 3) AS upload_id, 'Customer ' || ck AS supplier_name,
         CASE WHEN k % 29 = 0 THEN '12345' WHEN k % 13 <> 0 THEN vn END AS supplier_vat_number,
         CASE WHEN k % 7 <> 0 THEN CAST(k % 40 AS VARCHAR) END AS invoice_number,
         CASE WHEN k % 31 <> 0 THEN CAST(od AS DATE) END AS invoice_date,
         s AS subtotal, v AS vat_amount, CASE WHEN k % 37 <> 0 THEN t END AS total,
         CASE WHEN k % 41 = 0 THEN 'USD' ELSE 'SAR' END AS currency, od AS created_at
  FROM tt),
""",
    "el": """
el AS (
  SELECT 'ex-' || k AS extraction_id, 'ex-' || k || '-' || i AS line_id, i AS line_no, name AS raw_name,
         qty AS quantity, CASE pk % 4 WHEN 0 THEN 'Box' WHEN 1 THEN 'pcs' WHEN 2 THEN 'كرتون' END AS unit,
         CAST(price_d AS DECIMAL(12,2)) AS unit_price, amount AS line_total,
         CASE WHEN pk % 10 <> 0 THEN 'p-' || pk END AS product_id
  FROM it),
""",
    "dup": """
dup AS (
  SELECT supplier_vat_number AS dv, invoice_number AS dn, min(row(created_at, extraction_id)) AS first
  FROM ex WHERE supplier_vat_number <> '' AND invoice_number <> ''
  GROUP BY 1, 2 HAVING count(*) > 1),
fl AS (
  SELECT ex.*, dv IS NOT NULL AS is_duplicate,
         coalesce(row(created_at, extraction_id) > first, FALSE) AS is_late,
         invoice_number IS NULL AS no_number, invoice_date IS NULL AS no_date,
         coalesce(total, 0) = 0 AS no_total,
         coalesce(length(supplier_vat_number) <> 15, FALSE) AS vat_malformed,
         supplier_vat_number IS NULL AND currency = 'SAR' AS vat_missing,
         coalesce(subtotal <> 0 AND vat_amount <> 0 AND total <> 0
                  AND abs(subtotal + vat_amount - total) > 0.1, FALSE) AS total_off
  FROM ex LEFT JOIN dup ON supplier_vat_number = dv AND invoice_number = dn),
""",
    "ls": """
ls AS (
  SELECT extraction_id AS le, sum(line_total) AS items_sum,
         count(*) FILTER (WHERE abs(quantity * unit_price - line_total) > 0.1) AS n_mismatch,
         count(*) FILTER (WHERE product_id IS NULL) AS n_unmapped
  FROM el GROUP BY 1),
vd AS (
  SELECT extraction_id, upload_id, supplier_vat_number,
         CAST(no_number::INT + no_date::INT + no_total::INT + is_duplicate::INT AS BIGINT) AS n_errors,
         CAST(vat_malformed::INT + vat_missing::INT + total_off::INT
              + coalesce(abs(items_sum - subtotal) > 0.1, FALSE)::INT
              + coalesce(n_mismatch, 0) + (coalesce(n_unmapped, 0) > 0)::INT AS BIGINT) AS n_warnings
  FROM fl LEFT JOIN ls ON le = extraction_id),
""",
    "lx": """
lx AS (
  SELECT * EXCLUDE (r) FROM (
    SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, extraction_id) AS r FROM ex)
  WHERE r = 1),
""",
    "ul": """
ul AS (
  SELECT 'up-' || u AS upload_id, CASE WHEN u % 17 = 0 THEN 'OCR_FAILED' ELSE 'NEEDS_REVIEW' END AS status,
         'image/png' AS mime_type, created_at
  FROM (SELECT o_orderkey // 3 AS u, max(o_orderdate) AS created_at FROM orders GROUP BY 1)),
""",
    "ad": """
ad AS (
  SELECT lx.*, CASE
      WHEN errors <> '' THEN 'Cannot approve: ' || errors
      WHEN ul.status = 'OCR_FAILED' THEN 'Cannot approve a failed invoice'
      WHEN upload_id LIKE '%5' THEN 'Invoice already approved' END AS reject_reason
  FROM lx JOIN ul USING (upload_id) JOIN (
    SELECT extraction_id, concat_ws('; ',
        CASE WHEN no_number THEN 'Invoice number is required' END,
        CASE WHEN no_date THEN 'Invoice date is required' END,
        CASE WHEN no_total THEN 'Total amount is required' END,
        CASE WHEN total_off THEN 'Total mismatch' END,
        CASE WHEN is_duplicate THEN 'Duplicate invoice' END) AS errors FROM fl) USING (extraction_id)),
""",
    "pi": """
pi AS (
  SELECT 'pi-' || k AS purchase_invoice_id, 'ex-' || k AS extraction_id, vn AS supplier_vat_number,
         CASE WHEN k % 7 <> 0 THEN CAST(k AS VARCHAR) END AS invoice_number,
         CASE WHEN k % 31 <> 0 THEN CAST(od AS DATE) END AS invoice_date,
         s AS subtotal, CASE WHEN k % 23 <> 0 THEN v END AS vat_amount, t AS total
  FROM tt),
""",
    "pl": """
pl AS (
  SELECT 'pi-' || k AS purchase_invoice_id, CASE WHEN pk % 50 <> 0 THEN 'p-' || pk END AS product_id,
         CASE WHEN pk % 60 <> 7 THEN qty ELSE 0 END AS quantity,
         CAST(price_d AS DECIMAL(12,2)) AS unit_price, amount AS line_total
  FROM it),
pg AS (
  SELECT purchase_invoice_id, count(*) AS n_lines,
         count(*) FILTER (WHERE product_id IS NULL) AS n_unmapped,
         count(*) FILTER (WHERE quantity <= 0) AS n_bad_quantity,
         count(*) FILTER (WHERE line_total <= 0) AS n_bad_total
  FROM pl GROUP BY 1),
mv AS (
  SELECT pl.purchase_invoice_id, product_id, quantity, unit_price AS unit_cost, line_total AS total_cost, invoice_date
  FROM pl JOIN pg USING (purchase_invoice_id) JOIN pi USING (purchase_invoice_id)
  WHERE n_unmapped = 0 AND n_bad_quantity = 0 AND n_bad_total = 0),
""",
    "je": """
je AS (
  SELECT 'je-' || purchase_invoice_id AS journal_entry_id, purchase_invoice_id, invoice_date AS entry_date,
         'Purchase invoice ' || invoice_number AS description, l.entry_line, l.account_code, l.account_name, l.side,
         CAST(CASE l.entry_line WHEN 1 THEN total - coalesce(vat_amount, 0) WHEN 2 THEN coalesce(vat_amount, 0)
              ELSE total END AS DECIMAL(12,2)) AS amount
  FROM pi, (VALUES (1, '1200', 'Inventory / Purchases', 'DR'), (2, '2400', 'VAT Input', 'DR'),
                   (3, '2100', 'Accounts Payable', 'CR')) AS l(entry_line, account_code, account_name, side)
  WHERE invoice_date IS NOT NULL AND invoice_number IS NOT NULL AND total > 0),
""",
    "st": """
st AS (
  SELECT 'up-' || user_id AS upload_id, event_id AS seq, ts, value,
         CASE event_type WHEN 'view' THEN 'QUEUED' WHEN 'click' THEN 'PROCESSING_OCR' WHEN 'purchase' THEN 'READY'
              WHEN 'signup' THEN 'NEEDS_REVIEW' ELSE 'OCR_FAILED' END AS status,
         CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'OCR_TIMEOUT' ELSE 'OCR_EMPTY_RESULT' END
         END AS error_code
  FROM events),
cs AS (
  SELECT upload_id, arg_max(status, row(ts, seq)) AS status, max(ts) AS since, count(*) AS n_events
  FROM st GROUP BY 1),
""",
    "nl": """
nl AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS line_id,
         l_quantity AS quantity,
         lower(CASE WHEN l_linenumber % 2 = 1 THEN p_name || ' ' || p_type ELSE p_name || ' ' || p_brand || ' ' || p_type END) AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
ma AS (
  SELECT 'm-' || n AS mapping_id, n AS normalized_name, 'p-' || min(pk) AS product_id
  FROM (SELECT p_partkey AS pk, lower(p_name || ' ' || p_type) AS n FROM part
        UNION ALL SELECT p_partkey, lower(p_name || ' ' || p_brand) FROM part) GROUP BY n),
""",
    "fz": """
nm AS (SELECT DISTINCT name, list_distinct(string_split(name, ' ')) AS w FROM nl),
mw AS (SELECT *, list_distinct(string_split(normalized_name, ' ')) AS w FROM ma),
sc AS (
  SELECT name, mapping_id, product_id, normalized_name,
         len(list_intersect(nm.w, mw.w))::DOUBLE
           / (len(nm.w) + len(mw.w) - len(list_intersect(nm.w, mw.w))) AS score
  FROM nm, mw),
fz AS (SELECT * FROM sc WHERE score > 0.5),
sg AS (
  SELECT nm.name, mapping_id, product_id, 1.0::DOUBLE AS score, 'exact' AS method
  FROM nm JOIN ma ON name = normalized_name
  UNION ALL
  SELECT name, mapping_id, product_id, score, 'fuzzy' FROM (
    SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, mapping_id) AS r
    FROM fz WHERE name NOT IN (SELECT normalized_name FROM ma)) WHERE r <= 5),
""",
}


def _with_bases(sql: str) -> str:
    """Put the shared subqueries a check names as ``{it}{tt}…`` in front of it."""
    names = []
    while sql.startswith("{"):
        name, sql = sql[1:].split("}", 1)
        names.append(name)
    if not names:
        return sql
    return "WITH " + "".join(_BASES[n] for n in names).rstrip().rstrip(",") + "\n" + sql


def _join(c: str):
    return F.array_join(c, "; ").alias(c)


# -- 2.1 sources and sinks -------------------------------------------------------------


def _upload_files(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    ends = F.array(*[F.lit(e) for e in (".JPG", ".png", ".pdf", ".tiff", "", ".jpeg")])
    mimes = F.array(*[F.lit(m) for m in ("image/jpeg", "image/png", "application/pdf", "text/plain", None)])
    return table(spark, sf, "orders").select(
        F.concat(F.lit("up-"), k.cast("string")).alias("upload_id"),
        F.concat(F.lit("scan.no"), k.cast("string"), F.get(ends, (k % 6).cast("int"))).alias("file_name"),
        F.get(mimes, (k % 5).cast("int")).alias("mime_type"),
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("size_bytes"),
        F.col("o_orderdate").alias("created_at"),
    )


_FILES = """
SELECT 'up-' || o_orderkey AS upload_id, o_orderdate AS created_at,
       CASE o_orderkey % 6 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' WHEN 2 THEN '.pdf' WHEN 3 THEN '.tiff'
            WHEN 4 THEN '.no' || o_orderkey ELSE '.jpeg' END AS extension,
       CASE WHEN o_orderkey % 5 IN (3, 4) THEN 'invalid file type'
            WHEN CAST(round(o_totalprice * 100) AS BIGINT) > 20 * 1024 * 1024 THEN 'file too large'
            WHEN o_orderkey % 6 IN (3, 4) THEN 'invalid file extension' END AS reject_reason
FROM orders
"""


@query("admit_uploads", f"SELECT upload_id, extension, reject_reason FROM ({_FILES})")
def admit(spark, sf):
    return up.admit_uploads(_upload_files(spark, sf)).select("upload_id", "extension", "reject_reason")


@query(
    "scan_uploads",
    """SELECT c_mktsegment AS folder, CAST(sum(strlen(c_name || ' ' || c_custkey) + 1) AS BIGINT) AS n_bytes, 'invalid file type' AS reject_reason
    FROM customer GROUP BY 1""",
)
def scanned_uploads(spark, sf):
    """Text files in one folder per market segment: found, measured, and turned away by their type."""
    folder = jobs.work_folder(spark, "uploads")
    text = F.concat_ws(" ", "c_name", "c_custkey").alias("value")
    table(spark, sf, "customer").select(text, F.col("c_mktsegment").alias("segment")).write.partitionBy("segment").text(folder)
    found = up.admit_uploads(up.scan_uploads(spark, folder))
    return found.groupBy(F.regexp_extract("path", "segment=([^/]+)", 1).alias("folder"), "reject_reason").agg(F.sum("size_bytes").alias("n_bytes"))


@query("accepted_uploads", f"SELECT upload_id, extension, 'QUEUED' AS status FROM ({_FILES}) WHERE reject_reason IS NULL")
def accepted(spark, sf):
    return up.accepted_uploads(_upload_files(spark, sf)).select("upload_id", "extension", "status")


@query("list_uploads", "{ul} SELECT upload_id, status, created_at FROM ul ORDER BY created_at DESC, upload_id")
def listed(spark, sf):
    return up.list_uploads(D.uploads(spark, sf)).select("upload_id", "status", "created_at")


# OCR responses are kept compressed; a packed file is read by one task, so its rows are limited
PACKED = {"compression": "gzip", "maxRecordsPerFile": 50_000}


def _ocr_documents(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """Rendered invoices as nested OCR responses; with ``every``, also orders without items, some without any line."""
    line = F.struct(
        "line_no",
        F.struct(
            "text", F.lit(0.9).alias("confidence"),
            F.struct(
                F.lit(50.0).alias("x1"), (F.col("line_no") * 30.0).alias("y1"),
                F.lit(540.0).alias("x2"), (F.col("line_no") * 30.0 + 22).alias("y2"),
            ).alias("box"),
        ).alias("l"),
    )
    docs = text_invoices(spark, sf, every).groupBy("doc_id").agg(F.sort_array(F.collect_list(line))["l"].alias("lines"))
    if every:
        docs = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id")).join(docs, "doc_id", "left")
    return docs.select(
        "doc_id", F.lit("hybrid").alias("engine"), F.lit("standard").alias("pass"),
        F.array(F.struct(F.lit(1).alias("pageNumber"), "lines")).alias("pages"),
    )


@query(
    "scan_ocr_json",
    """{it}{tt}{tx} SELECT doc_id, 1 AS page_no,
    CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS line_no,
    CASE WHEN CAST(doc_id AS BIGINT) % 5 = 0 THEN translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE text END AS text,
    50.0::DOUBLE AS x1, line_no * 30.0::DOUBLE AS y1 FROM tx""",
)
def scan(spark, sf):
    folder = jobs.work_folder(spark, "ocr-json")
    _ocr_documents(spark, sf).write.options(**PACKED).json(folder)
    return ocr.result_lines(ocr.scan_ocr_json(spark, folder)).select("doc_id", "page_no", "line_no", "text", "x1", "y1")


@query(
    "ocr_result_summary",
    """{it}{tt}{tx} SELECT doc_id, 'hybrid' AS engine, '2.' || (k % 3) AS engine_version, k % 8 / 8.0::DOUBLE AS confidence, k % 4 = 0 AS used_fallback,
    CASE WHEN k % 2 = 0 THEN 1 ELSE 0 END AS n_pages, CAST(n_lines AS INTEGER) AS n_lines, CAST(len AS INTEGER) AS text_length, k % 5 = 0 AS has_markdown,
    CASE WHEN k % 3 = 0 THEN 'Trader ' || k END AS qr_seller, CASE WHEN k % 3 = 0 THEN vn END AS qr_vat_number, CASE WHEN k % 3 = 0 THEN CAST(t AS VARCHAR) END AS qr_total
    FROM (SELECT doc_id, count(*) AS n_lines, sum(length(text)) + count(*) - 1 AS len FROM tx GROUP BY 1) JOIN tt ON doc_id = CAST(k AS VARCHAR)""",
)
def ocr_summaries(spark, sf):
    return ocr.result_summary(_full_results(spark, sf))


@query(
    "scan_top_level_lines",
    """{it}{tt}{tx} SELECT doc_id, 1 AS page_no, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS INTEGER) AS line_no,
    CASE WHEN CAST(doc_id AS BIGINT) % 5 = 0 THEN translate(text, '0123456789', '٠١٢٣٤٥٦٧٨٩') ELSE text END AS text FROM tx""",
)
def scan_top_level(spark, sf):
    return ocr.result_lines(_full_results(spark, sf)).select("doc_id", "page_no", "line_no", "text")


@query("rejected_results", "{it}{tt} SELECT '{\"doc_id\": ' || k AS raw FROM tt")
def rejects(spark, sf):
    """Every response once as it is and once cut off."""
    folder = jobs.work_folder(spark, "ocr-cut")
    _ocr_documents(spark, sf).select(F.to_json(F.struct("*")).alias("value")).write.options(**PACKED).text(folder)
    order_totals(spark, sf).select(F.concat(F.lit('{"doc_id": '), F.col("order_key").cast("string")).alias("value")).write.mode("append").options(**PACKED).text(folder)
    return ocr.rejected_results(ocr.scan_ocr_json(spark, folder)).select(F.col("_corrupt_record").alias("raw"))


def _full_results(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with every field; those of odd orders have their lines at the top and no pages."""
    folder, k = jobs.work_folder(spark, "ocr-full"), F.col("order_key")
    docs = _ocr_documents(spark, sf).withColumn("l", F.get("pages", F.lit(0))["lines"])
    known = order_totals(spark, sf).select("order_key", "vat_number", F.col("total").cast("string").alias("total"))
    docs = docs.join(known, F.col("doc_id") == k.cast("string"))
    zatca = F.struct(F.concat(F.lit("Trader "), k.cast("string")).alias("sellerName"), F.col("vat_number").alias("vatNumber"), "total")
    docs.select(
        "doc_id", "engine", F.concat(F.lit("2."), (k % 3).cast("string")).alias("engineVersion"), ((k % 8) / 8).alias("confidence"),
        F.array_join(F.col("l.text"), "\n").alias("rawText"), F.when(k % 2 == 0, F.col("pages")).alias("pages"), F.when(k % 2 != 0, F.col("l")).alias("lines"),
        F.when(k % 3 == 0, F.struct(F.lit("x").alias("rawText"), zatca.alias("zatca"))).alias("qr"), F.when(k % 5 == 0, "# text").alias("markdown"),
        F.when(k % 4 == 0, True).alias("usedEnhancedFallback"),
    ).write.options(**PACKED).json(folder)
    return ocr.scan_ocr_json(spark, folder)


def _engine_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Engine output per order: the last line has no polygon, the last two no score."""
    point = lambda x, y: F.array(x, y)
    x, y = F.col("qty").cast("double"), F.col("item_no") * 20.0
    poly = F.array(point(x, y), point(x + 90.0, y + 1.0), point(x + 91.0, y + 18.0), point(x - 1.0, y + 17.0))
    rows = order_items(spark, sf).groupBy("order_key").agg(
        F.sort_array(F.collect_list(F.struct("item_no", "name", poly.alias("poly"), (x / 50).alias("score")))).alias("r")
    )
    n = F.size("r")
    cut = lambda c, drop: F.slice(F.col(f"r.{c}"), F.lit(1), F.greatest(n - drop, F.lit(0)))
    return rows.select(
        F.col("order_key").cast("string").alias("doc_id"), F.lit(1).alias("page_no"),
        F.col("r.name").alias("rec_texts"), cut("score", 2).alias("rec_scores"), cut("poly", 1).alias("dt_polys"),
    )


@query(
    "flatten_ocr_result",
    """{it} SELECT CAST(k AS VARCHAR) AS doc_id, i - 1 AS line_no, name AS text,
    CASE WHEN i <= n - 2 THEN q / 50.0::DOUBLE ELSE 0.0 END AS confidence,
    CASE WHEN i <= n - 1 THEN q - 1.0::DOUBLE ELSE 0.0 END AS x1, CASE WHEN i <= n - 1 THEN i * 20.0::DOUBLE ELSE (i - 1) * 30.0::DOUBLE END AS y1,
    CASE WHEN i <= n - 1 THEN q + 91.0::DOUBLE ELSE 500.0 END AS x2, CASE WHEN i <= n - 1 THEN i * 20.0::DOUBLE + 18 ELSE (i - 1) * 30.0::DOUBLE + 25 END AS y2
    FROM (SELECT *, count(*) OVER (PARTITION BY k) AS n FROM it)""",
)
def flatten(spark, sf):
    return ocr.flatten_ocr_result(_engine_pages(spark, sf)).drop("page_no")


@query(
    "flatten_legacy_result",
    """{it} SELECT CAST(k AS VARCHAR) AS doc_id, i - 1 AS line_no, name AS text, q / 50.0::DOUBLE AS confidence,
    1.0::DOUBLE * q AS x1, 1.0::DOUBLE * i AS y1, q + 5.0::DOUBLE AS x2, i + 7.0::DOUBLE AS y2 FROM it""",
)
def flatten_legacy(spark, sf):
    x, y = F.col("qty").cast("double"), F.col("item_no").cast("double")
    line = F.struct(
        F.array(F.array(x, y), F.array(x + 5, y + 7)).alias("polygon"),
        F.col("name").alias("text"),
        (x / 50).alias("confidence"),
    )
    first = order_items(spark, sf).groupBy("order_key").agg(
        F.sort_array(F.collect_list(F.struct("item_no", line.alias("l"))))["l"].alias("p")
    )
    # a second page repeats the first and must not show up
    pages = first.select(F.col("order_key").cast("string").alias("doc_id"), F.array("p", "p").alias("pages"))
    return ocr.flatten_legacy_result(pages).drop("page_no")


@query("write_tables", "{tt}{pi} SELECT purchase_invoice_id, invoice_date, total FROM pi")
def written(spark, sf):
    folder = jobs.work_folder(spark, "tables")
    write_table(D.purchase_invoices(spark, sf), folder, "purchase_invoices")
    return read_table(spark, folder, "purchase_invoices").select("purchase_invoice_id", "invoice_date", "total")


@query("delete_uploads", "{ul} SELECT upload_id, status FROM ul WHERE status <> 'OCR_FAILED'")
def deleted(spark, sf):
    uploads = D.uploads(spark, sf)
    left, _ = up.delete_uploads(uploads, uploads.where(F.col("status") == "OCR_FAILED"))
    return left.select("upload_id", "status")


# -- 2.2 document assembly -------------------------------------------------------------


def _scored_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Item lines on two pages with confidences."""
    return order_items(spark, sf).select(
        F.col("order_key").cast("string").alias("doc_id"),
        F.when(F.col("item_no") % 2 == 0, 2).otherwise(1).alias("page_no"),
        F.col("item_no").alias("line_no"),
        F.col("name").alias("text"),
        (F.col("qty").cast("double") / 64).alias("confidence"),
        (F.col("supp_key") % 7).cast("double").alias("y1"),
    )


def _order_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"))


@query(
    "page_summary",
    """{it} SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END AS page_no,
    string_agg(name, chr(10) ORDER BY i) AS raw_text, CAST(count(*) AS BIGINT) AS n_lines, <even4:avg(q / 64.0::DOUBLE)> AS confidence
    FROM it GROUP BY 1, 2""",
)
def pages(spark, sf):
    return assemble.page_summary(_scored_lines(spark, sf))


@query(
    "document_summary",
    """{it} SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, coalesce(string_agg(name, chr(10) ORDER BY i), '') AS raw_text,
    CAST(count(name) AS BIGINT) AS n_lines, coalesce(<even4:avg(q / 64.0::DOUBLE)>, 0) AS confidence
    FROM orders LEFT JOIN it ON k = o_orderkey GROUP BY 1""",
)
def documents(spark, sf):
    return assemble.document_summary(_scored_lines(spark, sf), _order_docs(spark, sf))


@query(
    "document_markdown",
    "{it} SELECT CAST(k AS VARCHAR) AS doc_id, string_agg(name, chr(10) ORDER BY sk % 7, i) AS markdown FROM it GROUP BY 1",
)
def markdown(spark, sf):
    return assemble.document_markdown(_scored_lines(spark, sf))


@query(
    "empty_document_warning",
    """SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, 'OCR produced no text lines' AS warning FROM orders
    WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""",
)
def empty(spark, sf):
    return assemble.empty_document_warning(_order_docs(spark, sf), _scored_lines(spark, sf))


def _passes(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.when(F.col("o_orderkey") % 9 == 0, "other").otherwise("hybrid").alias("engine"),
    )
    standard = _scored_lines(spark, sf)
    li = order_items(spark, sf)
    enhanced = li.where(F.col("part_key") % 3 != 0).select(
        F.col("order_key").cast("string").alias("doc_id"),
        F.when(F.col("item_no") % 2 == 0, 2).otherwise(1).alias("page_no"),
        F.col("item_no").alias("line_no"),
        F.upper("name").alias("text"),
        ((F.col("part_key") % 32).cast("double") / 32).alias("confidence"),
        (F.col("supp_key") % 7).cast("double").alias("y1"),
    )
    return docs, standard, enhanced


_PASSES = """
ps AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, std, enh,
         o_orderkey % 9 <> 0 AND coalesce(std < 0.75, FALSE) AS tried,
         o_orderkey % 9 <> 0 AND coalesce(std < 0.75, FALSE) AND coalesce(enh > std, FALSE) AS better
  FROM orders
  LEFT JOIN (SELECT k, avg(q / 64.0::DOUBLE) AS std FROM it GROUP BY 1) a ON a.k = o_orderkey
  LEFT JOIN (SELECT k, avg((pk % 32) / 32.0::DOUBLE) AS enh FROM it WHERE pk % 3 <> 0 GROUP BY 1) b ON b.k = o_orderkey)
"""
_BASES["ps"] = _PASSES.rstrip() + ",\n"


@query(
    "choose_ocr_pass",
    """{it}{ps} SELECT doc_id, better AS used_enhanced,
    <even4:CASE WHEN better THEN enh ELSE coalesce(std, 0) END> AS confidence,
    tried AND NOT better AS warned FROM ps""",
)
def chosen_pass(spark, sf):
    choice = assemble.choose_ocr_pass(*_passes(spark, sf))
    return choice.select("doc_id", "used_enhanced", "confidence", F.col("warning").isNotNull().alias("warned"))


@query(
    "select_ocr_pass",
    """{it}{ps} SELECT doc_id, CASE WHEN better OR i % 2 = 1 THEN 1 ELSE 2 END AS page_no, i AS line_no,
    CASE WHEN better THEN upper(name) ELSE name END AS text
    FROM it JOIN ps ON doc_id = CAST(k AS VARCHAR) WHERE NOT better OR pk % 3 <> 0""",
)
def pass_lines(spark, sf):
    docs, standard, enhanced = _passes(spark, sf)
    choice = assemble.choose_ocr_pass(docs, standard, enhanced)
    return assemble.select_ocr_pass(choice, standard, enhanced).select("doc_id", "page_no", "line_no", "text")


def _qr_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """QR payloads of the invoices: seller, VAT number, time, total, VAT amount.

    Every 8th is broken, every 9th cut short inside its last record.
    """
    k = F.col("order_key")

    def record(tag: int, value: Column) -> Column:
        v = value.cast("binary")
        return F.concat(F.lit(bytes([tag])), F.unhex(F.lpad(F.hex(F.length(v)), 2, "0")), v)

    seller = F.concat(F.lit("مورد "), F.col("o_custkey").cast("string"))
    blob = F.concat(
        record(1, seller),
        record(2, F.col("vat_number")),
        record(3, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        record(4, F.col("true_total").cast("string")),
        record(5, F.col("vat").cast("string")),
    )
    cut = F.when(k % 9 == 0, F.substr(blob, F.lit(1), F.length(blob) - 1)).otherwise(blob)
    return order_totals(spark, sf).select(
        k.cast("string").alias("doc_id"),
        F.when(k % 8 == 0, "not-base64!!").otherwise(F.base64(cut)).alias("payload"),
    )


_QR = """
SELECT k, CAST(k AS VARCHAR) AS doc_id,
  CASE WHEN k % 8 <> 0 THEN 'مورد ' || ck END AS seller_name,
  CASE WHEN k % 8 <> 0 THEN vn END AS vat_number,
  CASE WHEN k % 8 <> 0 THEN strftime(od, '%Y-%m-%dT%H:%M:%SZ') END AS "timestamp",
  CASE WHEN k % 8 <> 0 THEN CAST(tv AS VARCHAR) END AS total,
  CASE WHEN k % 8 <> 0 AND k % 9 <> 0 THEN CAST(v AS VARCHAR) END AS vat_amount
FROM tt
"""


@query("decode_qr_table", "{tt} SELECT * EXCLUDE (k) FROM (" + _QR + ")")
def decoded(spark, sf):
    return qr.decode_qr_table(_qr_payloads(spark, sf))


_RECONCILED = (
    """SELECT doc_id, CASE WHEN k % 13 <> 0 THEN vat_number = vn END AS vat_number_ok,
  abs(CAST(q.total AS DECIMAL(12,2)) - t) <= 0.1 AS total_ok,
  abs(CAST(q.vat_amount AS DECIMAL(12,2)) - v) <= 0.1 AS vat_amount_ok FROM ("""
    + _QR
    + ") q JOIN tt USING (k)"
)


def _qr_headers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("order_key")
    return order_totals(spark, sf).select(
        k.cast("string").alias("doc_id"),
        F.when(k % 13 != 0, F.col("vat_number")).alias("supplier_vat_number"),
        "total",
        F.col("vat").alias("vat_amount"),
    )


@query("qr_reconcile", "{tt} " + _RECONCILED)
def reconciled(spark, sf):
    return qr.qr_reconcile(qr.decode_qr_table(_qr_payloads(spark, sf)), _qr_headers(spark, sf))


@query(
    "qr_reconcile_summary",
    "{tt} SELECT count(*) AS n_docs, "
    + ", ".join(
        f"count(*) FILTER (WHERE {c}) AS n_{c}, count(*) FILTER (WHERE NOT {c}) AS n_{c}_not"
        for c in ("vat_number_ok", "total_ok", "vat_amount_ok")
    )
    + f" FROM ({_RECONCILED})",
)
def reconciled_summary(spark, sf):
    both = qr.qr_reconcile(qr.decode_qr_table(_qr_payloads(spark, sf)), _qr_headers(spark, sf))
    return qr.qr_reconcile_summary(both)


# -- 2.3 normalization -----------------------------------------------------------------


@query("normalize_lines", "{it}{tt}{tx} SELECT doc_id, line_no, text FROM tx")
def normalized(spark, sf):
    return text_invoices(spark, sf).select("doc_id", "line_no", canonical_text("text").alias("text"))


@query(
    "normalize_documents",
    r"""SELECT doc_id, regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(regexp_replace(text,
    '(?i)SAR\s*:', 'SAR', 'g'), '[ \t]+', ' ', 'g'), '\n{2,}', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)), '^\s+', ''), '\s+$', '') AS text
    FROM documents""",
)
def normalized_documents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", canonical_text("text").alias("text"))


@query(
    "amount_parse",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS amount FROM lineitem",
)
def amounts(spark, sf):
    shown = F.concat(F.format_number("l_extendedprice", 2), F.lit(" SAR"))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", leading_number(shown).alias("amount")
    )


@query(
    "date_parse",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 < 4 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date FROM orders""",
)
def dates(spark, sf):
    d, form = F.col("o_orderdate"), F.col("o_orderkey") % 5
    shown = (
        F.when(form == 0, F.date_format(d, "yyyyMMdd"))
        .when(form == 1, F.date_format(d, "d/M/yyyy"))
        .when(form == 2, F.date_format(d, "yyyy.MM.dd"))
        .when(form == 3, F.translate(F.date_format(d, " dd-MM-yyyy "), "0123456789", "٠١٢٣٤٥٦٧٨٩"))
        .otherwise(F.date_format(d, "dd/MM/yy"))
    )
    return table(spark, sf, "orders").select("o_orderkey", parse_date(shown).alias("iso_date"))


_RUN_OK = (
    "CAST(substr(c,1,4) AS INT) BETWEEN 1900 AND 2100 AND CAST(substr(c,5,2) AS INT) BETWEEN 1 AND 12 "
    "AND CAST(substr(c,7,2) AS INT) BETWEEN 1 AND 31"
)


@query(
    "date_from_digit_runs",
    f"""SELECT doc_id, substr(c,1,4) || '-' || substr(c,5,2) || '-' || substr(c,7,2) AS iso_date FROM (
    SELECT doc_id, list_filter(flatten(list_transform(regexp_extract_all(text, '[0-9]{{8,}}'), lambda r: [right(r, 8), left(r, 8)])),
    lambda c: {_RUN_OK})[1] AS c FROM documents)""",
)
def digit_runs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", date_from_digit_runs("text").alias("iso_date"))


# -- 2.4 headers -----------------------------------------------------------------------

_HEADERS = """
SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN k % 7 <> 0 THEN CAST(k AS VARCHAR) END AS invoice_number,
  CAST(NULL AS VARCHAR) AS order_number, CASE WHEN k % 13 <> 0 THEN vn END AS supplier_vat_number,
  CAST(od AS DATE) AS invoice_date,
  'Trader ' || translate(lpad(CAST(ck AS VARCHAR), CAST(greatest(3, length(CAST(ck AS VARCHAR))) AS INTEGER), '0'), '0123456789', 'ABCDEFGHIJ') AS supplier_name,
  'SAR' AS currency, s AS subtotal, v AS vat_amount, t AS total,
  CAST(CASE WHEN k % 7 = 0 AND k % 13 = 0 THEN 0.75 ELSE 1 END AS DECIMAL(5,2)) AS confidence,
  concat_ws('; ', CASE WHEN k % 7 = 0 THEN 'Invoice number not detected' END,
            CASE WHEN k % 13 = 0 THEN 'Supplier VAT number not detected' END) AS warnings
FROM tt
"""


def _headers(spark, sf):
    return headers.extract_headers(text_invoices(spark, sf))


@query("extract_headers", "{tt}" + _HEADERS)
def header_rows(spark, sf):
    h = _headers(spark, sf)
    return h.withColumn("warnings", F.array_join("warnings", "; ")).select(headers.HEADER_FIELDS)


_HEADERS_OF_EVERY_ORDER = """SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN seen AND k % 7 <> 0 THEN CAST(k AS VARCHAR) END AS invoice_number,
  CAST(NULL AS VARCHAR) AS order_number,
  CASE WHEN seen AND k % 13 <> 0 THEN '3' || lpad(CAST(ck AS VARCHAR), 13, '0') || '3' END AS supplier_vat_number,
  CASE WHEN seen THEN CAST(od AS DATE) END AS invoice_date,
  CASE WHEN seen THEN 'Trader ' || translate(lpad(CAST(ck AS VARCHAR), CAST(greatest(3, length(CAST(ck AS VARCHAR))) AS INTEGER), '0'), '0123456789', 'ABCDEFGHIJ') END AS supplier_name,
  'SAR' AS currency, CASE WHEN seen THEN s END AS subtotal, CASE WHEN seen THEN v END AS vat_amount, CASE WHEN seen THEN t END AS total,
  CAST(CASE WHEN seen THEN least(1, ((k % 7 <> 0)::INT + (k % 13 <> 0)::INT + 1 + (s <> 0)::INT + (t <> 0)::INT) / 4) ELSE 0 END AS DECIMAL(5,2)) AS confidence,
  concat_ws('; ', CASE WHEN NOT seen OR k % 7 = 0 THEN 'Invoice number not detected' END,
            CASE WHEN NOT seen THEN 'Invoice date not detected' END,
            CASE WHEN NOT seen OR t = 0 THEN 'Total amount not detected' END,
            CASE WHEN NOT seen OR k % 13 = 0 THEN 'Supplier VAT number not detected' END) AS warnings
FROM (
  SELECT *, n > 0 OR k % 2 <> 0 AS seen, CAST(s + v + CASE WHEN k % 11 = 0 THEN 5 ELSE 0 END AS DECIMAL(12,2)) AS t
  FROM (SELECT *, CAST(round(s * CAST(0.15 AS DECIMAL(3,2)), 2) AS DECIMAL(12,2)) AS v
        FROM (SELECT o_orderkey AS k, o_custkey AS ck, o_orderdate AS od, count(l_orderkey) AS n,
                     CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(12,2))), 0) AS DECIMAL(12,2)) AS s
              FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)))"""


def _headers_of_every_order(spark, sf):
    sheets = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    return headers.extract_headers(text_invoices(spark, sf, every=True), documents=sheets)


@query("extract_headers_every_order", _HEADERS_OF_EVERY_ORDER)
def header_rows_of_every_order(spark, sf):
    h = _headers_of_every_order(spark, sf)
    return h.withColumn("warnings", F.array_join("warnings", "; ")).select(headers.HEADER_FIELDS)


@query(
    "line_amounts",
    r"""{it}{tt}{tx} SELECT doc_id, line_no, CAST(CASE WHEN text LIKE '%SAR %' THEN split_part(text, 'SAR ', 2) END AS DECIMAL(20,2)) AS amount FROM tx""",
)
def amounts_by_line(spark, sf):
    return line_amounts(text_invoices(spark, sf)).select("doc_id", "line_no", "amount")


@query(
    "long_document_amounts",
    """{it} SELECT CAST(k // 1000 AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY k // 1000 ORDER BY k, i) AS INTEGER) AS position,
    CAST(amount AS DECIMAL(20,2)) AS amount FROM it UNION ALL SELECT DISTINCT CAST(k // 1000 AS VARCHAR), 0, NULL::DECIMAL(20,2) FROM it""",
)
def amounts_of_long_documents(spark, sf):
    lines = stage(statements(spark, sf), "statements")  # read by the probe and by the job
    return document_amounts(lines)


@query("amount_near_keyword", "{tt} SELECT CAST(k AS VARCHAR) AS doc_id, CAST(v AS DECIMAL(20,2)) AS amount FROM tt")
def near_keyword(spark, sf):
    return amount_near_keyword(text_invoices(spark, sf), P.LOOSE_VAT)


@query(
    "amount_near_keyword_strict",
    """{it}{tt} SELECT CAST(k AS VARCHAR) AS doc_id, CAST(amount AS DECIMAL(20,2)) AS amount FROM tt JOIN it USING (k) WHERE i = 1 AND k % 19 <> 0
    UNION ALL SELECT CAST(k AS VARCHAR), CAST(amount AS DECIMAL(20,2)) FROM tt JOIN it USING (k) WHERE i = 1 AND k % 19 = 0""",
)
def near_keyword_strict(spark, sf):
    return amount_near_keyword_strict(
        text_invoices(spark, sf), P.COLUMN_TITLES, 1, 3, exclude=[r"الإجمالي|total"], prefer_arabic=True
    )


@query("amount_by_keywords", "{tt} SELECT CAST(k AS VARCHAR) AS doc_id, CAST(t AS DECIMAL(20,2)) AS amount FROM tt")
def by_keywords(spark, sf):
    return amount_by_keywords(text_invoices(spark, sf), P.TOTAL_LABELS, P.NOT_A_TOTAL, prefer_last=True)


@query(
    "extraction_coverage",
    "SELECT strftime(invoice_date, '%Y') AS year, count(*) AS n_docs, "
    + ", ".join(f"round(avg(({c} IS NOT NULL)::INT), 6) AS {c}_rate" for c in headers.COVERED)
    + f""", CAST(sum(CASE WHEN warnings = '' THEN 0 ELSE len(string_split(warnings, '; ')) END) AS BIGINT) AS n_warnings,
    round(avg(CAST(confidence AS DOUBLE)), 6) AS mean_confidence FROM ({_HEADERS_OF_EVERY_ORDER}) GROUP BY ROLLUP (1)""",
)
def coverage(spark, sf):
    """Over all orders, those without items included, and every field of a header."""
    dated = _headers_of_every_order(spark, sf).withColumn("year", F.date_format("invoice_date", "yyyy"))
    return headers.extraction_coverage(dated, "year")


@query(
    "warning_counts",
    f"{{tt}} SELECT warning, count(*) AS n_docs FROM (SELECT unnest(string_split(warnings, '; ')) AS warning FROM ({_HEADERS}) WHERE warnings <> '') GROUP BY 1",
)
def warned(spark, sf):
    return headers.warning_counts(_headers(spark, sf))


@query("confidence_histogram", f"{{tt}} SELECT confidence, count(*) AS n_docs FROM ({_HEADERS}) GROUP BY 1")
def histogram(spark, sf):
    return headers.confidence_histogram(_headers(spark, sf))


# -- 2.5 line items --------------------------------------------------------------------


@query(
    "items_from_text",
    """{it} SELECT CAST(k AS VARCHAR) AS doc_id, CASE WHEN k % 19 = 0 THEN 4 ELSE 2 END + 3 * i AS line_no, name AS raw_name,
    qty AS quantity, CAST(price_d AS DECIMAL(12,2)) AS unit_price, amount AS line_total,
    CAST(0.85 AS DECIMAL(5,2)) AS confidence, FALSE AS needs_review FROM it""",
)
def text_items(spark, sf):
    return items_text.items_from_text(text_invoices(spark, sf)).drop("unit")


@query(
    "group_rows_by_y",
    """{it}{tt} SELECT CAST(k AS VARCHAR) AS doc_id, CAST(4 * i + c AS INTEGER) AS line_no, 110.0::DOUBLE + 30 * i AS row_y
    FROM it, range(4) AS g(c) UNION ALL SELECT CAST(k AS VARCHAR), CAST(c AS INTEGER), 110.0 FROM tt, range(4) AS g(c) WHERE k % 6 <> 0""",
)
def rows_by_y(spark, sf):
    return items_layout.group_rows_by_y(positioned_invoices(spark, sf)).select("doc_id", "line_no", "row_y")


@query(
    "group_rows_by_y_with_unboxed_lines",
    """{it}{te} SELECT CAST(k AS VARCHAR) AS doc_id, CAST(4 * i + c AS INTEGER) AS line_no, CASE WHEN i % 3 <> 0 THEN 110.0::DOUBLE + 30 * i END AS row_y
    FROM it, range(4) AS g(c) UNION ALL SELECT CAST(k AS VARCHAR), CAST(c AS INTEGER), NULL FROM tt, range(4) AS g(c) WHERE k % 6 <> 0""",
)
def rows_with_unboxed_lines(spark, sf):
    """Cells of titles and of every third item have no box."""
    cells, boxed = positioned_invoices(spark, sf, every=True), F.floor(F.col("line_no") / 4) % 3 != 0
    for c in ("x1", "y1", "x2", "y2"):
        cells = cells.withColumn(c, F.when(boxed, F.col(c)))
    return items_layout.group_rows_by_y(cells).select("doc_id", "line_no", "row_y")


_TEXT_FIRST = """
SELECT 't' || CAST(k AS VARCHAR) AS doc_id, name AS raw_name, qty AS quantity, CAST(price_d AS DECIMAL(12,2)) AS unit_price, amount AS line_total,
  CAST(0.85 AS DECIMAL(5,2)) AS confidence FROM it
UNION ALL SELECT 'g' || CAST(k AS VARCHAR), name, qty, CAST(price_d AS DECIMAL(12,2)), amount, CAST(0.95 AS DECIMAL(5,2)) FROM it
"""


@query("extract_line_items_text_first", f"{{it}} {_TEXT_FIRST}")
def items_text_first(spark, sf):
    """Invoices as text, and as table rows of one wide cell each, whose columns are gaps and which no text rule reads."""
    lines = stage(_text_and_wide_rows(spark, sf), "text-and-rows")  # read by the probe and by both ways
    return items_layout.extract_line_items(lines, "text_first").select(
        "doc_id", "raw_name", "quantity", "unit_price", "line_total", "confidence"
    )


@query(
    "detect_table_rows",
    """{it} SELECT CAST(k AS VARCHAR) AS doc_id, 110.0::DOUBLE + 30 * i AS row_y, CAST(4 AS BIGINT) AS n_cells, name AS first_text,
    CAST(q AS DECIMAL(20,2)) AS n1, CAST(price_d AS DECIMAL(20,2)) AS n2, CAST(amount AS DECIMAL(20,2)) AS n3 FROM it WHERE k % 6 <> 0""",
)
def table_rows(spark, sf):
    rows = items_layout.table_rows(positioned_invoices(spark, sf))
    return items_layout.detect_table_rows(rows).select("doc_id", "row_y", "n_cells", "first_text", "n1", "n2", "n3")


_LAYOUT = """
SELECT CAST(k AS VARCHAR) AS doc_id, name AS raw_name, CAST(q AS DECIMAL(20,2)) AS quantity,
  CAST(price_d AS DECIMAL(20,2)) AS unit_price, CAST(amount AS DECIMAL(20,2)) AS line_total, i % 4 = 0 AS needs_review
FROM it
"""


@query("parse_row_cells", f"{{it}} {_LAYOUT} WHERE k % 6 <> 0")
def row_cells(spark, sf):
    rows = items_layout.detect_table_rows(items_layout.table_rows(positioned_invoices(spark, sf)))
    return items_layout.parse_row_cells(rows, True).select(
        "doc_id", "raw_name", "quantity", "unit_price", "line_total", "needs_review"
    )


def _text_and_wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    at = lambda df, kind: df.withColumn("doc_id", F.concat(F.lit(kind), "doc_id"))
    texts = text_invoices(spark, sf).select(
        "doc_id", "page_no", "line_no", "text", F.lit(0.9).alias("confidence"),
        F.lit(50.0).alias("x1"), (F.col("line_no") * 30.0).alias("y1"), F.lit(500.0).alias("x2"), (F.col("line_no") * 30.0 + 20).alias("y2"),
    )
    wide = order_items(spark, sf).withColumn("price", F.round(F.col("amount") / F.col("qty"), 2).cast("decimal(12,2)").cast("string"))
    row = F.concat_ws("   ", "name", F.col("qty").cast("int").cast("string"), "price", F.col("amount").cast("string"))
    rows = wide.select(F.col("order_key").cast("string").alias("doc_id"), F.col("item_no").alias("line_no"), row.alias("text"))
    heads = wide.select(F.col("order_key").cast("string").alias("doc_id")).distinct().select(
        "doc_id", F.lit(0).alias("line_no"), F.lit("الوصف   الكمية   سعر الوحدة   الإجمالي").alias("text")
    )
    gaps = heads.unionByName(rows).select(
        "doc_id", F.lit(1).alias("page_no"), "line_no", "text", F.lit(0.95).alias("confidence"),
        F.lit(50.0).alias("x1"), (F.col("line_no") * 30.0).alias("y1"), F.lit(500.0).alias("x2"), (F.col("line_no") * 30.0 + 20).alias("y2"),
    )
    return at(texts, "t").unionByName(at(gaps, "g"))


@query("items_from_layout", f"{{it}} {_LAYOUT}")
def layout_items(spark, sf):
    return items_layout.items_from_layout(positioned_invoices(spark, sf)).select(
        "doc_id", "raw_name", "quantity", "unit_price", "line_total", "needs_review"
    )


@query(
    "extract_line_items",
    """{it} SELECT d || CAST(k AS VARCHAR) AS doc_id, name AS raw_name, qty AS quantity, CAST(price_d AS DECIMAL(12,2)) AS unit_price,
    amount AS line_total, CAST(CASE WHEN d = 't' THEN 0.85 WHEN i % 4 = 0 THEN 0.70 ELSE 0.95 END AS DECIMAL(5,2)) AS confidence
    FROM it, (VALUES ('t'), ('p')) AS v(d)""",
)
def all_items(spark, sf):
    texts = text_invoices(spark, sf).select(
        F.concat(F.lit("t"), "doc_id").alias("doc_id"), "page_no", "line_no", "text", F.lit(0.9).alias("confidence"),
        F.lit(50.0).alias("x1"), (F.col("line_no") * 30.0).alias("y1"), F.lit(500.0).alias("x2"), (F.col("line_no") * 30.0 + 20).alias("y2"),
    )
    cells = positioned_invoices(spark, sf).withColumn("doc_id", F.concat(F.lit("p"), "doc_id"))
    items = items_layout.extract_line_items(texts.unionByName(cells), "geometry_first")
    return items.select("doc_id", "raw_name", "quantity", "unit_price", "line_total", "confidence")


# -- 2.6 validation --------------------------------------------------------------------


def _ex(spark, sf):
    return D.extractions(spark, sf), D.extraction_lines(spark, sf)


@query(
    "header_checks",
    "{tt}{ex}{dup} SELECT extraction_id, no_number, no_date, no_total, vat_malformed, vat_missing, total_off FROM fl",
)
def checks(spark, sf):
    return validate.header_checks(D.extractions(spark, sf)).select(
        "extraction_id", "no_number", "no_date", "no_total", "vat_malformed", "vat_missing", "total_off"
    )


@query(
    "line_stats",
    """{it}{el}{ls} SELECT le AS extraction_id, CAST(items_sum AS DECIMAL(22,2)) AS items_sum, n_mismatch, n_unmapped FROM ls""",
)
def lines_checked(spark, sf):
    return validate.line_stats(D.extraction_lines(spark, sf)).drop("n_lines")


@query("flag_duplicates", "{tt}{ex}{dup} SELECT extraction_id, is_duplicate FROM fl")
def duplicates(spark, sf):
    return validate.flag_duplicates(D.extractions(spark, sf)).select("extraction_id", "is_duplicate")


@query("flag_late_duplicates", "{tt}{ex}{dup} SELECT extraction_id, is_late AS is_duplicate FROM fl")
def late_duplicates(spark, sf):
    return validate.flag_duplicates(D.extractions(spark, sf), "arrival").select("extraction_id", "is_duplicate")


_VERDICT = """
SELECT extraction_id, upload_id, supplier_vat_number, n_errors, n_warnings, n_errors = 0 AS is_valid,
  n_errors > 0 OR n_warnings > 0 AS needs_review,
  CAST(CASE WHEN n_errors > 0 THEN 0.3 WHEN n_warnings > 0 THEN 0.7 ELSE 1 END AS DECIMAL(5,2)) AS confidence,
  CASE WHEN n_errors > 0 OR n_warnings > 0 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status FROM vd
"""


@query("validate_invoices", "{it}{tt}{ex}{el}{dup}{ls}" + _VERDICT)
def verdicts(spark, sf):
    return validate.validate_invoices(*_ex(spark, sf))


@query("route_status", f"{{it}}{{tt}}{{ex}}{{el}}{{dup}}{{ls}} SELECT status, count(*) AS n FROM ({_VERDICT}) GROUP BY 1")
def routed(spark, sf):
    return validate.route_status(validate.validate_invoices(*_ex(spark, sf))).groupBy("status").agg(F.count("*").alias("n"))


_MESSAGES = """
SELECT extraction_id, 'error' AS severity, 'number' AS kind, CAST(NULL AS INTEGER) AS line_no, 'Invoice number is required' AS message FROM fl WHERE no_number
UNION ALL SELECT extraction_id, 'error', 'date', NULL, 'Invoice date is required' FROM fl WHERE no_date
UNION ALL SELECT extraction_id, 'error', 'total', NULL, 'Total amount is required' FROM fl WHERE no_total
UNION ALL SELECT extraction_id, 'warning', 'vat_format', NULL, 'Supplier VAT number should be 15 digits' FROM fl WHERE vat_malformed
UNION ALL SELECT extraction_id, 'warning', 'vat_missing', NULL, 'VAT number required for Saudi invoices' FROM fl WHERE vat_missing
UNION ALL SELECT extraction_id, 'warning', 'total_mismatch', NULL, 'Total mismatch: subtotal(' || subtotal || ') + VAT(' || vat_amount || ') = ' || (subtotal + vat_amount) || ' but total is ' || total FROM fl WHERE total_off
UNION ALL SELECT extraction_id, 'warning', 'items_mismatch', NULL, 'Items sum(' || items_sum || ') ≠ subtotal(' || subtotal || ')' FROM fl JOIN ls ON le = extraction_id WHERE abs(items_sum - subtotal) > 0.1
UNION ALL SELECT extraction_id, 'error', 'duplicate', NULL, 'Duplicate invoice detected: ' || supplier_vat_number || ' / ' || invoice_number FROM fl WHERE is_duplicate
UNION ALL SELECT extraction_id, 'warning', 'unmapped', NULL, n_unmapped || ' line item(s) have no product mapping' FROM fl JOIN ls ON le = extraction_id WHERE n_unmapped > 0
UNION ALL SELECT extraction_id, 'warning', 'line_mismatch', line_no, 'Line item "' || raw_name || '" total mismatch' FROM el WHERE abs(quantity * unit_price - line_total) > 0.1
"""


@query("validation_messages", "{it}{tt}{ex}{el}{dup}{ls}" + _MESSAGES)
def messages(spark, sf):
    return validate.validation_messages(*_ex(spark, sf))


@query(
    "validation_summary",
    f"""{{it}}{{tt}}{{ex}}{{el}}{{dup}}{{ls}} SELECT severity, kind, CAST(count(*) AS BIGINT) AS n_messages, count(DISTINCT extraction_id) AS n_extractions
    FROM ({_MESSAGES}) GROUP BY 1, 2""",
)
def summary(spark, sf):
    return validate.validation_summary(validate.validation_messages(*_ex(spark, sf)))


@query(
    "verdict_summary",
    f"""{{it}}{{tt}}{{ex}}{{el}}{{dup}}{{ls}} SELECT supplier_vat_number, count(*) AS n_extractions, round(avg(is_valid::INT), 6) AS valid_rate,
    round(avg(needs_review::INT), 6) AS review_rate FROM ({_VERDICT}) GROUP BY ROLLUP (1)""",
)
def verdict_rates(spark, sf):
    return validate.verdict_summary(validate.validate_invoices(*_ex(spark, sf)), "supplier_vat_number")


@query(
    "approval_gate",
    """{tt}{ex}{dup} SELECT extraction_id, nullif(concat_ws('; ', CASE WHEN no_number THEN 'Invoice number is required' END,
    CASE WHEN no_date THEN 'Invoice date is required' END, CASE WHEN no_total THEN 'Total amount is required' END,
    CASE WHEN total_off THEN 'Total mismatch' END, CASE WHEN is_duplicate THEN 'Duplicate invoice' END), '') AS errors FROM fl""",
)
def gate(spark, sf):
    return validate.approval_gate(D.extractions(spark, sf))


@query(
    "approval_gate_messages",
    """{te}{ex}{dup} SELECT extraction_id, nullif(concat_ws('; ', CASE WHEN no_number THEN 'Invoice number is required' END,
    CASE WHEN no_date THEN 'Invoice date is required' END, CASE WHEN no_total THEN 'Total amount is required' END,
    CASE WHEN total_off THEN 'Total mismatch: ' || subtotal || ' + ' || vat_amount || ' = ' || (subtotal + vat_amount) || ', not ' || total END,
    CASE WHEN is_duplicate THEN 'Duplicate invoice: ' || supplier_vat_number || ' / ' || invoice_number END), '') AS errors FROM fl""",
)
def gate_messages(spark, sf):
    return validate.approval_gate(D.extractions(spark, sf, every=True), detailed=True)


@query("posting_gate", "{it}{tt}{pi}{pl} SELECT * FROM pg")
def post_gate(spark, sf):
    return validate.posting_gate(D.purchase_lines(spark, sf))


@query(
    "extract_and_validate",
    """{it}{tt} SELECT 'ex-' || k AS extraction_id, (k % 7 = 0)::BIGINT AS n_errors,
    CAST((k % 13 = 0)::INT + (k % 11 = 0)::INT + 1 + coalesce(m, 0) AS BIGINT) AS n_warnings, 'NEEDS_REVIEW' AS status
    FROM tt LEFT JOIN (SELECT k AS mk, count(*) AS m FROM it WHERE abs(qty * CAST(price_d AS DECIMAL(12,2)) - amount) > 0.1 GROUP BY 1) ON mk = k""",
)
def end_to_end(spark, sf):
    lines = text_invoices(spark, sf)
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    return pipeline.extract_and_validate(lines, stamp).select("extraction_id", "n_errors", "n_warnings", "status")


_MAPPED_VERDICTS = """{it}{te}, sg AS (
      SELECT DISTINCT name FROM it WHERE list_sort(list_distinct(string_split(lower(name), ' '))) IN (
        SELECT list_sort(list_distinct(string_split(n, ' '))) FROM (SELECT lower(p_name) AS n, min(p_partkey) AS pk FROM part GROUP BY 1) WHERE pk % 10 <> 0)),
    sl AS (
      SELECT k AS mk, count(*) FILTER (abs(qty * CAST(price_d AS DECIMAL(12,2)) - amount) > 0.1) AS m, count(*) FILTER (name NOT IN (SELECT name FROM sg)) AS u
      FROM it GROUP BY 1),
    c AS (
      SELECT k, CAST(CASE WHEN n = 0 AND k % 2 = 0 THEN 3 ELSE (k % 7 = 0)::INT + (t = 0)::INT END AS BIGINT) AS n_errors,
             CAST((k % 13 = 0 OR (n = 0 AND k % 2 = 0))::INT + (n > 0 AND k % 11 = 0)::INT + coalesce(m, 0) + (coalesce(u, 0) > 0)::INT AS BIGINT) AS n_warnings
      FROM tt LEFT JOIN sl ON mk = k)
    SELECT 'ex-' || k AS extraction_id, n_errors, n_warnings, CASE WHEN n_errors + n_warnings = 0 THEN 'READY' ELSE 'NEEDS_REVIEW' END AS status FROM c"""


@query("extract_and_validate_every_order", _MAPPED_VERDICTS)
def end_to_end_of_every_order(spark, sf):
    lines = text_invoices(spark, sf, every=True)
    sheets = table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("doc_id"))
    stamp = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    verdicts = pipeline.extract_and_validate(lines, stamp, documents=sheets, mappings=D.product_names(spark, sf))
    return verdicts.select("extraction_id", "n_errors", "n_warnings", "status")


@query("validate_every_order", "{it}{te}{ex}{el}{dup}{ls}" + _VERDICT)
def verdicts_of_every_order(spark, sf):
    return validate.validate_invoices(D.extractions(spark, sf, every=True), D.extraction_lines(spark, sf))


@query("validation_messages_every_order", "{it}{te}{ex}{el}{dup}{ls}" + _MESSAGES)
def messages_of_every_order(spark, sf):
    return validate.validation_messages(D.extractions(spark, sf, every=True), D.extraction_lines(spark, sf))


# -- 2.7 mapping -----------------------------------------------------------------------


def _names(spark, sf):
    return (
        D.name_lines(spark, sf)
        .select(mapping.normalized_name("raw_name").alias("name"), F.lit(None).cast("string").alias("supplier_id"))
        .distinct()
    )


@query("map_exact", "{nl} SELECT DISTINCT name, mapping_id, product_id FROM nl JOIN ma ON name = normalized_name")
def exact(spark, sf):
    return mapping.map_exact(_names(spark, sf), D.mappings(spark, sf)).drop("supplier_id")


@query("map_fuzzy", "{nl}{fz} SELECT name, mapping_id, product_id, score FROM fz")
def fuzzy(spark, sf):
    return mapping.map_fuzzy(_names(spark, sf), D.mappings(spark, sf)).drop("supplier_id")


@query("suggest_mappings", "{nl}{fz} SELECT line_id, mapping_id, product_id, score, method FROM nl JOIN sg USING (name)")
def suggestions(spark, sf):
    return mapping.suggest_mappings(D.name_lines(spark, sf), D.mappings(spark, sf))


_BEST = """
SELECT line_id, quantity, b.mapping_id AS suggested_mapping_id, b.product_id AS suggested_product_id FROM nl LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, mapping_id) AS r FROM sg) WHERE r = 1) b USING (name)
"""


@query("fill_suggestions", f"{{nl}}{{fz}} SELECT line_id, suggested_mapping_id, suggested_product_id FROM ({_BEST})")
def filled_lines(spark, sf):
    return mapping.fill_suggestions(D.name_lines(spark, sf), D.mappings(spark, sf)).select(
        "line_id", "suggested_mapping_id", "suggested_product_id"
    )


@query(
    "normalize_quantities",
    f"""{{nl}}{{fz}} SELECT line_id, CASE WHEN suggested_mapping_id IS NULL THEN 'box' ELSE 'kg' END AS base_unit,
    CAST(quantity * CASE WHEN suggested_mapping_id IS NULL THEN 1 ELSE 5 END AS DECIMAL(18,3)) AS base_quantity FROM ({_BEST})""",
)
def base_quantities(spark, sf):
    lines = mapping.fill_suggestions(D.name_lines(spark, sf), D.mappings(spark, sf))
    return mapping.normalize_quantities(lines, D.mappings(spark, sf)).select("line_id", "base_unit", "base_quantity")


@query(
    "upsert_mappings",
    """{nl}, sv AS (SELECT lower(p_name || ' ' || p_type) AS n, 'new-' || arg_max(p_partkey, p_partkey) AS product_id FROM part WHERE p_size > 0 GROUP BY 1
    UNION ALL SELECT lower(p_name || ' ' || p_name || ' ' || p_type), 'new-' || max(p_partkey) FROM part GROUP BY 1)
    SELECT coalesce(normalized_name, n) AS normalized_name, coalesce(sv.product_id, ma.product_id) AS product_id,
    'kg' AS target_unit, CAST(CASE WHEN n IS NULL THEN 5 ELSE 12 END AS DECIMAL(12,4)) AS conversion_factor,
    CAST(CASE WHEN n IS NULL THEN 0.9 ELSE 1 END AS DECIMAL(5,2)) AS confidence
    FROM ma FULL JOIN sv ON normalized_name = n""",
)
def upserted(spark, sf):
    part = table(spark, sf, "part")
    seconds = F.timestamp_seconds(F.col("p_partkey") + 1600000000)

    def saves(name):
        return part.select(
            name.alias("raw_name"),
            F.lit(None).cast("string").alias("supplier_id"),
            F.concat(F.lit("new-"), F.col("p_partkey").cast("string")).alias("product_id"),
            F.lit("Carton").alias("source_unit"),
            F.lit(None).cast("string").alias("target_unit"),
            seconds.alias("updated_at"),
        )

    given = saves(F.concat_ws("  ", "p_name", F.upper("p_type"))).unionByName(
        saves(F.concat_ws(" ", "p_name", "p_name", "p_type"))
    )
    return mapping.upsert_mappings(D.mappings(spark, sf), given).select(
        "normalized_name", "product_id", "target_unit", "conversion_factor", "confidence"
    )


@query(
    "upsert_keeps_raw_names",
    """{nl}, sv AS (SELECT lower(p_name || ' ' || p_type) AS n, max(p_name || '  ' || upper(p_type)) AS raw FROM part GROUP BY 1
    UNION ALL SELECT lower(p_name || ' ' || p_name), max(p_name || ' ' || p_name) FROM part GROUP BY 1)
    SELECT coalesce(normalized_name, n) AS normalized_name, CASE WHEN normalized_name IS NULL THEN raw ELSE 'first ' || normalized_name END AS raw_vendor_item_name
    FROM ma FULL JOIN sv ON normalized_name = n""",
)
def raw_names_kept(spark, sf):
    names = table(spark, sf, "part").select(
        F.explode(F.array(F.concat_ws("  ", "p_name", F.upper("p_type")), F.concat_ws(" ", "p_name", "p_name"))).alias("raw_name")
    ).distinct()
    no = F.lit(None).cast("string")
    saves = names.select(
        "raw_name", no.alias("supplier_id"), F.lit("new").alias("product_id"), F.lit("Carton").alias("source_unit"), no.alias("target_unit"),
        F.to_timestamp(F.lit("2024-01-01 00:00:00")).alias("updated_at"),
    )
    known = D.mappings(spark, sf).withColumn("raw_vendor_item_name", F.concat(F.lit("first "), "normalized_name"))
    return mapping.upsert_mappings(known, saves).select("normalized_name", "raw_vendor_item_name")


@query(
    "convert_units",
    """{it}{el} SELECT line_id, CASE unit WHEN 'Box' THEN 'kg' WHEN 'pcs' THEN 'piece' WHEN 'كرتون' THEN 'kg' END AS target_unit,
    CAST(CASE unit WHEN 'Box' THEN 5 WHEN 'pcs' THEN 1 WHEN 'كرتون' THEN 12 END AS DECIMAL(12,4)) AS conversion_factor FROM el""",
)
def units(spark, sf):
    return mapping.convert_units(D.extraction_lines(spark, sf)).select("line_id", "target_unit", "conversion_factor")


@query(
    "apply_line_mapping",
    """{it}{el} SELECT line_id, CASE WHEN product_id IS NULL AND line_no = 1 THEN 'chosen' ELSE product_id END AS product_id FROM el""",
)
def chosen_products(spark, sf):
    lines = D.extraction_lines(spark, sf)
    chosen = lines.where("product_id is null and line_no = 1").select("line_id", F.lit("chosen").alias("product_id"))
    return mapping.apply_line_mapping(lines, chosen).select("line_id", "product_id")


# -- 2.8 review, approval, posting -----------------------------------------------------


@query("latest_extraction", "{tt}{ex}{lx} SELECT extraction_id, upload_id, created_at FROM lx")
def latest(spark, sf):
    return review.latest_extraction(D.extractions(spark, sf)).select("extraction_id", "upload_id", "created_at")


@query(
    "review_view",
    """{it}{tt}{ex}{el}{dup}{ls}{lx}{ul} SELECT lx.extraction_id, upload_id, ul.status AS upload_status, n_errors, n_warnings, line_no, raw_name, line_total
    FROM lx JOIN ul USING (upload_id) JOIN vd USING (extraction_id, upload_id) LEFT JOIN el USING (extraction_id)""",
)
def view(spark, sf):
    return review.review_view(D.uploads(spark, sf), *_ex(spark, sf)).select(
        "extraction_id", "upload_id", "upload_status", "n_errors", "n_warnings", "line_no", "raw_name", "line_total"
    )


@query(
    "apply_header_patch",
    """{tt}{ex}{ul} SELECT extraction_id, CASE WHEN hit THEN '7' ELSE invoice_number END AS invoice_number,
    CASE WHEN hit THEN NULL ELSE supplier_name END AS supplier_name,
    CASE WHEN hit THEN 12.50 ELSE total END AS total, subtotal
    FROM (SELECT ex.*, ul.status = 'OCR_FAILED' AND row_number() OVER (PARTITION BY upload_id ORDER BY ex.created_at DESC, extraction_id) = 1 AS hit
          FROM ex JOIN ul USING (upload_id))""",
)
def header_patched(spark, sf):
    # three patches one after the other: a name set and cleared again, a total, a number
    text = lambda v: F.lit(v).cast("string")
    steps = F.array(
        F.create_map(text("supplier_name"), text("x"), text("total"), text("1")),
        F.create_map(text("supplier_name"), text(None), text("total"), text("12.5")),
        F.create_map(text("invoice_number"), text("7")),
    )
    patch = D.uploads(spark, sf).where(F.col("status") == "OCR_FAILED").select(
        "upload_id", "created_at", F.posexplode(steps).alias("n", "fields")
    ).select("upload_id", "fields", (F.col("created_at") + F.make_dt_interval(mins="n")).alias("patched_at"))
    return review.apply_header_patch(D.extractions(spark, sf), patch).select(
        "extraction_id", "invoice_number", "supplier_name", "total", "subtotal"
    )


@query(
    "apply_line_patch",
    """{it}{el} SELECT line_id, CASE WHEN product_id IS NULL THEN 'p-new' ELSE product_id END AS product_id,
    CASE WHEN product_id IS NULL THEN CAST(2.5 AS DECIMAL(12,3)) ELSE quantity END AS quantity, line_total FROM el""",
)
def line_patched(spark, sf):
    lines = D.extraction_lines(spark, sf)
    patch = lines.where("product_id is null").select(
        "line_id",
        F.create_map(F.lit("product_id"), F.lit("p-new"), F.lit("quantity"), F.lit("2.5")).alias("fields"),
        F.current_timestamp().alias("patched_at"),
    )
    return review.apply_line_patch(lines, patch).select("line_id", "product_id", "quantity", "line_total")


def _decisions(spark, sf):
    return review.approval_decisions(D.extractions(spark, sf), D.uploads(spark, sf), D.approved_uploads(spark, sf))


@query("approval_decisions", "{tt}{ex}{dup}{lx}{ul}{ad} SELECT extraction_id, upload_id, reject_reason FROM ad")
def decisions(spark, sf):
    return _decisions(spark, sf).select("extraction_id", "upload_id", "reject_reason")


@query(
    "approve_batch",
    """{tt}{ex}{dup}{lx}{ul}{ad} SELECT 'pi-' || upload_id AS purchase_invoice_id, upload_id, invoice_number, invoice_date, total, 'APPROVED' AS status
    FROM ad WHERE reject_reason IS NULL""",
)
def approved(spark, sf):
    return review.approve_batch(_decisions(spark, sf)).select(
        "purchase_invoice_id", "upload_id", "invoice_number", "invoice_date", "total", "status"
    )


@query(
    "approve_lines",
    """{it}{tt}{ex}{el}{dup}{lx}{ul}{ad} SELECT 'pi-' || upload_id AS purchase_invoice_id, line_id, product_id, quantity, unit_price, line_total
    FROM ad JOIN el USING (extraction_id) WHERE reject_reason IS NULL AND product_id IS NOT NULL""",
)
def approved_lines(spark, sf):
    pi = review.approve_batch(_decisions(spark, sf))
    return review.approve_lines(pi, D.extraction_lines(spark, sf)).drop("raw_name", "unit")


@query(
    "dropped_lines",
    """{it}{tt}{ex}{el}{dup}{lx}{ul}{ad} SELECT 'pi-' || upload_id AS purchase_invoice_id, count(*) AS n_dropped
    FROM ad JOIN el USING (extraction_id) WHERE reject_reason IS NULL AND product_id IS NULL GROUP BY 1""",
)
def lines_dropped(spark, sf):
    return review.dropped_lines(review.approve_batch(_decisions(spark, sf)), D.extraction_lines(spark, sf))


@query(
    "reject_batch",
    """{tt}{ex}{lx}{ul} SELECT 'invoice_extraction' AS entity_type, extraction_id AS entity_id, 'REJECTED' AS action,
    '{"reason":"' || ul.status || '"}' AS new_value FROM lx JOIN ul USING (upload_id)""",
)
def rejected(spark, sf):
    rejections = D.uploads(spark, sf).select("upload_id", F.col("status").alias("reason"))
    return review.reject_batch(D.extractions(spark, sf), rejections).drop("user_id")


@query(
    "post_inventory",
    "{it}{tt}{pi}{pl} SELECT purchase_invoice_id, product_id, 'IN' AS movement_type, quantity, unit_cost, total_cost FROM mv",
)
def inventory(spark, sf):
    return posting.post_inventory(D.purchase_invoices(spark, sf), D.purchase_lines(spark, sf)).select(
        "purchase_invoice_id", "product_id", "movement_type", "quantity", "unit_cost", "total_cost"
    )


@query(
    "inventory_rejects",
    """{it}{tt}{pi}{pl} SELECT purchase_invoice_id, concat_ws('; ', CASE WHEN n_unmapped > 0 THEN n_unmapped || ' line(s) have no product mapping' END,
    CASE WHEN n_bad_quantity > 0 THEN n_bad_quantity || ' line(s) have invalid quantity' END,
    CASE WHEN n_bad_total > 0 THEN n_bad_total || ' line(s) have invalid line total' END) AS reason
    FROM pg WHERE n_unmapped + n_bad_quantity + n_bad_total > 0""",
)
def inventory_refused(spark, sf):
    return posting.inventory_rejects(D.purchase_invoices(spark, sf), D.purchase_lines(spark, sf))


@query("post_accounting", "{tt}{pi}{je} SELECT * FROM je")
def accounting(spark, sf):
    return posting.post_accounting(D.purchase_invoices(spark, sf))


@query(
    "accounting_rejects",
    """{tt}{pi} SELECT purchase_invoice_id, CASE WHEN invoice_date IS NULL THEN 'Invoice date is required for accounting posting'
    WHEN invoice_number IS NULL THEN 'Invoice number is required for accounting posting'
    ELSE 'Invalid total for accounting posting' END AS reason
    FROM pi WHERE invoice_date IS NULL OR invoice_number IS NULL OR NOT total > 0""",
)
def accounting_refused(spark, sf):
    return posting.accounting_rejects(D.purchase_invoices(spark, sf))


@query("not_yet_posted", "{it}{tt}{pi}{pl} SELECT purchase_invoice_id, total FROM pi WHERE purchase_invoice_id NOT IN (SELECT purchase_invoice_id FROM mv)")
def unposted(spark, sf):
    pi = D.purchase_invoices(spark, sf)
    posted = posting.post_inventory(pi, D.purchase_lines(spark, sf))
    return posting.not_yet_posted(pi, posted).select("purchase_invoice_id", "total")


@query("approval_decisions_every_order", "{te}{ex}{dup}{lx}{ul}{ad} SELECT extraction_id, upload_id, reject_reason FROM ad")
def decisions_on_every_order(spark, sf):
    extractions = D.extractions(spark, sf, every=True)
    found = review.approval_decisions(extractions, D.uploads(spark, sf), D.approved_uploads(spark, sf))
    return found.select("extraction_id", "upload_id", "reject_reason")


@query("post_accounting_every_order", "{te}{pi}{je} SELECT * FROM je")
def accounting_of_every_order(spark, sf):
    return posting.post_accounting(D.purchase_invoices(spark, sf, every=True))


@query(
    "inventory_rejects_every_order",
    """{it}{te}{pi}{pl} SELECT pi.purchase_invoice_id, CASE WHEN n_lines IS NULL THEN 'No lines to post to inventory' ELSE concat_ws('; ',
    CASE WHEN n_unmapped > 0 THEN n_unmapped || ' line(s) have no product mapping' END,
    CASE WHEN n_bad_quantity > 0 THEN n_bad_quantity || ' line(s) have invalid quantity' END,
    CASE WHEN n_bad_total > 0 THEN n_bad_total || ' line(s) have invalid line total' END) END AS reason
    FROM pi LEFT JOIN pg USING (purchase_invoice_id) WHERE n_lines IS NULL OR n_unmapped + n_bad_quantity + n_bad_total > 0""",
)
def inventory_refused_of_every_order(spark, sf):
    return posting.inventory_rejects(D.purchase_invoices(spark, sf, every=True), D.purchase_lines(spark, sf))


def _posted(spark: SparkSession, sf: str) -> Ledger:
    """All invoices posted in three batches: some, then all, then all once more."""
    ledger = Ledger(jobs.work_folder(spark, "ledger"), 16)
    invoices = D.purchase_invoices(spark, sf, every=True).withColumn("upload_id", F.concat(F.lit("up-"), "purchase_invoice_id"))
    lines, at = D.purchase_lines(spark, sf), F.to_timestamp(F.lit("2024-03-01 00:00:00"))
    early = F.pmod(F.xxhash64("purchase_invoice_id"), F.lit(2)) == 0
    for batch, some in enumerate([invoices.where(early), invoices, invoices]):
        ledger.post(some, lines, batch, at)
    return ledger


_POST_AUDIT = """
SELECT purchase_invoice_id AS entity_id, 'POSTED_TO_INVENTORY' AS action, '{"movementsCreated":' || count(*) || '}' AS new_value FROM mv GROUP BY 1
UNION ALL SELECT purchase_invoice_id, 'POSTED_TO_ACCOUNTING', '{"journalEntryId":"' || journal_entry_id || '"}' FROM je WHERE entry_line = 1
"""


@query(
    "post_once",
    f"""{{it}}{{te}}{{pi}}{{pl}}{{je}}, au AS ({_POST_AUDIT}),
    lt AS (SELECT 'up-' || entity_id AS upload_id, max(action) FILTER (action = 'POSTED_TO_INVENTORY') AS a, max(action) FILTER (action = 'POSTED_TO_ACCOUNTING') AS b FROM au GROUP BY 1)
    SELECT entity_id, action, new_value, coalesce(b, a) AS status, TIMESTAMP '2024-03-01' AS created_at FROM au JOIN lt ON upload_id = 'up-' || entity_id""",
)
def posted_once(spark, sf):
    ledger = _posted(spark, sf)
    latest = status.current_status(ledger.read(spark, "statuses")).select(F.substring("upload_id", 4, 1000).alias("entity_id"), "status")
    return ledger.read(spark, "audit").join(latest, "entity_id").select("entity_id", "action", "new_value", "status", "created_at")


@query(
    "posted_once_tables",
    """{it}{te}{pi}{pl}{je} SELECT purchase_invoice_id, sum(m) AS n_movements, sum(j) AS n_entry_lines, CAST(sum(c) AS DECIMAL(22,2)) AS cost, CAST(sum(d) AS DECIMAL(22,2)) AS debit
    FROM (SELECT purchase_invoice_id, 1 AS m, 0 AS j, total_cost AS c, 0 AS d FROM mv
          UNION ALL SELECT purchase_invoice_id, 0, 1, 0, CASE WHEN side = 'DR' THEN amount ELSE 0 END FROM je) GROUP BY 1""",
)
def posted_tables(spark, sf):
    ledger, no = _posted(spark, sf), F.lit(0).cast("decimal(12,2)")
    moved = ledger.read(spark, "movements").select("purchase_invoice_id", F.lit(1).alias("m"), F.lit(0).alias("j"), F.col("total_cost").alias("c"), no.alias("d"))
    entered = ledger.read(spark, "journal").select(
        "purchase_invoice_id", F.lit(0).alias("m"), F.lit(1).alias("j"), no.alias("c"), F.when(F.col("side") == "DR", F.col("amount")).otherwise(no).alias("d")
    )
    return moved.unionByName(entered).groupBy("purchase_invoice_id").agg(
        F.sum("m").alias("n_movements"), F.sum("j").alias("n_entry_lines"), F.sum("c").alias("cost"), F.sum("d").alias("debit")
    )


@query(
    "audit_append",
    """{tt}{pi} SELECT 'purchase_invoice' AS entity_type, purchase_invoice_id AS entity_id, 'APPROVED' AS action,
    '{' || CASE WHEN invoice_number IS NULL THEN '' ELSE '"invoice_number":"' || invoice_number || '",' END || '"total":' || total || '}' AS new_value FROM pi""",
)
def audited(spark, sf):
    return posting.audit_rows(
        D.purchase_invoices(spark, sf), "purchase_invoice", "purchase_invoice_id", "APPROVED", ["invoice_number", "total"]
    ).drop("user_id")


# -- 2.9 status, 2.10 monitoring and ledgers -------------------------------------------


@query("current_status", "{st} SELECT * FROM cs")
def statuses(spark, sf):
    return status.current_status(D.status_events(spark, sf))


@query("status_log", "{st} SELECT * FROM cs")
def logged_statuses(spark, sf):
    log, events = StatusLog(jobs.work_folder(spark, "status-log"), 16), D.status_events(spark, sf)
    for batch in range(3):  # the first two are compacted
        log.append(events.where(F.pmod(F.col("seq"), F.lit(3)) == batch), batch)
        if batch == 1:
            log.compact(spark)
    return log.current(spark)


@query(
    "status_of_reviewed_uploads",
    """{it}{te}{ex}{el}{dup}{ls}{lx}{ul}{ad}, ev AS (
      SELECT vd.upload_id, CASE WHEN n_errors > 0 OR n_warnings > 0 THEN 'NEEDS_REVIEW' ELSE 'READY' END AS status, created_at AS ts, k AS seq
      FROM vd JOIN ex USING (extraction_id)
      UNION ALL SELECT upload_id, 'APPROVED', TIMESTAMP '2030-01-01', 0 FROM ad WHERE reject_reason IS NULL)
    SELECT upload_id, arg_max(status, row(ts, seq)) AS status, max(ts) AS since, count(*) AS n_events FROM ev GROUP BY 1""",
)
def reviewed_statuses(spark, sf):
    log = StatusLog(jobs.work_folder(spark, "review-log"), 16)
    extractions, lines = D.extractions(spark, sf, every=True), D.extraction_lines(spark, sf)
    times = extractions.select("extraction_id", F.col("created_at").alias("ts"))
    verdicts = validate.validate_invoices(extractions, lines).join(times, "extraction_id")
    log.append(verdict_events(verdicts, F.col("ts"), F.substring("extraction_id", 4, 20)), 0)
    log.compact(spark)
    approved = review.approve_batch(review.approval_decisions(extractions, D.uploads(spark, sf), D.approved_uploads(spark, sf)))
    log.append(approval_events(approved, F.to_timestamp(F.lit("2030-01-01 00:00:00")), F.lit(0)), 1)
    return log.current(spark)


@query(
    "status_buckets",
    """{st} SELECT status, CASE WHEN status IN ('QUEUED', 'PROCESSING_OCR') THEN 'processing' WHEN status = 'OCR_FAILED' THEN 'failed' ELSE 'done' END AS bucket,
    status IN ('NEEDS_REVIEW', 'READY') AS reviewable, count(*) AS n_uploads FROM cs GROUP BY 1""",
)
def buckets(spark, sf):
    return status.status_buckets(status.current_status(D.status_events(spark, sf)))


@query("dedupe_jobs", "{st} SELECT upload_id, 'ocr:' || upload_id AS job_id, min(ts) AS queued_at FROM st GROUP BY 1")
def jobs_once(spark, sf):
    return status.dedupe_jobs(D.status_events(spark, sf))


@query(
    "failed_after_retries",
    "{st} SELECT upload_id, count(*) AS n_failed FROM st WHERE status = 'OCR_FAILED' GROUP BY 1 HAVING count(*) >= 3",
)
def exhausted(spark, sf):
    return status.failed_after_retries(D.status_events(spark, sf))


@query(
    "stuck_documents",
    """{st} SELECT upload_id, since, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(since)) AS BIGINT) AS age_seconds
    FROM cs WHERE status = 'PROCESSING_OCR' AND epoch(TIMESTAMP '2024-02-01') - floor(epoch(since)) > 120""",
)
def stuck(spark, sf):
    now = F.to_timestamp(F.lit("2024-02-01 00:00:00"))
    return status.stuck_documents(status.current_status(D.status_events(spark, sf)), now)


@query(
    "low_confidence_documents",
    """{it} SELECT CAST(k AS VARCHAR) AS doc_id, <even4:avg(q / 64.0::DOUBLE)> AS confidence FROM it GROUP BY 1 HAVING <even4:avg(q / 64.0::DOUBLE)> < 0.4""",
)
def low_confidence(spark, sf):
    summary = assemble.document_summary(_scored_lines(spark, sf))
    return assemble.low_confidence_documents(summary, 0.4).select("doc_id", "confidence")


@query(
    "ocr_timing_stats",
    """SELECT key, count(*) AS n, round(avg(ms), 4) AS mean_ms, min(ms) AS min_ms, quantile_disc(ms, 0.5) AS p50_ms, quantile_disc(ms, 0.95) AS p95_ms, max(ms) AS max_ms
    FROM (SELECT event_type || '_ms' AS key, value AS ms FROM events UNION ALL SELECT 'total_ms', value * 2 FROM events) GROUP BY 1""",
)
def timings(spark, sf):
    results = table(spark, sf, "events").select(
        F.create_map(
            F.concat("event_type", F.lit("_ms")), F.col("value"), F.lit("total_ms"), F.col("value") * 2
        ).alias("timings")
    )
    return rollups.ocr_timing_stats(results)


_HOURLY = "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' AS window_end"


@query("ocr_error_rate", f"{{st}} {_HOURLY}, error_code, count(*) AS n FROM st WHERE error_code IS NOT NULL GROUP BY ALL")
def error_rate(spark, sf):
    return rollups.ocr_error_rate(D.status_events(spark, sf))


@query(
    "ocr_error_rate_sliding",
    """{st} SELECT w AS window_start, w + INTERVAL '1 hour' AS window_end, error_code, count(*) AS n FROM (
    SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w, error_code
    FROM st WHERE error_code IS NOT NULL) GROUP BY ALL""",
)
def error_rate_sliding(spark, sf):
    return rollups.ocr_error_rate(D.status_events(spark, sf), "1 hour", "30 minutes")


@query("failed_job_count", f"{{st}} {_HOURLY}, count(*) AS n FROM st WHERE status = 'OCR_FAILED' GROUP BY ALL")
def failed_jobs(spark, sf):
    return rollups.failed_job_count(D.status_events(spark, sf))


@query(
    "trial_balance",
    """{tt}{pi}{je} SELECT account_code, entry_date, CAST(sum(CASE WHEN side = 'DR' THEN amount ELSE 0 END) AS DECIMAL(22,2)) AS dr,
    CAST(sum(CASE WHEN side = 'CR' THEN amount ELSE 0 END) AS DECIMAL(22,2)) AS cr, count(*) AS n_lines FROM je GROUP BY ROLLUP (1, 2)""",
)
def balance(spark, sf):
    return rollups.trial_balance(posting.post_accounting(D.purchase_invoices(spark, sf)), "entry_date").select(
        "account_code", "entry_date", F.col("dr").cast("decimal(22,2)").alias("dr"), F.col("cr").cast("decimal(22,2)").alias("cr"), "n_lines"
    )


@query("unbalanced_entries", "{tt}{pi}{je} SELECT journal_entry_id, CAST(sum(CASE side WHEN 'DR' THEN amount ELSE -amount END) AS DECIMAL(23,2)) AS difference FROM je GROUP BY 1 HAVING difference <> 0")
def unbalanced(spark, sf):
    return rollups.unbalanced_entries(posting.post_accounting(D.purchase_invoices(spark, sf)))


def _movements(spark, sf):
    return posting.post_inventory(D.purchase_invoices(spark, sf), D.purchase_lines(spark, sf))


@query(
    "stock_ledger",
    """{it}{tt}{pi}{pl} SELECT product_id, CAST(sum(quantity) AS DECIMAL(22,3)) AS quantity, CAST(sum(total_cost) AS DECIMAL(22,2)) AS cost,
    CAST((CAST(20000 * sum(total_cost) * 1000 AS HUGEINT) + CAST(sum(quantity) * 1000 AS HUGEINT)) // (2 * CAST(sum(quantity) * 1000 AS HUGEINT)) AS DECIMAL(22,0)) / 10000 AS mean_unit_cost,
    count(*) AS n_movements FROM mv GROUP BY 1""",
)
def ledger(spark, sf):
    return rollups.stock_ledger(_movements(spark, sf)).withColumn("mean_unit_cost", F.col("mean_unit_cost").cast("double"))


@query(
    "stock_balance",
    """{it}{tt}{pi}{pl} SELECT product_id, movement_date, quantity, cost,
    CAST(sum(quantity) OVER w AS DECIMAL(32,3)) AS balance, CAST(sum(cost) OVER w AS DECIMAL(32,2)) AS balance_cost FROM (
    SELECT product_id, invoice_date AS movement_date, CAST(sum(quantity) AS DECIMAL(22,3)) AS quantity, CAST(sum(total_cost) AS DECIMAL(22,2)) AS cost FROM mv GROUP BY 1, 2)
    WINDOW w AS (PARTITION BY product_id ORDER BY movement_date NULLS FIRST ROWS UNBOUNDED PRECEDING)""",
)
def running_stock(spark, sf):
    return rollups.stock_balance(_movements(spark, sf))


@query(
    "supplier_spend",
    """{tt}{pi} SELECT supplier_vat_number, CAST(date_trunc('month', invoice_date) AS DATE) AS month, CAST(sum(total) AS DECIMAL(22,2)) AS spend,
    CAST(sum(vat_amount) AS DECIMAL(22,2)) AS vat, count(*) AS n_invoices FROM pi GROUP BY ROLLUP (1, 2)""",
)
def spend(spark, sf):
    return rollups.supplier_spend(D.purchase_invoices(spark, sf))


# -- 2.12 streaming --------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return D.as_status_events(spark.readStream.schema(schema).parquet(f"{sf}/events.parquet*"))


@query("stream_status", "{st} SELECT * FROM cs")
def streamed_status(spark, sf):
    out, mark = jobs.work_folder(spark, "status"), jobs.work_folder(spark, "status-mark")
    jobs.stream_status(_event_stream(spark, sf), out, mark).awaitTermination()
    return jobs.read_status(spark, out)


@query("stream_error_rate", f"{{st}} {_HOURLY}, error_code, count(*) AS n FROM st WHERE error_code IS NOT NULL GROUP BY ALL")
def streamed_errors(spark, sf):
    out, mark = jobs.work_folder(spark, "errors"), jobs.work_folder(spark, "errors-mark")
    jobs.run_to_table(jobs.stream_error_rate(_event_stream(spark, sf)), out, mark, "update")
    return jobs.read_updates(spark, out, "window_start", "window_end", "error_code")


@query(
    "stream_error_rate_final",
    """{st}, b AS (SELECT ts, error_code, seq % 3 AS b FROM st WHERE error_code IS NOT NULL),
    m AS (SELECT max(ts) FILTER (b = 0) - INTERVAL '1 day' AS late, max(ts) - INTERVAL '1 day' AS reached FROM b),
    w AS (SELECT unnest([time_bucket(INTERVAL '30 minutes', ts), time_bucket(INTERVAL '30 minutes', ts) - INTERVAL '30 minutes']) AS w, error_code, b FROM b)
    SELECT w AS window_start, w + INTERVAL '1 hour' AS window_end, error_code, count(*) AS n FROM w, m
    WHERE (b < 2 OR w + INTERVAL '1 hour' > late) AND w + INTERVAL '1 hour' <= reached GROUP BY ALL""",
)
def streamed_errors_once_final(spark, sf):
    """Events in three micro-batches, sliding windows, each written once when the watermark has passed it.

    A batch drops windows that the watermark of the batch before it had passed, here those of the
    third that lie a day behind the first.
    """
    box, out, mark = (jobs.work_folder(spark, n) for n in ("event-box", "final-errors", "final-errors-mark"))
    events = table(spark, sf, "events")
    for n in range(3):
        events.where(F.col("event_id") % 3 == n).coalesce(1).write.parquet(f"{box}/part={n}")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{box}/part=*")
    jobs.run_to_table(jobs.stream_error_rate(D.as_status_events(stream), "1 hour", "30 minutes", "1 day"), out, mark)
    return spark.read.parquet(out).select("window_start", "window_end", "error_code", "n")


@query("stream_jobs", "{st} SELECT DISTINCT upload_id, 'ocr:' || upload_id AS job_id FROM st")
def streamed_jobs(spark, sf):
    out, mark = jobs.work_folder(spark, "jobs"), jobs.work_folder(spark, "jobs-mark")
    jobs.run_to_table(jobs.stream_jobs(_event_stream(spark, sf), "60 days"), out, mark)
    return spark.read.parquet(out).select("upload_id", "job_id")


@query(
    "stream_documents",
    """{it}{tt} SELECT 'ex-' || k AS extraction_id, (k % 7 = 0)::BIGINT AS n_errors,
    CAST((k % 13 = 0)::INT + (k % 11 = 0)::INT + 1 + coalesce(m, 0) AS BIGINT) AS n_warnings, 'NEEDS_REVIEW' AS status
    FROM tt LEFT JOIN (SELECT k AS mk, count(*) AS m FROM it WHERE abs(qty * CAST(price_d AS DECIMAL(12,2)) - amount) > 0.1 GROUP BY 1) ON mk = k""",
)
def streamed_documents(spark, sf):
    source, out, mark = (jobs.work_folder(spark, n) for n in ("inbox", "invoices", "invoices-mark"))
    _ocr_documents(spark, sf).write.options(**PACKED).json(source)
    jobs.stream_documents(spark, source, out, mark, "text_only").awaitTermination()
    return spark.read.parquet(f"{out}/verdicts").select("extraction_id", "n_errors", "n_warnings", "status")


@query("stream_documents_every_order", _MAPPED_VERDICTS)
def streamed_documents_of_every_order(spark, sf):
    """The main path as a stream: text first, then layout, suggestions on lines, in two runs of the same stream."""
    source, out, mark = (jobs.work_folder(spark, n) for n in ("inbox", "invoices", "invoices-mark"))
    docs, early = _ocr_documents(spark, sf, every=True), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    for some in (early, ~early):
        docs.where(some).write.mode("append").options(**PACKED).json(source)
        jobs.stream_documents(spark, source, out, mark, "text_first", D.product_names(spark, sf), split=False).awaitTermination()
    return spark.read.parquet(f"{out}/verdicts").select("extraction_id", "n_errors", "n_warnings", "status")
