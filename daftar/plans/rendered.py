"""Invoices rendered from the order tables, the corpus the registered queries run on.

The given tables hold no invoices, so every order with lines becomes one: a header
block, its items, and a totals block, as OCR text lines. Orders without lines are rendered
only where a query asks for every order. The layout changes with the order key, so that each rule meets its special cases while
the expected outcome stays a plain expression over ``orders`` and ``lineitem``:

* key % 5 = 0: all digits Arabic-Indic
* key % 7 = 0: no invoice number line
* key % 11 = 0: printed total 5.00 too high
* key % 13 = 0: no VAT number line
* key % 19 = 0: each item on three lines
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions.text import MONEY

DIGITS, ARABIC = "0123456789", "٠١٢٣٤٥٦٧٨٩"
ITEM_SLOT = 3  # line numbers set aside per item
FIRST_ITEM = 5


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def order_items(spark: SparkSession, sf: str) -> DataFrame:
    """One row per invoice line: doc_id, item_no, name, qty, amount.

    An order has at most a few dozen lines, so numbering within the order is safe.
    """
    li = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        "l_quantity", "l_extendedprice", "l_shipdate",
    )
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    order = W.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate"
    )
    return li.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("order_key"),
        F.row_number().over(order).alias("item_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("p_name").alias("name"),
        F.col("l_quantity").cast("decimal(12,3)").alias("qty"),
        F.col("l_extendedprice").cast(MONEY).alias("amount"),
    )


def order_totals(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """One row per rendered order with the amounts printed on it.

    Orders without lines are left out, or, with ``every``, have no items and amounts of zero.
    """
    sums = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("order_key"))
        .agg(
            F.sum(F.col("l_extendedprice").cast(MONEY)).cast(MONEY).alias("subtotal"),
            F.count("*").alias("n_items"),
        )
    )
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_key"), "o_custkey", "o_orderdate", "o_orderstatus"
    )
    # merged, not broadcast: the order table then comes out in as many parts as there are
    # cores, and rendering its lines is spread over all of them
    return (
        orders.join(sums.hint("merge"), "order_key", "left" if every else "inner")
        .withColumn("subtotal", F.coalesce("subtotal", F.lit(0).cast(MONEY)))
        .withColumn("n_items", F.coalesce("n_items", F.lit(0)))
        .withColumn("vat", F.round(F.col("subtotal") * F.lit("0.15").cast("decimal(3,2)"), 2).cast(MONEY))
        .withColumn("true_total", (F.col("subtotal") + F.col("vat")).cast(MONEY))
        .withColumn(
            "total",
            (F.col("true_total") + F.when(F.col("order_key") % 11 == 0, 5).otherwise(0)).cast(MONEY),
        )
        .withColumn("vat_number", customer_vat_number())
    )


def customer_vat_number() -> Column:
    return F.concat(F.lit("3"), F.lpad(F.col("o_custkey").cast("string"), 13, "0"), F.lit("3"))


def _line(offset: Column, text: Column, keep: Column | None = None) -> Column:
    row = F.struct(offset.cast("int").alias("line_no"), text.alias("text"))
    return row if keep is None else F.when(keep, row)


def _emit(df: DataFrame, lines: list[Column]) -> DataFrame:
    key = F.col("order_key")
    text = F.col("l.text")
    shown = F.when(key % 5 == 0, F.translate(text, DIGITS, ARABIC)).otherwise(text)
    return (
        df.select("order_key", F.explode(F.filter(F.array(*lines), lambda x: x.isNotNull())).alias("l"))
        .select(
            key.cast("string").alias("doc_id"),
            F.lit(1).alias("page_no"),
            F.col("l.line_no").alias("line_no"),
            shown.alias("text"),
        )
    )


def text_invoices(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """OCR text lines of all rendered invoices: doc_id, page_no, line_no, text.

    With ``every``, also of orders without items; of these, even keys are blank sheets
    without any line.
    """
    key = F.col("order_key")
    money = lambda c: F.col(c).cast("string")
    number = F.col("o_custkey").cast("string")
    number = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    trader = F.translate(number, DIGITS, "ABCDEFGHIJ")
    foot = F.lit(FIRST_ITEM) + F.col("n_items") * ITEM_SLOT
    orders = order_totals(spark, sf)
    if every:
        orders = order_totals(spark, sf, every).where((F.col("n_items") > 0) | (key % 2 != 0))
    frame = _emit(
        orders,
        [
            _line(F.lit(0), F.concat(F.lit("Supplier: Trader "), trader)),
            _line(F.lit(1), F.concat(F.lit("الرقم الضريبي "), F.col("vat_number")), key % 13 != 0),
            _line(F.lit(2), F.concat(F.lit("فاتورة# "), key.cast("string")), key % 7 != 0),
            _line(F.lit(3), F.concat(F.lit("التاريخ: "), F.date_format("o_orderdate", "yyyy-MM-dd"))),
            _line(F.lit(4), F.lit("الكمية وحدة السعر")),
            _line(foot, F.concat(F.lit("المجموع الفرعي SAR "), money("subtotal"))),
            _line(foot + 1, F.concat(F.lit("ضريبة القيمة المضافة (15%) SAR "), money("vat"))),
            _line(foot + 2, F.concat(F.lit("الإجمالي SAR "), money("total"))),
        ],
    )
    at = F.lit(FIRST_ITEM) + (F.col("item_no") - 1) * ITEM_SLOT
    qty = F.col("qty").cast("int").cast("string")
    split = key % 19 == 0
    body = _emit(
        order_items(spark, sf),
        [
            _line(at, F.concat_ws(" ", qty, "name", F.lit("SAR"), money("amount")), ~split),
            _line(at, qty, split),
            _line(at + 1, F.col("name"), split),
            _line(at + 2, F.concat(F.lit("SAR "), money("amount")), split),
        ],
    )
    return frame.unionByName(body)


def statements(spark: SparkSession, sf: str) -> DataFrame:
    """Long documents, one per 1,000 order keys: a title, then two lines per item.

    The first ends with the currency mark, the second begins with the colon, so that every
    border after an even number of lines lies between the two.
    """
    items = order_items(spark, sf)
    doc = F.floor(F.col("order_key") / 1000)
    # at most 1,000 rows per document
    earlier = W.partitionBy("doc").orderBy("order_key").rowsBetween(W.unboundedPreceding, -1)
    starts = items.groupBy("order_key").agg(F.count("*").alias("n")).withColumn("doc", doc).select(
        "order_key", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start")
    )
    at = F.col("start") + F.col("item_no")
    parts = F.array(
        F.struct((2 * at - 1).cast("int").alias("line_no"), F.concat("name", F.lit(" SAR")).alias("text")),
        F.struct((2 * at).cast("int").alias("line_no"), F.concat(F.lit(": "), F.col("amount").cast("string")).alias("text")),
    )
    body = items.join(starts, "order_key").select(doc.alias("doc"), F.explode(parts).alias("l")).select("doc", "l.*")
    titles = items.select(doc.alias("doc")).distinct().select("doc", F.lit(0).alias("line_no"), F.lit("Statement").alias("text"))
    return titles.unionByName(body).select(F.col("doc").cast("string").alias("doc_id"), "line_no", "text")


def positioned_invoices(spark: SparkSession, sf: str, every: bool = False) -> DataFrame:
    """The same orders as table cells with boxes and confidences, without SAR marks.

    Cells of one row lie up to 9 units apart in height, rows 30 apart. Every cell has
    confidence 0.95, or 0.70 in rows of items whose number is a multiple of 4. Orders with
    key % 6 = 0 have no column titles. With ``every``, orders without items have their titles alone.
    """
    items = order_items(spark, sf)
    price = F.round(F.col("amount") / F.col("qty"), 2).cast(MONEY).cast("string")
    cells = F.array(
        *[
            F.struct(F.lit(i).alias("col"), F.lit(x).alias("x"), text.alias("text"))
            for i, (x, text) in enumerate(
                [
                    (50.0, F.col("name")),
                    (210.0, F.col("qty").cast("int").cast("string")),
                    (290.0, price),
                    (400.0, F.col("amount").cast("string")),
                ]
            )
        ]
    )
    body = items.select("order_key", "item_no", F.explode(cells).alias("c"))
    titles = F.array(
        *[
            F.struct(F.lit(i).alias("col"), F.lit(x).alias("x"), F.lit(text).alias("text"))
            for i, (x, text) in enumerate(
                [(50.0, "الوصف"), (210.0, "الكمية"), (290.0, "سعر الوحدة"), (400.0, "الإجمالي")]
            )
        ]
    )
    head = order_totals(spark, sf, every).select(
        "order_key",
        F.lit(0).alias("item_no"),
        F.explode(F.when(F.col("order_key") % 6 != 0, titles)).alias("c"),
    )
    top = F.lit(100.0) + F.col("item_no") * 30.0 + F.col("c.col") * 3.0
    return head.unionByName(body).select(
        F.col("order_key").cast("string").alias("doc_id"),
        F.lit(1).alias("page_no"),
        (F.col("item_no") * 4 + F.col("c.col")).cast("int").alias("line_no"),
        F.col("c.text").alias("text"),
        F.when((F.col("item_no") > 0) & (F.col("item_no") % 4 == 0), 0.70).otherwise(0.95).alias("confidence"),
        F.col("c.x").alias("x1"),
        top.alias("y1"),
        (F.col("c.x") + 60.0).alias("x2"),
        (top + 20.0).alias("y2"),
    )
