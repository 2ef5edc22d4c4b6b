"""Invoice QR payloads: tag-length-value records in base64."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions import patterns as P
from daftar.functions.text import MONEY


def _byte(hex_text: Column, at: Column) -> Column:
    return F.conv(F.substr(hex_text, at * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _records(data: Column, size: Column) -> Column:
    """Map of tag to value. A record cut short ends the reading; a repeated tag: last wins."""
    start = F.struct(F.lit(0).alias("at"), F.map_from_arrays(F.array(), F.array()).cast("map<int,string>").alias("seen"))

    def read(acc: Column, _: Column) -> Column:
        at = acc["at"]
        tag, length = _byte(data, at), _byte(data, at + 1)
        value = F.make_valid_utf8(F.unhex(F.substr(data, at * 2 + 5, length * 2)).cast("string"))
        rest = F.map_filter(acc["seen"], lambda k, v: k != tag)
        fits = (at + 1 < size) & (at + 2 + length <= size)
        more = F.struct((at + 2 + length).cast("int").alias("at"), F.map_concat(rest, F.create_map(tag, value)).alias("seen"))
        over = F.struct(F.lit(1 << 30).alias("at"), acc["seen"].alias("seen"))
        return F.when(acc["at"] >= size, acc).when(fits, more).otherwise(over)

    # every record takes two bytes at least
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(size / 2).cast("int")))
    return F.aggregate(steps, start, read, lambda acc: acc["seen"])


def decode_qr_table(payloads: DataFrame) -> DataFrame:
    """doc_id, payload to the five invoice fields; undecodable payloads give NULLs."""
    # the decoder skips foreign characters and padding that completes nothing, and stops at
    # the first padding that completes four characters
    plain = F.regexp_replace("payload", "[^A-Za-z0-9+/=]", "")
    upto = F.regexp_extract(plain, "^=*(?:[^=]=*[^=]=?[^=][^=]=*)*?[^=]=*[^=](?:==|=?[^=]=)", 0)
    letters = F.replace(F.when(upto != "", upto).otherwise(plain), F.lit("="), F.lit(""))
    # only characters that the padding completes, or whole groups of four
    padded = F.when(upto != "", F.rpad(letters, F.ceil(F.length(letters) / 4).cast("int") * 4, F.lit("="))).otherwise(letters)
    clean = payloads.select("doc_id", padded.alias("b64"))
    whole = F.length("b64") % 4 == 0
    data = clean.select("doc_id", F.hex(F.when(whole, F.try_to_binary("b64", F.lit("base64")))).alias("data"))
    tags = data.withColumn("size", F.length("data") / 2).select(
        "doc_id", _records(F.col("data"), F.col("size")).alias("tags")
    )
    return tags.select("doc_id", *[F.try_element_at("tags", F.lit(t)).alias(n) for t, n in P.QR_TAGS.items()])


def qr_reconcile(decoded: DataFrame, headers: DataFrame, tolerance: str = P.ARITHMETIC_TOLERANCE) -> DataFrame:
    """QR fields against the extracted header, per document."""
    limit = F.lit(tolerance).cast(MONEY)

    def near(a: str, b: str) -> Column:
        return F.abs(F.col(a).try_cast(MONEY) - F.col(b)) <= limit

    h = headers.select(
        "doc_id",
        F.col("supplier_vat_number").alias("h_vat_number"),
        F.col("total").alias("h_total"),
        F.col("vat_amount").alias("h_vat_amount"),
    )
    return decoded.join(h, "doc_id", "left").select(
        "doc_id",
        (F.col("vat_number") == F.col("h_vat_number")).alias("vat_number_ok"),
        near("total", "h_total").alias("total_ok"),
        near("vat_amount", "h_vat_amount").alias("vat_amount_ok"),
    )


def qr_reconcile_summary(reconciled: DataFrame) -> DataFrame:
    checks = ["vat_number_ok", "total_ok", "vat_amount_ok"]
    return reconciled.groupBy().agg(
        F.count("*").alias("n_docs"),
        *[F.count_if(F.col(c)).alias(f"n_{c}") for c in checks],
        *[F.count_if(~F.col(c)).alias(f"n_{c}_not") for c in checks],
    )
