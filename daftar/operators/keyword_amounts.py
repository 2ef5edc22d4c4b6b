"""Amount searches around keywords, one result per document, for keywords of choice.

The header job uses the same searches with the fixed keyword lists. Each function takes
lines (doc_id, line_no, text) and returns (doc_id, amount) for documents with a hit.
Patterns are given in the dialect of :mod:`daftar.functions.patterns`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from daftar.functions import patterns as P
from daftar.functions.text import canonical_text, line_amount, matches, matches_any
from daftar.operators.chunks import CHUNK, document_chunks
from daftar.operators.headers import amount_in_windows, amount_near, first_amount, header_lines, last_amount


def line_amounts(lines: DataFrame) -> DataFrame:
    """Adds ``amount``, the SAR amount on each line."""
    canonical = lines.withColumn("_canonical", canonical_text("text"))
    return canonical.withColumn("amount", line_amount(F.col("_canonical"))).drop("_canonical")


def document_amounts(lines: DataFrame, size: int = CHUNK, split: bool | None = None) -> DataFrame:
    """doc_id, position, amount: the SAR amounts of documents whose text is made canonical as a whole."""
    chunks = document_chunks(lines, header_lines, size, split)
    read = chunks.select("doc_id", "first_pos", F.posexplode("core").alias("pos", "text"))
    return read.select(
        "doc_id", (F.col("first_pos") + F.col("pos")).cast("int").alias("position"), line_amount(F.col("text")).alias("amount")
    )


def _facts(lines: DataFrame, size: int, split: bool | None, **more: Callable[[Column], Column]) -> DataFrame:
    """Chunks with ``own``, the places of their lines in ``facts``: the amount and ``more`` of each."""
    def facts(x: Column) -> Column:
        return F.struct(line_amount(x).alias("amount"), *[fact(x).alias(name) for name, fact in more.items()])

    chunks = document_chunks(lines, header_lines, size, split)
    lo, n = F.size("before"), F.size("core")
    own = F.when(n > 0, F.sequence(lo, lo + n - 1)).otherwise(F.array().cast("array<int>"))
    return chunks.select(
        "doc_id", "chunk", own.alias("own"), F.transform(F.concat("before", "core", "after"), facts).alias("facts")
    )


def _at(i: Column) -> Column:
    return F.get(F.col("facts"), i)


def _pick(df: DataFrame, value: str, last: bool = False) -> Column:
    chooser = F.max_by if last else F.min_by
    return chooser(value, F.when(F.col(value).isNotNull(), F.col("chunk")))


def amount_near_keyword(
    lines: DataFrame, keyword: str, window: int = 2, size: int = CHUNK, split: bool | None = None
) -> DataFrame:
    """First amount on a keyword line, after it, or before it."""
    facts = _facts(lines, size, split, hit=lambda x: matches(x, keyword))
    found = facts.select(
        "doc_id",
        "chunk",
        first_amount(F.col("own"), lambda i: F.when(_at(i)["hit"], amount_near(_at, i, (window, window)))).alias("v"),
    )
    return found.groupBy("doc_id").agg(_pick(found, "v").alias("amount")).where(F.col("amount").isNotNull())


def amount_near_keyword_strict(
    lines: DataFrame,
    keyword: str,
    before: int = 2,
    after: int = 3,
    exclude: list[str] | None = None,
    prefer_arabic: bool = False,
    size: int = CHUNK,
    split: bool | None = None,
) -> DataFrame:
    """As above, but excluded lines are no hits, end the search forward and are skipped backward."""
    facts = _facts(
        lines, size, split,
        hit=lambda x: matches(x, keyword),
        stop=lambda x: matches_any(x, exclude) if exclude else F.lit(False),
        arabic=lambda x: F.rlike(x, F.lit(P.ARABIC_LETTER)),
    )

    def tried(cond) -> Column:
        return first_amount(
            F.col("own"),
            lambda i: F.when(_at(i)["hit"] & ~_at(i)["stop"] & cond(i), amount_near(_at, i, (before, after), "stop")),
        )

    found = facts.select(
        "doc_id",
        "chunk",
        F.exists("own", lambda i: _at(i)["hit"] & ~_at(i)["stop"] & _at(i)["arabic"]).alias("has_arabic"),
        tried(lambda i: _at(i)["arabic"]).alias("arabic"),
        tried(lambda i: F.lit(True)).alias("any"),
    )
    docs = found.groupBy("doc_id").agg(
        F.max("has_arabic").alias("has_arabic"), _pick(found, "arabic").alias("arabic"), _pick(found, "any").alias("any")
    )
    only_arabic = F.lit(prefer_arabic) & F.col("has_arabic")
    return docs.select(
        "doc_id", F.when(only_arabic, F.col("arabic")).otherwise(F.col("any")).alias("amount")
    ).where(F.col("amount").isNotNull())


def amount_by_keywords(
    lines: DataFrame,
    labels: list[str],
    exclude: list[str] | None = None,
    prefer_last: bool = False,
    size: int = CHUNK,
    split: bool | None = None,
) -> DataFrame:
    """First (or last) amount for a label on one line or running over up to three."""
    facts = _facts(lines, size, split, text=lambda x: x)
    search = last_amount if prefer_last else first_amount
    value = search(F.col("own"), lambda i: amount_in_windows(_at, i, labels, exclude, prefer_last))
    found = facts.select("doc_id", "chunk", value.alias("v"))
    return found.groupBy("doc_id").agg(_pick(found, "v", prefer_last).alias("amount")).where(
        F.col("amount").isNotNull()
    )
