"""Pages and documents put together from OCR lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions import patterns as P
from daftar.functions.text import round_half_even

NO_TEXT = "OCR produced no text lines"
_SLICE = 4096


def _joined_text(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Texts joined in line order, in two steps so that partial texts are merged, not lines."""
    parts = (
        lines.groupBy(*keys, F.floor(F.col("line_no") / _SLICE).alias("_s"))
        .agg(
            F.array_join(F.sort_array(F.collect_list(F.struct("line_no", "text")))["text"], "\n").alias("_t"),
            F.sum("confidence").alias("_c"),
            F.count("*").alias("_n"),
        )
    )
    mean = round_half_even(F.sum("_c") / F.sum("_n"), 4)
    return parts.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("_s", "_t")))["_t"], "\n").alias("raw_text"),
        F.sum("_n").alias("n_lines"),
        mean.alias("confidence"),
    )


def _all_of(keys: DataFrame, found: DataFrame) -> DataFrame:
    """A row per key; without lines the text is empty and the confidence 0.0."""
    names = keys.columns
    return keys.distinct().join(found, names, "left").select(
        *names,
        F.coalesce("raw_text", F.lit("")).alias("raw_text"),
        F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def page_summary(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Text, line count and mean confidence of every page; ``pages`` (doc_id, page_no) adds those without lines."""
    found = _joined_text(lines, ["doc_id", "page_no"])
    return found if pages is None else _all_of(pages.select("doc_id", "page_no"), found)


def document_summary(lines: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """The same per document, over all its lines. Documents without lines get 0.0."""
    found = _joined_text(lines, ["doc_id"])
    if documents is None:
        return found
    return _all_of(documents.select("doc_id"), found)


def document_markdown(lines: DataFrame) -> DataFrame:
    """Texts of a document from top to bottom, whatever page they are on.

    Lines are numbered in that order, then joined in slices and the slices joined, so that only the
    result holds a whole document.
    """
    down = W.partitionBy("doc_id").orderBy("y1", "line_no", "text")
    placed = lines.select("doc_id", "text", (F.row_number().over(down) - 1).alias("_p"))
    texts = F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("_p", "text"))))["text"]
    parts = placed.groupBy("doc_id", F.floor(F.col("_p") / _SLICE).alias("_s")).agg(texts.alias("_l"))
    joined = F.when(F.size("_l") > 0, F.struct("_s", F.array_join("_l", "\n").alias("_t")))
    return parts.groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(joined))["_t"], "\n").alias("markdown"))


def empty_document_warning(documents: DataFrame, lines: DataFrame) -> DataFrame:
    return documents.select("doc_id").distinct().join(lines.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.lit(NO_TEXT).alias("warning")
    )


def low_confidence_documents(summary: DataFrame, threshold: float = P.OCR_MIN_CONFIDENCE) -> DataFrame:
    return summary.where(F.col("confidence") < threshold)


def _two_places(c: Column) -> Column:
    return F.format_string("%.2f", round_half_even(c, 2))


def choose_ocr_pass(
    documents: DataFrame,
    standard: DataFrame,
    enhanced: DataFrame,
    enabled: bool = True,
    threshold: float = P.OCR_MIN_CONFIDENCE,
) -> DataFrame:
    """Which OCR pass each document uses, and the warning when a second pass did not help.

    ``documents`` has doc_id and engine; the passes are line tables.
    """

    def stats(lines: DataFrame, name: str) -> DataFrame:
        return lines.groupBy("doc_id").agg(F.avg("confidence").alias(name))

    both = (
        documents.select("doc_id", "engine")
        .join(stats(standard, "std"), "doc_id", "left")
        .join(stats(enhanced, "enh"), "doc_id", "left")
    )
    tried = F.lit(enabled) & F.col("engine").isin(P.OCR_FALLBACK_ENGINES) & F.coalesce(
        F.col("std") < threshold, F.lit(False)
    )
    better = tried & F.coalesce(F.col("enh") > F.col("std"), F.lit(False))
    message = F.concat(
        F.lit("Enhanced fallback did not improve confidence ("),
        _two_places(F.coalesce("enh", F.lit(0.0))),
        F.lit(" vs "),
        _two_places(F.col("std")),
        F.lit(")"),
    )
    return both.select(
        "doc_id",
        better.alias("used_enhanced"),
        round_half_even(F.when(better, F.col("enh")).otherwise(F.coalesce("std", F.lit(0.0))), 4).alias("confidence"),
        F.when(tried & ~better, message).alias("warning"),
    )


def select_ocr_pass(choice: DataFrame, standard: DataFrame, enhanced: DataFrame) -> DataFrame:
    """Lines of the chosen pass; an enhanced pass counts as one page."""
    used = choice.where("used_enhanced").select("doc_id")
    return standard.join(used, "doc_id", "left_anti").unionByName(
        enhanced.join(used, "doc_id", "left_semi").withColumn("page_no", F.lit(1))
    )
