"""Documents as bounded runs of lines.

A document of any length is held as chunks of at most ``size`` consecutive lines, so
no single task ever collects a whole document. Whether a corpus has documents longer
than one chunk is asked once, by a job that reads only the line numbers: if it has
none, which is normal for invoices, a chunk is a document and all neighbour handling
stays out of the plan. Otherwise every chunk gets context, the last lines before it and
the first lines after it, from a slim table of chunk edges.

A currency mark takes in a colon after it even across lines, which makes one line of the
two. Where a chunk border lies between them, the line goes to the chunk it begins in.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.functions.text import ends_with_currency
from daftar.sources.tables import stage

CHUNK = 4096
EDGE = 12  # lines of context on either side; the longest reach of any rule is below this


def has_long_documents(lines: DataFrame, size: int = CHUNK) -> bool:
    return not lines.where(F.col("line_no") >= size).isEmpty()


def long_documents(lines: DataFrame, size: int = CHUNK) -> DataFrame:
    """Ids of documents with more than one chunk."""
    return lines.where(F.col("line_no") >= size).select("doc_id").distinct()


def _gather(lines: DataFrame, size: int) -> DataFrame:
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    return (
        lines.groupBy("doc_id", F.floor(F.col("line_no") / size).cast("int").alias("chunk"))
        .agg(ordered.alias("_l"))
        .select("doc_id", "chunk", F.col("_l.text").alias("raw"))
    )


def _mends(chunks: DataFrame) -> DataFrame:
    """Lines that run over a chunk border: doc_id, chunk, headless, rest.

    ``headless`` chunks lose their first line to an earlier one, and ``rest`` continues the
    last line of a chunk. A chunk that is one such line passes on what follows it.
    """
    by_chunk = W.partitionBy("doc_id").orderBy("chunk")
    first = F.col("first")
    ends = (
        chunks.where(F.size("core") > 0)
        .select("doc_id", "chunk", "open", F.get("core", F.lit(0)).alias("first"), (F.size("core") == 1).alias("single"))
        .withColumn(
            "moved",
            F.when(
                first.startswith(":") & F.coalesce(F.lag("open").over(by_chunk), F.lit(False)),
                F.substring(first, 2, 1 << 30),
            ),
        )
    )
    passes_on = F.col("single") & F.col("moved").isNotNull()
    ends = ends.select(
        "doc_id",
        "chunk",
        "moved",
        (passes_on & F.lead("moved").over(by_chunk).isNotNull()).alias("goes_on"),
        F.last(F.when(~passes_on, F.col("chunk")), ignorenulls=True)
        .over(by_chunk.rowsBetween(W.unboundedPreceding, -1))
        .alias("owner"),
    ).where(F.col("moved").isNotNull())
    piece = F.when(F.col("goes_on"), _marked(F.col("moved"))).otherwise(F.col("moved"))
    rests = ends.groupBy("doc_id", F.col("owner").alias("chunk")).agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("chunk", piece.alias("piece"))))["piece"], "").alias("rest")
    )
    return ends.select("doc_id", "chunk", F.lit(True).alias("headless")).join(rests, ["doc_id", "chunk"], "full")


def _marked(line: Column) -> Column:
    """A line that ends with a currency mark, the mark written as it is before a colon."""
    return F.concat(F.left(line, F.length(line) - 3), F.lit("SAR"))


def _mended(chunks: DataFrame, mends: DataFrame) -> DataFrame:
    own = F.when(F.col("headless"), F.slice("core", F.lit(2), F.size("core"))).otherwise(F.col("core"))
    n = F.size("_own")
    last = F.concat(_marked(F.get("_own", n - 1)), F.col("rest"))
    whole = F.concat(F.slice("_own", F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(last))
    return (
        chunks.join(mends, ["doc_id", "chunk"], "left")
        .withColumn("_own", own)
        .select("doc_id", "chunk", F.when(F.col("rest").isNotNull(), whole).otherwise(F.col("_own")).alias("core"))
    )


def document_chunks(
    lines: DataFrame,
    to_lines: Callable[[Column], Column],
    size: int = CHUNK,
    split: bool | None = None,
) -> DataFrame:
    """Chunks with context: doc_id, chunk, before, core, after, first_pos, n_lines.

    ``to_lines`` turns the array of raw texts of one chunk into the array of canonical lines
    the rules work on (dropping empty ones). ``first_pos`` is the position of the chunk's
    first such line in the document and ``n_lines`` the document's number of them.
    ``split`` says whether there are documents longer than a chunk; None finds out.
    """
    none = F.array().cast("array<string>")
    if not (has_long_documents(lines, size) if split is None else split):
        ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
        whole = lines.groupBy("doc_id").agg(ordered.alias("_l"))
        return whole.select("doc_id", to_lines(F.col("_l.text")).alias("core")).select(
            "doc_id",
            F.lit(0).alias("chunk"),
            none.alias("before"),
            "core",
            none.alias("after"),
            F.lit(0).alias("first_pos"),
            F.size("core").alias("n_lines"),
        )

    # gathered and made canonical once: the border lines, the edges and the result all read these rows
    is_open = ends_with_currency(F.array_join("raw", "\n")).alias("open")
    gathered = stage(_gather(lines, size).select("doc_id", "chunk", to_lines(F.col("raw")).alias("core"), is_open), "chunks")
    long_ids = gathered.where(F.col("chunk") > 0).select("doc_id").distinct()
    spread = gathered.join(long_ids, "doc_id", "left_semi")
    mends = stage(_mends(spread), "mends")
    core, edges = (_mended(some, mends) for some in (gathered, spread))
    edges = edges.where(F.size("core") > 0).select(
        "doc_id",
        "chunk",
        F.size("core").alias("n"),
        F.slice("core", 1, EDGE).alias("head"),
        F.slice("core", -F.least(F.size("core"), F.lit(EDGE)), F.lit(EDGE)).alias("tail"),
    )
    # chunk rows per document, one per ``size`` lines
    by_chunk = W.partitionBy("doc_id").orderBy("chunk")
    prev = F.flatten(F.collect_list("tail").over(by_chunk.rowsBetween(-EDGE, -1)))
    nxt = F.flatten(F.collect_list("head").over(by_chunk.rowsBetween(1, EDGE)))
    edges = edges.select(
        "doc_id",
        "chunk",
        prev.alias("_prev"),
        F.slice(nxt, 1, EDGE).alias("_after"),
        F.coalesce(F.sum("n").over(by_chunk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_first"),
        F.sum("n").over(W.partitionBy("doc_id")).alias("_n"),
    ).withColumn(
        "_before",
        F.when(F.size("_prev") <= EDGE, F.col("_prev")).otherwise(F.slice("_prev", -EDGE, EDGE)),
    )
    return core.join(edges, ["doc_id", "chunk"], "left").select(
        "doc_id",
        "chunk",
        F.coalesce("_before", none).alias("before"),
        "core",
        F.coalesce("_after", none).alias("after"),
        F.coalesce("_first", F.lit(0)).alias("first_pos"),
        F.coalesce("_n", F.size("core")).alias("n_lines"),
    )
