"""Mixing sources to target weights as a curriculum that changes over training time.

Each source has a demand (its target, in words) and a weight schedule over training time
t in [0, 1]. The integral of the schedule, scaled to the demand, says how many of the
source's words are consumed by time t. Inverting it turns the running word count of a
document within its source into the document's training position. Documents whose offset
lies beyond the demand are left out; a source with more demand than words starts over.

Everything is column functions, aggregates and windows. The running count of a source is
a sum inside small hash buckets plus the totals of the buckets before, so no source, however
large, meets in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEATS = 3
# slope of each source's weight over training time, repeating like the weights: the
# first source fades, the second stays level, the third grows
SLOPES = (-0.5, 0.0, 0.5)


def _cycle(values: Sequence[float], rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (((rank - 1) % len(values)) + 1).cast("int"))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per source: ``src``, ``src_null``, ``source_size``, ``weight``, ``slope_rank``, ``target``.

    ``sizes`` has one row per source. Targets share the sum of all sizes by weight; none is
    above ``max_repeats`` times its source's size. Sources reach that limit in the order of
    limit per weight, so one pass over the sorted sources gives the level at which the rest
    share what is left. The table has one row per source and is far smaller than the documents.
    """
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    by_name = W.orderBy("src_null", "src")
    ranked = sizes.select(
        "src", "src_null", "source_size", F.row_number().over(by_name).cast("long").alias("slope_rank")
    ).withColumns({
        "weight": _cycle(weights, F.col("slope_rank")).cast("long"),
        "limit": F.col("source_size") * max_repeats,
        "total": F.sum("source_size").over(everything),
    })
    by_limit = W.orderBy(F.col("limit") / F.col("weight"), "slope_rank")
    before = by_limit.rowsBetween(W.unboundedPreceding, -1)
    level = ranked.withColumns({
        "left": F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0)),
        "weights_left": F.sum("weight").over(by_limit.rowsBetween(0, W.unboundedFollowing)),
        "nth": F.row_number().over(by_limit),
    }).withColumn("full", F.col("limit") * F.col("weights_left") < F.col("left") * F.col("weight"))
    first = F.min(F.when(~F.col("full"), F.struct("nth", "left", "weights_left"))).over(everything)
    share = (F.col("weight") * F.col("at.left")).cast("double") / F.col("at.weights_left").cast("double")
    return level.withColumn("at", first).select(
        "src", "src_null", "source_size", "weight", "slope_rank",
        F.when(F.col("nth") < F.col("at.nth"), F.col("limit").cast("double")).otherwise(share).alias("target"),
    )


def _time(x: Column, slope: Column) -> Column:
    """Training time at which the share x of a demand is consumed, for the weight 1 + slope * (2t - 1)."""
    level = F.lit(1.0) - slope
    curved = (F.sqrt(level * level + slope * x * 4.0) - level) / (slope * 2.0)
    return F.when(slope == 0.0, x).otherwise(curved)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_repeats: int = MAX_REPEATS,
    slopes: Sequence[float] = SLOPES,
    digits: int = 3,
) -> DataFrame:
    """One row per document: ``doc`` (the row as given), ``size``, ``source_size``, ``target``, ``positions``.

    ``positions`` holds one training time per copy taken, at most ``max_repeats``, ascending;
    empty for documents left out. A copy is taken if the middle of its words lies within
    the demand, so each source is met to within half a document. Documents of a source are
    taken in the order of md5(doc_id), equal ids in the order of their texts' digests, so
    reruns agree. 16 ** ``digits`` buckets per source bound the rows that are sorted together.

    A null text counts 0 words; a null source is a source of its own, after all others; a
    null doc_id sorts first. Documents of no words take a position like others and add no
    words. An empty table gives an empty table; other columns are carried in ``doc`` untouched.
    """
    rows = docs.select(F.struct("*").alias("doc")).select(
        "doc",
        F.coalesce("doc.source", F.lit("")).alias("src"),
        F.col("doc.source").isNull().alias("src_null"),
        F.coalesce(F.regexp_count("doc.text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(F.coalesce(F.col("doc.doc_id").cast("string"), F.lit("")).cast("binary")).alias("h"),
        F.xxhash64("doc.text").alias("tie"),
    ).withColumn("bucket", F.substring("h", 1, digits))
    keys = ["src", "src_null", "bucket"]
    totals = rows.groupBy(*keys).agg(F.sum("size").alias("bucket_size"))
    sources = totals.groupBy("src", "src_null").agg(F.sum("bucket_size").alias("source_size"))
    earlier = W.partitionBy("src", "src_null").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        totals.withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
        .join(source_targets(sources, weights, max_repeats), ["src", "src_null"])
        .select(*keys, "start", "source_size", "target", _cycle(slopes, F.col("slope_rank")).alias("slope"))
    )
    within = W.partitionBy(*keys).orderBy("h", "doc.doc_id", "tie", "size").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts.hint("merge"), keys)

    def copy(r: int) -> Column:
        twice_middle = (F.col("start") + F.col("inside") + F.col("source_size") * r) * 2 + F.col("size")
        x = twice_middle.cast("double") / (F.col("target") * 2.0)
        # a source without words has no demand: its documents come first, once
        x = F.when(F.col("source_size") > 0, x).when(F.lit(r == 0), F.lit(0.0))
        return F.when(x < 1.0, _time(x, F.col("slope")))

    positions = F.array_compact(F.array(*[copy(r) for r in range(max_repeats)]))
    return placed.select("doc", "size", "source_size", "target", positions.alias("positions"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' columns, one row per copy taken, in training order."""
    copies = mix(docs, **options).select("doc", F.explode("positions").alias("at"))
    return copies.orderBy("at", "doc.doc_id").select("doc.*")
