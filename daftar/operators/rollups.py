"""Monitoring figures and ledger roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.sources.tables import stage


BUCKETS = 1024  # of a range, per round


def exact_quantiles(values: DataFrame, quantiles: list[float], buckets: int = BUCKETS) -> DataFrame:
    """``key``, ``q``, ``value``: of every key's values (key, v) the smallest that at least the share q does not exceed.

    Exact, with memory that does not depend on the number of values: every round counts, per key and
    quantile, the values in equal parts of the range that still holds the wanted rank, and goes on
    with the part the rank falls into, narrowed to the least and greatest value there. It ends when
    these are equal. A range shrinks at least by one part in ``buckets`` a round, usually to
    one; what is exchanged is at most that many counts. NULL and NaN values do not count.
    """
    values = values.select("key", F.col("v").cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    ranks = F.explode(F.array(*[F.struct(F.lit(float(q)).alias("q"), F.greatest(F.ceil(F.lit(float(q)) * F.col("n")), F.lit(1)).alias("rank")) for q in quantiles]))
    sizes = values.groupBy("key").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    wanted = stage(sizes.select("key", "lo", "hi", ranks.alias("w")).select("key", "w.q", "w.rank", "lo", "hi"), "quantile-ranges")
    found = wanted.where("lo = hi")
    while not (todo := wanted.where("lo < hi")).isEmpty():
        w = todo.withColumnRenamed("key", "k")
        share = lambda v, lo, hi: (v - lo) / (hi - lo)
        halves = [F.col(c) / 2 for c in ("v", "lo", "hi")]  # where the width of the range is beyond a double
        place = F.when(F.col("hi") - F.col("lo") < float("inf"), share(F.col("v"), F.col("lo"), F.col("hi"))).otherwise(share(*halves))
        inside = values.join(w, F.col("key").eqNullSafe(F.col("k")) & F.col("v").between(F.col("lo"), F.col("hi"))).withColumn(
            "part", F.when(F.col("v") == F.col("hi"), buckets - 1).otherwise(F.least(F.floor(place * buckets), F.lit(buckets - 1)))
        )
        counts = inside.groupBy("key", "q", "rank", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        so_far = F.sum("n").over(W.partitionBy("key", "q").orderBy("part"))  # of at most that many parts
        narrowed = counts.withColumn("upto", so_far).where((F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col("n")))
        rest = F.col("rank") - (F.col("upto") - F.col("n"))
        wanted = stage(narrowed.select("key", "q", rest.alias("rank"), "lo", "hi"), "quantile-ranges")
        found = found.unionByName(wanted.where("lo = hi"))
    return found.select("key", "q", F.col("lo").alias("value"))


def ocr_timing_stats(results: DataFrame) -> DataFrame:
    """Distribution of every timing key over all OCR results (``timings`` map); the median and the 95th percentile are exact."""
    t = results.select(F.explode("timings").alias("key", "ms"))
    stats = t.groupBy("key").agg(
        F.count("*").alias("n"), F.round(F.avg("ms"), 4).alias("mean_ms"), F.min("ms").alias("min_ms"), F.max("ms").alias("max_ms")
    )
    places = exact_quantiles(t.select("key", F.col("ms").alias("v")), [0.5, 0.95]).groupBy("key").agg(
        *[F.max(F.when(F.col("q") == q, F.col("value"))).alias(c) for q, c in ((0.5, "p50_ms"), (0.95, "p95_ms"))]
    )
    return stats.join(places, "key", "left").select("key", "n", "mean_ms", "min_ms", "p50_ms", "p95_ms", "max_ms")


def windowed_counts(events: DataFrame, size: str, slide: str | None = None, *by: str) -> DataFrame:
    """Events per time window, optionally per further columns. Works on streams too."""
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    return (
        events.groupBy(window.alias("w"), *by)
        .agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n")
    )


def ocr_error_rate(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """OCR errors per window and error code, ``error_code`` being NULL on success."""
    return windowed_counts(events.where(F.col("error_code").isNotNull()), size, slide, "error_code")


def failed_job_count(events: DataFrame, size: str = "1 hour") -> DataFrame:
    return windowed_counts(events.where(F.col("status") == "OCR_FAILED"), size)


def trial_balance(journal: DataFrame, *by: str) -> DataFrame:
    """Debits and credits per account (and ``by``), with all rollup levels above."""
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("amount")).otherwise(0)).alias(s.lower())
    return journal.rollup("account_code", *by).agg(side("DR"), side("CR"), F.count("*").alias("n_lines"))


def unbalanced_entries(journal: DataFrame) -> DataFrame:
    """Entries whose debits and credits differ; empty when posting is right."""
    signed = F.when(F.col("side") == "DR", F.col("amount")).otherwise(-F.col("amount"))
    return journal.groupBy("journal_entry_id").agg(F.sum(signed).alias("difference")).where(F.col("difference") != 0)


def stock_ledger(movements: DataFrame) -> DataFrame:
    """Stock per product: quantity, cost and mean unit cost."""
    return movements.groupBy("product_id").agg(
        F.sum("quantity").alias("quantity"),
        F.sum("total_cost").alias("cost"),
        F.round(F.sum("total_cost") / F.sum("quantity"), 4).cast("decimal(18,4)").alias("mean_unit_cost"),
        F.count("*").alias("n_movements"),
    )


def stock_balance(movements: DataFrame) -> DataFrame:
    """Running stock per product and day.

    Movements are summed to days first, so the running window has one row per day of the
    calendar however many movements a product has.
    """
    daily = movements.groupBy("product_id", "movement_date").agg(
        F.sum("quantity").alias("quantity"), F.sum("total_cost").alias("cost")
    )
    so_far = W.partitionBy("product_id").orderBy("movement_date").rowsBetween(W.unboundedPreceding, 0)
    return daily.select(
        "*", F.sum("quantity").over(so_far).alias("balance"), F.sum("cost").over(so_far).alias("balance_cost")
    )


def supplier_spend(purchase_invoices: DataFrame) -> DataFrame:
    """Totals per supplier and month, with supplier and grand totals."""
    return (
        purchase_invoices.withColumn("month", F.trunc("invoice_date", "month"))
        .rollup("supplier_vat_number", "month")
        .agg(F.sum("total").alias("spend"), F.sum("vat_amount").alias("vat"), F.count("*").alias("n_invoices"))
    )
