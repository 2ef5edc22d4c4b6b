"""Connected components of an edge table by joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.shared import drop_staged, stage


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the smallest node reachable) for every node of ``edges`` (columns a, b).

    Each round hooks trees onto the smallest parent seen among neighbours and halves paths
    (the FastSV scheme), so the number of rounds grows with the logarithm of a chain's
    length. All state is a table in the shared folder; only a row count reaches the driver.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stage(both.filter("a != b").distinct(), "edges")
    parents = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("f")), "parents")
    while True:
        up = parents.select(F.col("node").alias("f"), F.col("f").alias("gf"))
        grand = parents.join(up, "f", "left").select("node", "f", F.coalesce("gf", "f").alias("gf"))
        seen = (
            both.join(grand.select(F.col("node").alias("b"), "gf"), "b")
            .groupBy(F.col("a").alias("node")).agg(F.min("gf").alias("m"))
        )
        known = grand.join(seen, "node")
        offers = known.select(
            F.col("f").alias("was"),
            F.explode(F.array(
                F.struct("node", F.least("m", "gf").alias("f")),
                F.struct(F.col("f").alias("node"), F.least("m", "gf").alias("f")),
            )).alias("o"),
        ).select("o.*")
        better = offers.groupBy("node").agg(F.min("f").alias("offer"))
        after = stage(
            parents.join(better, "node").select("node", F.least("f", "offer").alias("f"), F.col("f").alias("old")), "parents"
        )
        changed = not after.filter("f != old").isEmpty()
        drop_staged(parents)
        parents = after.select("node", "f")
        if not changed:
            drop_staged(both)
            return parents.select("node", F.col("f").alias("component"))
