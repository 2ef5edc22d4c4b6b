"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, one per half of the vectors, span a grid of cells. A vector lies in the
cell of its nearest codewords and visits cells in the order of the sum of its two
distances (the multi-sequence order) until vectors at the threshold would be met with the
target recall; how many cells that takes is measured on the codebooks' sample. All pairs
that meet are checked by cosine in double precision.

Equal vectors are one vector with a count. Cells are compared in blocks, so a crowded cell
spreads over many tasks, and what leaves a block is a count and a label per vector, not
its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from daftar.llm.components import components
from daftar.llm.shared import bounded_sample, small_batches, stage
from daftar.llm.vectors import usable

LEAST = 0.95
SAMPLE = 8192  # distinct vectors the codebooks are fitted on and the visits are measured with
PER_CELL = 48  # vectors a cell is meant to hold
CODEWORDS = 1024  # per half at most
RECALL = 0.99  # of pairs right at the threshold
BLOCK = 2048  # vectors of a cell compared at a time, on either side


@dataclass(frozen=True)
class Grid:
    first: np.ndarray
    second: np.ndarray
    visits: int

    def distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = self.first.shape[1]
        return _squares(x[:, :cut], self.first), _squares(x[:, cut:], self.second)

    def cells(self, x: np.ndarray) -> np.ndarray:
        """For unit vectors the cells they visit, nearest first: one row per vector, as many as ``visits``."""
        d, e = self.distances(x)
        rank_d, rank_e = np.argsort(d, axis=1, kind="stable"), np.argsort(e, axis=1, kind="stable")
        d, e = np.take_along_axis(d, rank_d, 1), np.take_along_axis(e, rank_e, 1)
        # the t-th nearest cell has ranks i, j with (i + 1)(j + 1) <= t
        pairs = [(i, j) for i in range(min(self.visits, d.shape[1])) for j in range(min(self.visits // (i + 1), e.shape[1]))]
        i, j = np.array(pairs).T
        total = d[:, i] + e[:, j]
        order = np.argsort(total, axis=1, kind="stable")[:, : self.visits]
        return np.take_along_axis(rank_d, i[order], 1).astype(np.int64) * len(self.second) + np.take_along_axis(rank_e, j[order], 1)


def _squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (x * x).sum(axis=1)[:, None] + (words * words).sum(axis=1) - 2 * x @ words.T


def _codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    words = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = _squares(x, words).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        words = np.where(n > 0, sums / np.maximum(n, 1), words)
    return words


def fit(sample: np.ndarray, n_vectors: int, least: float = LEAST, recall: float = RECALL) -> Grid:
    """Codebooks from unit vectors, and the visits that find a partner at the threshold with the target recall."""
    cut = sample.shape[1] // 2
    k = int(np.clip(round((n_vectors / PER_CELL) ** 0.5), 1, min(CODEWORDS, len(sample))))
    first, second = _codebook(sample[:, :cut], k), _codebook(sample[:, cut:], k)
    grid = Grid(first, second, 1)
    # partners at cosine ``least`` in random directions, the hardest that have to be found
    x = sample[:2000]
    noise = np.random.default_rng(11).normal(size=x.shape)
    noise -= (noise * x).sum(axis=1)[:, None] * x
    noise /= np.maximum(np.linalg.norm(noise, axis=1)[:, None], 1e-12)
    partner = least * x + (1 - least * least) ** 0.5 * noise
    home = grid.cells(x)[:, 0]
    d, e = grid.distances(partner)
    cost = d[np.arange(len(x)), home // k] + e[np.arange(len(x)), home % k]
    nearer = np.array([(np.sort(e[i])[None, :] + d[i][:, None] < cost[i] - 1e-12).sum() for i in range(len(x))])
    return Grid(first, second, int(np.quantile(nearer, recall, method="higher")) + 1)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), dtype=np.float64).reshape(len(raw), -1)
    # scaled first, so that squares of very large or small components stay in range
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


PLACED = "id long, times long, v binary, home long, visited array<long>"


def _place(grids: dict[int, Grid]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.array([len(v) for v in batch.column(2).to_pylist()])
            for n in np.unique(lengths):
                part = batch.take(pa.array(np.flatnonzero(lengths == n)))
                grid = grids[int(n) // 8]
                # cells of vectors of another length are others
                cells = grid.cells(_unit(part.column(2).to_pylist())) * 65_536 + int(n) // 8
                visited = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1) * cells.shape[1], pa.int32()), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[:, 0]), visited], names=["id", "times", "v", "home", "visited"])

    return run


LINKS = "id long, links long, label long"


def _compare(least: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        role = group.column("visitor").to_numpy()
        inside, visitors = np.flatnonzero(~role), np.flatnonzero(role)
        out = {"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "label": pa.array([], pa.int64())}
        if not len(inside) or not len(visitors):
            return pa.table(out)
        ids, times, home = (group.column(c).to_numpy() for c in ("id", "times", "home"))
        x = _unit(group.column("v").to_pylist())
        at_u, at_v = np.nonzero(x[visitors] @ x[inside].T >= least)
        u, v = visitors[at_u], inside[at_v]
        other = ids[u] != ids[v]
        u, v = u[other], v[other]
        if not len(u):
            return pa.table(out)
        # the inner vector counts the visitor here only if it does not visit the visitor's cell itself
        offsets = group.column("visited").chunk(0).offsets.to_numpy()
        cells = group.column("visited").chunk(0).values.to_numpy()
        # rows come in any order, and visitors carry no cells; all inner vectors of a cell visit equally many
        width = int(offsets[inside[0] + 1] - offsets[inside[0]])
        sees = (cells[(offsets[v][:, None] + np.arange(width))] == home[u][:, None]).any(axis=1)
        names, place = np.unique(ids, return_inverse=True)
        pu, pv = place[u], place[v]
        links = np.bincount(pu, times[v], len(names)) + np.bincount(pv, np.where(sees, 0, times[u]), len(names))
        label = np.arange(len(names))
        while True:
            before = label.copy()
            np.minimum.at(label, pu, label[pv])
            np.minimum.at(label, pv, label[pu])
            label = label[label]
            if (label == before).all():
                break
        some = np.unique(np.concatenate([pu, pv]))
        return pa.table({"id": pa.array(names[some]), "links": pa.array(links[some].astype(np.int64)), "label": pa.array(names[label[some]])})

    return run


def near_duplicates(vectors: DataFrame, least: float = LEAST, recall: float = RECALL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id``, ``kept`` for every row of ``vectors`` (vec_id, embedding).

    Null, empty and zero vectors and those holding a null or non-finite component link with
    nothing. Equal vectors always link. A vec_id is one node: rows that share it count as copies of
    it, and if their vectors differ, its links are those of all its vectors together. A row with a null vec_id links with nothing and has null results. Vectors of
    different lengths do not link. An empty table gives an empty table; other columns are
    ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    v = F.col("embedding").cast("array<double>")
    fit_for_use = F.col("vec_id").isNotNull() & usable(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(fit_for_use, v).alias("v"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [None if x is None else (np.array(x, dtype=np.float64) + 0.0).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["vec_id", "v"])

    rows = stage(rows.mapInArrow(packed, "vec_id long, v binary"), "vectors")
    reps = rows.filter("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"))
    reps = stage(reps.select("id", "times", "v"), "distinct-vectors")
    sizes = {r.n // 8: r["count"] for r in reps.groupBy(F.length("v").alias("n")).count().collect()}
    grids = {}
    for n, count in sizes.items():
        raw = bounded_sample(reps.filter(F.length("v") == n * 8).select("v"), SAMPLE, "v").toArrow().column(0).to_pylist()
        grids[n] = fit(_unit(raw), count, least, recall) if n > 1 else Grid(np.zeros((1, 0)), np.zeros((1, 1)), 1)
    placed = stage(reps.mapInArrow(_place(grids), PLACED), "placed-vectors")

    inside = placed.select("id", "times", "v", "home", "visited", F.col("home").alias("cell"), F.lit(False).alias("visitor"))
    visits = placed.select("id", "times", "v", "home", F.array().cast("array<long>").alias("visited"), F.explode("visited").alias("cell"), F.lit(True).alias("visitor"))
    counts = (
        placed.select(F.explode("visited").alias("cell"), "home").groupBy("cell")
        .agg(F.ceil(F.count("*") / BLOCK).alias("outer"), F.ceil(F.count_if(F.col("cell") == F.col("home")) / BLOCK).alias("inner"))
        .filter("inner > 0")
    )
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    left = inside.join(counts, "cell").withColumn("i", own("inner")).withColumn("j", spread("outer"))
    right = visits.join(counts, "cell").withColumn("j", own("outer")).withColumn("i", spread("inner"))
    both = left.unionByName(right).select("cell", "i", "j", "id", "times", "v", "home", "visited", "visitor")
    links = stage(both.groupBy("cell", "i", "j").applyInArrow(_compare(least), LINKS), "vector-links")

    total = links.groupBy("id").agg(F.sum("links").alias("links"))
    joined = components(links.select(F.col("id").alias("a"), F.col("label").alias("b")))
    known = reps.join(total, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        "v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id")
    )
    alone = F.when(F.col("vec_id").isNotNull(), F.lit(0))
    out = rows.join(known, "v", "left").select(
        "vec_id", F.coalesce("n_links", alone).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
