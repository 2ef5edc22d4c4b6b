"""Exact top-k search by inner product with a table of pivot distances.

For pivots p, |d(q, p) - d(v, p)| is a lower bound of d(q, v); the largest over all pivots
bounds the inner product from above, since 2 q.v = |q|^2 + |v|^2 - d(q, v)^2. Distances to the
pivots are computed once per vector and kept with it. Candidates are evaluated in the order of
their bounds until the k-th score found exceeds every bound left.

Vectors travel in blocks. Every block of queries meets every block of candidates, each pair
of blocks in a step of its own, so memory is bounded by two blocks at any table size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.llm.hard_negatives import HIGHEST, LOWEST, integers
from daftar.llm.shared import bounded_sample, small_batches, stage
from daftar.llm.vectors import by_length, usable

SCALE = 256
BLOCK, QUERY_BLOCK = 4096, 1024
GROUP = 128  # query blocks that a task holds
PIVOTS = 16
PIVOT_SAMPLE = 1024  # vectors the pivots are chosen from; the choice affects speed alone
FIRST = 256  # candidates evaluated before the first look at the bounds
EXACT = 2.0**52  # sums of products up to here are exact in double precision
LARGE = 2.0**31  # vectors with a scaled component from here on are held apart, as they are


def scaled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(SCALE * x)


def is_large(x: np.ndarray) -> np.ndarray:
    return np.abs(scaled(x)).max(axis=1, initial=0) >= LARGE


def choose_pivots(sample: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: each next pivot has the largest distance to those before."""
    if not len(sample):
        return sample
    chosen, nearest = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(n, len(sample)):
        nearest = np.minimum(nearest, ((sample - sample[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int(nearest.argmax()))
    return sample[chosen]


def _table(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances to the pivots, and the squared norm in the last column."""
    squares = (x * x).sum(axis=1)
    to = [np.sqrt(((x - p) ** 2).sum(axis=1)) for p in pivots]
    return np.stack([*to, squares], axis=1)


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    """The smaller integer type that holds a block."""
    kind = "<i2" if np.abs(x).max(initial=0) < 2**15 else "<i4"
    return kind, x.astype(kind).tobytes()


BLOCKS = "dim int, kind string, ids binary, vectors binary, pivot_table binary"


def _blocks(size: int, pivots: dict[int, np.ndarray]):
    schema = pa.schema([("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary()), ("pivot_table", pa.binary())])

    def row(ids: np.ndarray, x: np.ndarray, large: bool) -> pa.RecordBatch:
        kind, raw = ("<f8", x.tobytes()) if large else _packed(x)
        none = np.zeros((0, x.shape[1]))
        # large vectors are compared without bounds
        table = np.zeros((len(x), 1)) if large else _table(x, pivots.get(x.shape[1], none))
        values = [x.shape[1], kind, ids.tobytes(), raw, table.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for every, vectors in by_length(batch.column(0), batch.column(1)):
                apart = is_large(vectors)
                for large in (False, True):
                    ids, x = every[apart == large], vectors[apart == large]
                    key, x = (x.shape[1], large), x if large else scaled(x)
                    if key in held:
                        ids, x = np.concatenate([held[key][0], ids]), np.concatenate([held[key][1], x])
                    while len(ids) >= size:
                        yield row(ids[:size], x[:size], large)
                        ids, x = ids[size:], x[size:]
                    held[key] = ids, x
        for (_, large), (ids, x) in held.items():
            if len(ids):
                yield row(ids, x, large)

    return run


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products of one query with some candidates, held at the ends of a long's range."""
    if object not in (q.dtype, x.dtype) and np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * len(q) < EXACT:
        return (x @ q).astype(np.int64)
    exact = [sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for v in x]
    return np.array([min(max(s, LOWEST), HIGHEST) for s in exact], dtype=np.int64)


def best(
    q: np.ndarray, q_id: int, to_pivots: np.ndarray, ids: np.ndarray, x: np.ndarray, table: np.ndarray, k: int, least: float
) -> tuple[np.ndarray, np.ndarray, int]:
    """Identifiers and scores of the k best candidates scoring at least ``least``, and how many were evaluated."""
    lower = np.zeros(len(ids))
    for p in range(table.shape[1] - 1):
        np.maximum(lower, np.abs(table[:, p] - to_pivots[p]), out=lower)
    squares = table[:, -1] + to_pivots[-1]
    # a little above the bound, for the rounding of square roots
    bound = (squares - lower * lower) / 2 + 1e-9 * squares + 0.5
    bound[ids == q_id] = -np.inf
    found_ids, found = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    order, at, step, kth = np.argsort(-bound, kind="stable"), 0, FIRST, least
    end = int((bound >= least).sum()) if np.isfinite(least) else len(ids) - int((ids == q_id).sum())
    while at < end:
        now = order[at : min(at + step, end)]
        found_ids, found = np.concatenate([found_ids, ids[now]]), np.concatenate([found, _scores(q, x[now])])
        first = np.lexsort((found_ids, -1 - found))[:k]  # -1 - s does not overflow
        found_ids, found = found_ids[first], found[first]
        at, step = at + len(now), step * 2
        if len(found) == k:
            kth = max(kth, found[-1])
        if at < end and bound[order[at]] < kth:
            break
    good = found >= least
    return found_ids[good], found[good], at


MATCHES = "query_id long, vec_id long, score long"


def _search(k: int):
    def matrix(row: dict, side: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(row[f"{side}_ids"], dtype=np.int64)
        x = integers(row[f"{side}_kind"], row[f"{side}_vectors"], (len(ids), row["dim"]))
        return ids, x, np.frombuffer(row[f"{side}_pivot_table"], dtype=np.float64).reshape(len(ids), -1)

    def every(q: np.ndarray, q_id: int, ids: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k best of all candidates, where components are too large for bounds in doubles."""
        ids, x = ids[ids != q_id], x[ids != q_id]
        scores = _scores(q, x)
        first = np.lexsort((ids, -1 - scores))[:k]
        return ids[first], scores[first]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kth: dict[int, float] = {}  # what the k-th of a query reached in this task's earlier blocks
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                (qi, q, qt), (ci, c, ct) = matrix(row, "q"), matrix(row, "c")
                out: list[list] = [[], [], []]
                large = object in (q.dtype, c.dtype)
                for i in range(len(qi)):
                    if large:
                        ids, scores = every(q[i], int(qi[i]), ci, c)
                        out[0].append(np.full(len(ids), qi[i])), out[1].append(ids), out[2].append(scores)
                        continue
                    ids, scores, _ = best(q[i], int(qi[i]), qt[i], ci, c, ct, k, kth.get(int(qi[i]), -np.inf))
                    if len(ids) == k:
                        kth[int(qi[i])] = max(kth.get(int(qi[i]), -np.inf), float(scores[-1]))
                    out[0].append(np.full(len(ids), qi[i])), out[1].append(ids), out[2].append(scores)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in out], names=["query_id", "vec_id", "score"])

    return run


def _grid(candidates: int, queries: int, cores: int) -> tuple[int, int]:
    """Into how many shares the candidate blocks go, and into how many groups the query blocks.

    A query block is copied once per share, a candidate block once per group. Copies of queries are no more than there are
    candidates, unless that leaves too few shares for the cores; a group is what a task holds in memory.
    """
    shares = max(2 * cores, candidates * BLOCK // max(1, queries * QUERY_BLOCK))
    return max(1, min(candidates, shares)), max(1, -(-queries // GROUP))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score``: the k best of all other rows for every query row.

    Ties go to the smaller vec_id; with fewer than k candidates all are returned. Null or
    empty vectors, vectors holding a null or non-finite component, and rows with a null
    vec_id take no part. Vectors of different lengths do not meet. A candidate with the
    query's vec_id is the query's own row; of query rows that share a vec_id the smallest
    vector asks. Candidate rows that repeat are ranked one by one. Scores beyond the range of a
    long count as its nearest end. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = bounded_sample(rows.select("vec_id", "v"), PIVOT_SAMPLE, "vec_id").toArrow()
    pivots = {}
    if sample.num_rows:
        for _, x in by_length(sample.column(0).combine_chunks(), sample.column(1).combine_chunks()):
            pivots[x.shape[1]] = choose_pivots(scaled(x[~is_large(x)]))
    queries = rows.filter("asks").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stage(queries.mapInArrow(_blocks(QUERY_BLOCK, pivots), BLOCKS), "query-blocks")
    blocks = stage(rows.select("vec_id", "v").mapInArrow(_blocks(BLOCK, pivots), BLOCKS), "vector-blocks")
    small_batches(spark, 4)  # rows are whole blocks from here on
    name = lambda df, side: df.select("dim", *[F.col(c).alias(f"{side}_{c}") for c in df.columns if c != "dim"])
    # pairs of blocks spread over tasks: each task takes one share of the candidates and one group of the queries
    shares, groups = _grid(blocks.count(), asked.count(), spark.sparkContext.defaultParallelism)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    one = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = name(asked, "q").withColumn("share", every(shares)).withColumn("group", one("q_ids", groups))
    right = name(blocks, "c").withColumn("share", one("c_ids", shares)).withColumn("group", every(groups))
    # merged: Spark reckons the copies of the query blocks as one, and would gather them all in the driver to broadcast them
    pairs = right.join(left.hint("merge"), ["dim", "share", "group"])
    matches = pairs.mapInArrow(_search(k), MATCHES)
    place = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return matches.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
