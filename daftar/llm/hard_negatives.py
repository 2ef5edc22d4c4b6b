"""Hard negatives by vertical scans of vector blocks (branch and bound on decomposed data).

Vectors are stored in blocks by dimension: one column of integers per dimension, with its smallest
and largest value. An anchor reads a block's columns in the order of its own magnitudes, largest
first. After every few columns each candidate's score lies between its partial sum plus the least
and plus the most that the unread columns can add; a bitmap of candidates shrinks to those whose
interval can still matter. What survives all columns has its exact score.

Two scans: the first finds an anchor's positives (same label, best scores), which fix the windows
of scores that the second scan, over the other labels, resolves. Blocks are sorted by label, so the
first scan visits only blocks that hold an anchor's label. Anchors travel in blocks too, and every
pair of blocks is a step of its own in some task, so memory is bounded at any table size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from daftar.llm.shared import small_batches, stage
from daftar.llm.vectors import usable

SCALE = 256
BLOCK, ANCHOR_BLOCK = 4096, 512
PER_SHARE = 8  # candidate blocks that an anchor block meets in one task, one after the other
COLUMNS = 8  # read between two looks at the bounds
EXACT = 2.0**52  # sums of products up to here are exact in double precision
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def scaled(x: np.ndarray) -> tuple[str, np.ndarray]:
    """floor(256 x) in the smallest type that holds it; components too large for that stay as they are, marked "<f8"."""
    with np.errstate(over="ignore"):
        whole = np.floor(SCALE * x)
    most = np.abs(whole).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, (x if kind == "<f8" else whole).astype(kind)


def integers(kind: str, raw: bytes, shape: tuple[int, int]) -> np.ndarray:
    """The scaled components back: doubles, or Python integers where doubles would not be exact."""
    x = np.frombuffer(raw, dtype=kind).reshape(shape)
    if kind != "<f8":
        return x.astype(np.float64)
    # 256 x is a whole number, and may be infinite as a double, from 2**900 on
    whole = [int(v) * SCALE if abs(v) > 2.0**900 else int(np.floor(v * SCALE)) for v in x.ravel().tolist()]
    return np.array(whole, dtype=object).reshape(shape)


BLOCKS = "block long, dim int, kind string, ids binary, labels binary, vectors binary, windows binary, held array<long>"
_SCHEMA = pa.schema([
    ("block", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("labels", pa.binary()), ("vectors", pa.binary()),
    ("windows", pa.binary()), ("held", pa.list_(pa.int64())),
])


def _blocks(size: int, by_column: bool, n_windows: int):
    """Rows (vec_id, label, v and, for windows, the positives' scores) as blocks of vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            nonlocal name
            kind, x = scaled(np.array([v for _, _, v, *_ in held], dtype=np.float64))
            labels = np.array([label for _, label, *_ in held], dtype=np.int64)
            windows = np.full((len(held), n_windows), LOWEST, dtype=np.int64)
            for row, (_, _, _, *more) in enumerate(held):
                if more:
                    windows[row, : len(more[0])] = more[0]
            values = [
                name, x.shape[1], kind, np.array([i for i, *_ in held], dtype=np.int64).tobytes(), labels.tobytes(),
                np.ascontiguousarray(x.T if by_column else x).tobytes(), windows.tobytes(), np.unique(labels).tolist(),
            ]
            held.clear()
            name += 1
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _SCHEMA, strict=True)], schema=_SCHEMA)

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if held and (len(held) >= size or len(held[0][2]) != len(row[2])):
                    yield block()
                held.append(row)
        if held:
            yield block()

    return run


def _kth(values: np.ndarray, k: int):
    """The k-th largest, or None of fewer."""
    return None if len(values) < k else np.sort(values)[len(values) - k]


def vertical(
    q: np.ndarray, columns: np.ndarray, least: np.ndarray, most: np.ndarray, alive: np.ndarray, matters: Callable, step: int = COLUMNS
) -> tuple[np.ndarray, np.ndarray, int]:
    """Candidates (indexes into the columns) that may matter to the end, their exact scores, and how many components were read.

    ``matters(lower, upper, alive)`` gives a bitmap from the bounds of the candidates left.
    """
    order = np.argsort(-np.abs(q), kind="stable")
    low, high = np.minimum(q * least, q * most)[order], np.maximum(q * least, q * most)[order]
    zero = np.zeros(1, dtype=low.dtype)
    rest_low = np.concatenate([np.cumsum(low[::-1])[::-1], zero])
    rest_high = np.concatenate([np.cumsum(high[::-1])[::-1], zero])
    partial, read = np.zeros(len(alive), dtype=q.dtype), 0
    whole = len(alive) == columns.shape[1]
    for at in range(0, len(q) + step, step):
        keep = matters(partial + rest_low[min(at, len(q))], partial + rest_high[min(at, len(q))], alive)
        if not keep.all():
            alive, partial, whole = alive[keep], partial[keep], False
        if at >= len(q) or not len(alive):
            break
        now = order[at : at + step]
        some = columns[now] if whole else columns[now[:, None], alive]
        partial = partial + q[now] @ some
        read += some.size
    return alive, partial, read


class Best:
    """The k best (score, then smaller identifier) seen so far."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores.astype(np.int64)])
        first = np.lexsort((ids, -1 - scores))[: self.k]  # -1 - s does not overflow
        self.ids, self.scores = ids[first], scores[first]

    @property
    def kth(self):
        return int(self.scores[-1]) if len(self.scores) == self.k else None


def _held(x: np.ndarray) -> np.ndarray:
    """Scores within the range of a long."""
    return np.clip(x, LOWEST, HIGHEST) if x.dtype == object else x


def best_matter(found: Best) -> Callable:
    """A candidate matters while it can be among the k best."""

    def matters(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray) -> np.ndarray:
        bound = [b for b in (_kth(_held(lower), found.k), found.kth) if b is not None]
        return _held(upper) >= max(bound) if bound else np.ones(len(alive), dtype=bool)

    return matters


def windows_matter(found: list[tuple[int, int, Best]]) -> Callable:
    """A candidate matters while in some window (low, high, best so far) it can be among the k best."""

    def matters(lower: np.ndarray, upper: np.ndarray, alive: np.ndarray) -> np.ndarray:
        lower, upper, keep = _held(lower), _held(upper), np.zeros(len(alive), dtype=bool)
        for low, high, best in found:
            inside = lower[(lower >= low) & (upper <= high)]
            bound = max(b for b in (_kth(inside, best.k), best.kth, low) if b is not None)
            keep |= (upper >= bound) & (lower <= high)
        return keep

    return matters


class Pair:
    """One block of anchors against one block of candidates."""

    def __init__(self, row: dict):
        self.dim = row["dim"]
        of = lambda side, c: np.frombuffer(row[f"{side}_{c}"], dtype=np.int64)
        self.anchor_ids, self.anchor_labels = of("a", "ids"), of("a", "labels")
        self.windows = of("a", "windows").reshape(len(self.anchor_ids), -1)
        self.anchors = integers(row["a_kind"], row["a_vectors"], (len(self.anchor_ids), self.dim))
        self.ids, self.labels = of("c", "ids"), of("c", "labels")
        self.columns = integers(row["c_kind"], row["c_vectors"], (self.dim, len(self.ids)))
        if object not in (self.anchors.dtype, self.columns.dtype):
            most = [float(np.abs(x).max(initial=0)) for x in (self.anchors, self.columns)]
            if most[0] * most[1] * self.dim * 2 < EXACT:
                most = []
        else:
            most = [np.inf]
        if most:  # doubles would not be exact
            self.anchors, self.columns = (x if x.dtype == object else x.astype(np.int64).astype(object) for x in (self.anchors, self.columns))
        self.least, self.most = self.columns.min(axis=1), self.columns.max(axis=1)
        # rows of a block are sorted by label
        self.first, self.last = np.searchsorted(self.labels, self.anchor_labels, "left"), np.searchsorted(self.labels, self.anchor_labels, "right")
        self.read = 0

    def scan(self, nth: int, candidates: np.ndarray, matters: Callable) -> tuple[np.ndarray, np.ndarray]:
        left, scores, read = vertical(self.anchors[nth], self.columns, self.least, self.most, candidates, matters)
        self.read += read
        return self.ids[left], _held(scores)

    def positives(self, nth: int, found: list) -> None:
        same = np.arange(self.first[nth], self.last[nth])
        same = same[self.ids[same] != self.anchor_ids[nth]]
        if len(same):
            found[0][2].add(*self.scan(nth, same, best_matter(found[0][2])))

    def negatives(self, nth: int, found: list) -> None:
        other = np.concatenate([np.arange(self.first[nth]), np.arange(self.last[nth], len(self.ids))])
        other = other[self.ids[other] != self.anchor_ids[nth]]
        if not len(other):
            return
        ids, scores = self.scan(nth, other, windows_matter(found))
        for low, high, best in found:
            inside = (scores >= low) & (scores <= high)
            best.add(ids[inside], scores[inside])


FOUND = "anchor_id long, place int, vec_id long, score long"
_FOUND = pa.schema([("anchor_id", pa.int64()), ("place", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
HELD_BLOCKS = 4  # anchor blocks whose best so far a task keeps


def _scan(negatives: bool, k: int, percent: int):
    def start(windows: np.ndarray) -> list[tuple[int, int, Best]]:
        if not negatives:
            return [(LOWEST, HIGHEST, Best(k))]
        # percent * positive <= 100 * negative <= 100 * positive, so a negative positive score has no window
        return [(-(-percent * int(s) // 100), int(s), Best(k)) for s in windows]

    def rows(pair_ids: np.ndarray, found: list[list]) -> pa.RecordBatch:
        some = [(a, place, b) for a, windows in zip(pair_ids.tolist(), found, strict=True) for place, (_, _, b) in enumerate(windows, 1)]
        n = [len(b.ids) for _, _, b in some]
        join = lambda parts: np.concatenate([np.zeros(0, dtype=np.int64), *parts])
        values = [np.repeat([a for a, _, _ in some], n), np.repeat([p for _, p, _ in some], n), join(b.ids for _, _, b in some), join(b.scores for _, _, b in some)]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64), pa.int64()).cast(f.type) for v, f in zip(values, _FOUND, strict=True)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, list[list]]] = {}
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pair = Pair(row)
                if row["a_block"] not in held:
                    if len(held) == HELD_BLOCKS:
                        yield rows(*held.pop(next(iter(held))))
                    held[row["a_block"]] = pair.anchor_ids, [start(w) for w in pair.windows]
                for nth, found in enumerate(held[row["a_block"]][1]):
                    (pair.negatives if negatives else pair.positives)(nth, found)
        for some in held.values():
            yield rows(*some)

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, label: Column, is_anchor: Column, n_positives: int = 5, n_negatives: int = 5, percent: int = 80) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    For every anchor row of ``vectors`` (vec_id, embedding) and each of its ``n_positives`` best
    other rows of the same label: the first ``n_negatives`` rows of other labels whose scores are at
    most the positive's and at least ``percent`` of it. A score is the inner product of floor(256 x);
    ties go to the smaller vec_id. Scores beyond the range of a long count as its nearest end.

    Null, empty and non-finite vectors, null labels and null vec_ids take no part; vectors of
    different lengths do not meet. Rows with an anchor's vec_id are the anchor; of several the least
    (label, vector) asks. Candidate rows that repeat are ranked one by one. An anchor without a
    positive, or whose positives' scores are negative, has no rows. An empty table gives an empty
    table. Other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark, 2000)
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"), is_anchor.alias("asks"),
    )
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    def packed(df: DataFrame, size: int, by_column: bool, name: str, *more: str) -> DataFrame:
        """Blocks of rows sorted by length and label; ranges end inside a label too, so none is too large for a task."""
        placed = df.repartitionByRange("dim", "label", "vec_id").sortWithinPartitions("dim", "label", "vec_id")
        return stage(placed.select("vec_id", "label", "v", *more).mapInArrow(_blocks(size, by_column, n_positives if more else 1), BLOCKS), name)

    anchors = rows.filter("asks").groupBy("vec_id").agg(F.min(F.struct("label", "v", "dim")).alias("row")).select("vec_id", "row.*")
    blocks = packed(rows, BLOCK, True, "column-blocks")
    shares = -(-blocks.count() // PER_SHARE) or 1
    blocks = blocks.withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
    candidates = blocks.select("dim", "share", *[F.col(c).alias(f"c_{c}") for c in ("kind", "ids", "labels", "vectors")])
    named = lambda df: df.select("dim", "share", *[F.col(c).alias(f"a_{c}") for c in ("block", "kind", "ids", "labels", "vectors", "windows")])

    def scan(askers: DataFrame, negatives: bool, k: int) -> DataFrame:
        small_batches(spark, 1)  # rows are pairs of blocks from here on
        return named(askers).join(candidates, ["dim", "share"]).mapInArrow(_scan(negatives, k, percent), FOUND)

    asking = packed(anchors, ANCHOR_BLOCK, False, "anchor-blocks")
    where = blocks.select("dim", "share", F.explode("held").alias("label")).distinct()
    visits = asking.select("block", "dim", F.explode("held").alias("label")).join(where, ["dim", "label"]).select("block", "share").distinct()
    positives = stage(_first(scan(asking.join(visits, "block"), False, n_positives), n_positives).drop("place"), "positives")

    small_batches(spark, 2000)
    scores = positives.filter("score >= 0").groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("w"))
    scores = scores.select(F.col("anchor_id").alias("vec_id"), F.transform("w", lambda x: x["score"]).alias("windows"))
    asking = packed(anchors.join(scores, "vec_id"), ANCHOR_BLOCK, False, "anchor-windows", "windows")
    everywhere = asking.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    negatives = _first(scan(everywhere, True, n_negatives), n_negatives)
    known = positives.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return negatives.join(known, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


MINE_SQL = """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.e, c.e) AS BIGINT) AS score
      FROM v a JOIN v c ON a.vec_id <> c.vec_id AND len(a.e) = len(c.e) WHERE a.vec_id % 100 = 0),
    p AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    n AS (
      SELECT anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
      FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
