"""Vectors of Arrow columns as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """Neither null nor empty, no null component, all components finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return vec.isNotNull() & (F.size(vec) > 0) & F.coalesce(F.forall(vec, finite), F.lit(False))


def by_length(ids: pa.Array, vecs: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Identifiers and matrices of usable vectors, one pair per length of vector."""
    lengths = vecs.value_lengths().to_numpy(zero_copy_only=False)
    flat = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    number = ids.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield number[rows].astype(np.int64), flat[starts[rows][:, None] + np.arange(int(n))]
