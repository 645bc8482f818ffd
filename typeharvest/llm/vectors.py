"""Whole-number vectors and exact inner products, however large.

A component x becomes floor(scale * x). Matrices get the smallest kind of number in which no sum of products is rounded:
single, double, 64-bit integers, or Python's own. Scores beyond a long are set to its nearest end.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether the vector is not null and all its components are finite numbers; an empty one is."""
    x = F.col(vector).cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(False))


def largest(vector: str) -> Column:
    """The largest absolute component, for agg(max(...))."""
    return F.array_max(F.transform(F.col(vector).cast("array<double>"), F.abs))


def kind(wide: int, most: float, scale: int) -> type:
    """The number type for vectors of up to `wide` components up to `most`."""
    limit = wide * (int(most) * scale + scale + 1) ** 2
    return np.float32 if limit < 2**24 else np.float64 if limit < 2**53 else np.int64 if limit < 2**63 else object


def _whole(x: float, scale: int) -> int:
    return int(x) * scale if abs(x) >= 2**53 else math.floor(x * scale)


def matrix(lists: pa.ChunkedArray, wide: int, scale: int, dtype: type) -> np.ndarray:
    """One row of whole numbers for each list; 0 beyond its end."""
    lists = lists.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), wide), dtype=dtype)
    at = np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    values = lists.flatten().to_numpy().astype(np.float64)
    out[at] = [_whole(v, scale) for v in values.tolist()] if dtype is object else np.floor(values * scale)
    return out


def scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All inner products, as 64-bit integers."""
    found = queries @ rows.T
    return np.clip(found, -(2**63), 2**63 - 1).astype(np.int64) if found.dtype == object else found.astype(np.int64)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, highest first, ties by smaller id."""
    if len(score) > 4 * k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
        return at[np.lexsort((ids[at], ~score[at]))[:k]]
    return np.lexsort((ids, ~score))[:k]
