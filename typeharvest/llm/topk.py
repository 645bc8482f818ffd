"""Exact top-k inner products by the threshold algorithm.

Candidates and queries meet in blocks: each task has one block of either. It sorts the candidates by every dimension and
reads the lists together, from the end that a query's sign prefers. Newly met candidates are scored in full; the sum of
what the lists show at their present depth bounds all candidates not met yet, and a query is done when that bound is below
its kth score. The best k of each block are then ranked by query: k rows for each block of candidates.

A task holds one block of candidates and one group of queries. Groups are large, so a candidate is sent once for each QUERIES
queries, and a query once to each block.

Vectors that are null or empty, or hold a null or non-finite component, take no part. Shorter vectors count as 0 beyond
their end. Components are whole numbers here, of a kind in which no sum of products is rounded, so scores are exact; one beyond
a long counts as the nearest end of a long. Ties: smaller id. Null ids take no part; rows that repeat
an id are candidates of their own, but not of a query with that id. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors as V
from .common import ship, written

K = 5
#: Candidates and queries that a task holds, about, and the lists' first depth.
CANDIDATES, QUERIES, DEPTH = 8192, 8192, 64


def threshold(vectors: np.ndarray, ids: np.ndarray, query: np.ndarray, own: int, k: int, lists: tuple[np.ndarray, np.ndarray]) -> list[tuple[int, int]]:
    """The k best (score, id) of a query; lists: candidates by rising component, and the sorted components."""
    order, ranked = lists
    n = len(ids)
    up, down = np.flatnonzero(query > 0), np.flatnonzero(query < 0)
    met = ids == own
    scores, who = np.empty(0, dtype=vectors.dtype), np.empty(0, dtype=np.int64)
    depth, reach = 0, DEPTH
    while depth < n:
        reach = min(reach, n)
        seen = np.zeros(n, dtype=bool)
        seen[order[n - reach : n - depth, up].ravel()] = True
        seen[order[depth:reach, down].ravel()] = True
        if reach == n:
            seen[:] = True
        new = np.flatnonzero(seen & ~met)
        met[new] = True
        met_now = vectors[new] @ query
        if met_now.dtype == object:
            met_now = np.clip(met_now, -(2**63), 2**63 - 1)
        scores, who = np.concatenate([scores, met_now]), np.concatenate([who, ids[new]])
        if len(scores) > k:
            best = np.lexsort((who, -scores))[:k] if len(scores) < 64 else None
            if best is None:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                best = np.flatnonzero(scores >= least)
                best = best[np.lexsort((who[best], -scores[best]))[:k]]
            scores, who = scores[best], who[best]
        bound = ranked[n - reach, up] @ query[up] + ranked[reach - 1, down] @ query[down]
        if len(scores) >= k and bound < scores.min():
            break
        depth, reach = reach, reach * 2
    order_ = np.lexsort((who, -scores))[:k]
    return [(int(scores[i]), int(who[i])) for i in order_]


def top_k(vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of each row for which is_query holds, against all other rows."""
    ship(vectors.sparkSession)
    own = F.col(vector_col) if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & V.usable(vector_col) & (F.size(vector_col) > 0))
    rows = written(rows.select(F.col(id_col).cast("long").alias("id"), own.alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")), "vectors")
    n, n_queries, wide, most = rows.agg(F.count("*"), F.sum(F.col("q").cast("long")), F.max(F.size("v")), F.max(V.largest("v"))).first()
    blocks, groups = max(1, math.ceil((n or 0) / CANDIDATES)), max(1, math.ceil((n_queries or 0) / QUERIES))
    wide = wide or 1
    exact = V.kind(wide, most or 0.0, scale)

    def matrix(t: pa.Table) -> np.ndarray:
        return V.matrix(t.column("v"), wide, scale, exact)

    def block(candidates: pa.Table, queries: pa.Table) -> pa.Table:
        found = []
        if candidates.num_rows and queries.num_rows:
            x, ids = matrix(candidates), candidates.column("id").to_numpy()
            order = np.argsort(x, axis=0, kind="stable")
            lists = order, np.take_along_axis(x, order, axis=0)
            for own, q in zip(queries.column("id").to_pylist(), matrix(queries)):
                found += [(own, i, s) for s, i in threshold(x, ids, q, own, k, lists)]
        return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

    in_block = F.pmod(F.xxhash64("id", F.lit(3)), F.lit(blocks)).cast("int")
    in_group = F.pmod(F.xxhash64("id", F.lit(4)), F.lit(groups)).cast("int")
    left = rows.select("id", "v", in_block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    right = rows.where("q").select("id", "v", in_group.alias("g"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    best = left.groupBy("b", "g").cogroup(right.groupBy("b", "g")).applyInArrow(block, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
