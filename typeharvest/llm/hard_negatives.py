"""Hard negatives by slot-decomposed selection.

Each of an anchor's positives asks for the best negatives in a window of scores below its own; the windows of one anchor
overlap. Their upper limits split all scores into disjoint slots, the highest first. In a block of rows a task scores all
anchors it meets and keeps the first k rows of each slot; blocks are then combined slot by slot, so an anchor never has more
than k rows for each positive. The rows of a slot and of all below it, in this order, are those that a window starting there
can hold: its first k, down to its lower limit, answer it. No window is searched on its own.

Rows and anchors meet in blocks of bounded size, dealt by a running number, so neither a frequent label nor an id that repeats
makes a large task. Positives come from blocks of one label, negatives from blocks of all.

Rows with a null id, a null label, a null vector, or a component that is null or not finite take no part; an empty vector has
score 0 with all, and shorter vectors count as 0 beyond their end. Rows that repeat an id are rows of their own, but never
partners of an anchor with that id; equal anchors are one. Ties: smaller id. Scores are exact, or the nearest end of a long.
An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import vectors as V
from .common import n_partitions, ship, written

POSITIVES, NEGATIVES = 5, 3
#: The window of a positive, in hundredths of its score.
FROM, TO = 50, 95
#: Most rows of a block and anchors of a group, rows of a block where there are few; anchors scored at once.
ROWS, ANCHORS, FEW, AT_ONCE = 16384, 16384, 2048, 128


def _table(found: list[tuple], names: list[str]) -> pa.Table:
    return pa.table([pa.array([f[c] for f in found], pa.int64()) for c in range(len(names))], names=names)


def _hundredths(score: str, share: int, up: bool) -> Column:
    exact = F.col(score).cast("decimal(20,0)") * share / 100
    return (F.ceil(exact) if up else F.floor(exact)).cast("long")


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (FROM, TO), id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its first
    `positives` rows of the same label, the first `negatives` rows of another label with a score within the window."""
    spark = vectors.sparkSession
    ship(spark)
    source = F.col(vector_col)
    own = source if dict(vectors.dtypes)[vector_col] == "array<float>" else source.cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & V.usable(vector_col))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), own.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    anchors = rows.where("anchor").select("id", "label", "v").distinct().withColumn("a", F.monotonically_increasing_id())
    anchors = written(anchors, "anchors")
    n, wide, most = rows.agg(F.count("*"), F.max(F.size("v")), F.max(V.largest("v"))).first()
    wide = wide or 1
    dtype = V.kind(wide, most or 0.0, scale)
    groups = max(1, math.ceil(anchors.count() / ANCHORS))
    blocks = max(1, math.ceil(n / ROWS), min(n_partitions(spark), math.ceil(n / FEW)))
    in_block = F.pmod(F.xxhash64("row", F.lit(11)), F.lit(blocks)).cast("int")
    in_group = F.pmod(F.xxhash64("a", F.lit(12)), F.lit(groups)).cast("int")
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    left = rows.select("id", "label", "v", in_block.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))

    def numbers(table: pa.Table) -> np.ndarray:
        return V.matrix(table.column("v"), wide, scale, dtype)

    def scored(block: pa.Table, asking: pa.Table):
        """(place of the anchor, its scores with the block) of each anchor."""
        if block.num_rows:
            x, q = numbers(block), numbers(asking)
            for at in range(0, len(q), AT_ONCE):
                yield from enumerate(V.scores(q[at : at + AT_ONCE], x), at)

    def alike(block: pa.Table, asking: pa.Table) -> pa.Table:
        ids, keys, names = block.column("id").to_numpy(), asking.column("a").to_pylist(), asking.column("id").to_numpy()
        found = []
        for i, s in scored(block, asking):
            others = np.flatnonzero(ids != names[i])
            for j in others[V.best(s[others], ids[others], positives)].tolist():
                found.append((keys[i], int(ids[j]), int(s[j])))
        return _table(found, ["a", "positive_id", "positive_score"])

    def slots(block: pa.Table, asking: pa.Table) -> pa.Table:
        ids, keys, names = block.column("id").to_numpy(), asking.column("a").to_pylist(), asking.column("id").to_numpy()
        limits, least = asking.column("limits").to_pylist(), asking.column("least").to_pylist()
        both = pa.chunked_array([*block.column("label").chunks, *asking.column("label").chunks], pa.string()).combine_chunks()
        codes = np.asarray(both.dictionary_encode().indices) if len(both) else np.empty(0, np.int32)
        labels, wanted = codes[: block.num_rows], codes[block.num_rows :]
        found = []
        for i, s in scored(block, asking):
            met = np.flatnonzero((s <= limits[i][0]) & (s >= least[i]) & (labels != wanted[i]) & (ids != names[i]))
            # slot: how many of the limits, which fall, a score does not reach above
            slot = len(limits[i]) - 1 - np.searchsorted(np.array(limits[i][::-1][:-1], np.int64), s[met], side="left")
            for k in np.unique(slot).tolist():
                here = met[slot == k]
                for j in here[V.best(s[here], ids[here], negatives)].tolist():
                    found.append((keys[i], k, int(ids[j]), int(s[j])))
        return _table(found, ["a", "slot", "negative_id", "negative_score"])

    asking = anchors.select("a", "id", "label", "v", in_group.alias("g"), each)
    near = left.groupBy("label", "b", "g").cogroup(asking.groupBy("label", "b", "g")).applyInArrow(alike, "a long, positive_id long, positive_score long")
    order = F.row_number().over(W.partitionBy("a").orderBy(F.desc("positive_score"), "positive_id"))
    near = near.withColumn("nth", order).where(F.col("nth") <= positives)
    near = near.withColumn("low", _hundredths("positive_score", window[0], True)).withColumn("high", _hundredths("positive_score", window[1], False))
    near = written(near.where("low <= high"), "positives")

    limits = near.groupBy("a").agg(F.sort_array(F.collect_set("high"), asc=False).alias("limits"), F.min("low").alias("least"))
    limits = written(limits, "limits")
    asking = anchors.join(limits, "a").select("a", "id", "label", "v", "limits", "least", in_group.alias("g"), each)
    found = left.groupBy("b", "g").cogroup(asking.groupBy("b", "g")).applyInArrow(slots, "a long, slot long, negative_id long, negative_score long")
    order = F.row_number().over(W.partitionBy("a", "slot").orderBy(F.desc("negative_score"), "negative_id"))
    first = found.withColumn("nth", order).where(F.col("nth") <= negatives)
    # the rows of an anchor, slot after slot: at most positives * negatives
    falling = first.groupBy("a").agg(F.sort_array(F.collect_list(F.struct("slot", "nth", "negative_score", "negative_id"))).alias("falling"))
    suffix = F.slice(F.filter("falling", lambda r: r.slot >= F.col("slot")), 1, negatives)
    answers = near.join(limits, "a").withColumn("slot", F.array_position("limits", F.col("high")) - 1).join(falling, "a")
    answers = answers.select("a", "positive_id", "positive_score", F.posexplode(F.filter(suffix, lambda r: r.negative_score >= F.col("low"))).alias("at", "r"))
    names = anchors.select("a", F.col("id").alias("anchor_id"))
    return answers.join(names, "a").select("anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), "r.negative_id", "positive_score", "r.negative_score")
