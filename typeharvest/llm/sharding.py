"""Shards of even row counts, by balanced label propagation.

Documents are linked through hubs (here: equal texts). Each starts in the shard that its id hashes to. In every round each
hub looks at the shards of its documents and asks for the others to move to the one that holds most of them and has places
free; a shard that is asked for more than its quota takes a hashed share. A hub with more documents than half a shard is
dealt over as few shards as hold it. Rounds end when nothing moves. Unlinked documents, which no cut concerns, then fill
the shards to counts at most one apart, and whatever stands above a quota is dealt with them.

A round joins written tables of (hub, shard) counts; only numbers by shard reach the driver. Ranks come from bucket counts
and ranks within a bucket, so no task sorts a shard.

Null text: size 16, crc 0, equal to the empty text. Null and repeated ids: each row has its place. An empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import whole_text, written

SHARDS, ROUNDS = 40, 12
#: Rows of a bucket that one task ranks, about.
BUCKET = 50_000


def _unit(*columns: str | Column) -> Column:
    """A hash in [0, 1)."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def _by_shard(values: list[float], shard: str | Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.col(shard) if isinstance(shard, str) else shard) + 1)


def _counts(df: DataFrame, shards: int, value: Column | None = None) -> list[int]:
    """A number for each shard."""
    rows = df.groupBy("shard").agg((F.count("*") if value is None else F.sum(value)).alias("n")).collect()
    by = {r.shard: int(r.n) for r in rows}
    return [by.get(s, 0) for s in range(shards)]


def _ranked(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df with `rank`: from 0, gapless, within the rows of equal keys."""
    dealt = written(df.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "hub"), F.lit(buckets))), "buckets")
    before = F.sum("n").over(W.partitionBy(*keys).orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    # as many rows as keys times buckets
    offsets = written(dealt.groupBy(*keys, "bucket").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(before, F.lit(0))), "offsets")
    own = dealt.withColumn("own", F.row_number().over(W.partitionBy(*keys, "bucket").orderBy("doc_id", "hub")) - 1)
    return own.join(offsets.select(*keys, "bucket", "before"), [*keys, "bucket"]).withColumn("rank", F.col("before") + F.col("own")).drop("bucket", "before", "own")


def _deal_hot(hot: list, free: list[float]) -> tuple[Column, list[float]]:
    """The shard of a row of a hub too large for one shard, by the row's hash; and the places that are left."""
    out = F.lit(None).cast("int")
    for hub, n in hot:
        at, left, ends = 0.0, n, []
        while left > 1e-9:
            s = max(range(len(free)), key=lambda s: (free[s], -s))
            take = min(left, free[s]) if free[s] > 0 else left
            free[s] -= take
            left -= take
            at += take / n
            ends.append((at, s))
        chosen = F.lit(ends[-1][1])
        for end, s in reversed(ends[:-1]):
            chosen = F.when(F.col("u") < end, s).otherwise(chosen)
        out = F.when(F.col("hub") == hub, chosen).otherwise(out)
    return out, free


def propagate(linked: DataFrame, shards: int, quota: int, rounds: int = ROUNDS) -> DataFrame:
    """linked (hub, u, shard, ...) after the moves; quota: places of a shard for linked rows."""
    sizes = linked.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") * 2 > quota)
    # fewer than twice the shards
    hot = sorted(((r.hub, r.n) for r in sizes.collect()), key=lambda x: (-x[1], x[0]))
    cold = linked
    if hot:
        is_hot = F.col("hub").isin(*(h for h, _ in hot))
        cold = linked.where(~is_hot)
        # a hash deals parts of a hub with some spread, for which places stay free
        spread = 4 * quota**0.5
        chosen, rest = _deal_hot(hot, [max(1.0, quota - spread)] * shards)
        dealt = linked.where(is_hot).withColumn("shard", chosen)
        quotas = [max(0.0, x) + spread / 2 for x in rest]
    else:
        dealt, quotas = linked.limit(0), [float(quota)] * shards
    cold = written(cold, "labels")
    for r in range(rounds):
        load = _counts(cold, shards)
        free = [max(0.0, q - x) for q, x in zip(quotas, load)]
        cells = written(cold.groupBy("hub", "shard").agg(F.count("*").alias("c")), "cells")
        # a hub's own documents need no free place where they are: its largest cell may be in a full shard
        open_ = cells.where((_by_shard(free, "shard") > 0) | (F.col("c") > 1))
        best = open_.groupBy(F.col("hub").alias("h")).agg(F.max_by("shard", F.struct("c", _by_shard(free, "shard"), -F.col("shard"))).alias("target"))
        asks = written(cells.join(best, F.col("hub") == F.col("h")).where("shard <> target").select("hub", "shard", "target", "c"), "asks")
        asked = _counts(asks.select(F.col("target").alias("shard"), "c"), shards, F.col("c"))
        if not any(asked):
            break
        share = [min(1.0, 0.95 * f / a) if a else 1.0 for f, a in zip(free, asked)]
        moves = written(asks.where(_unit("hub", "shard", F.lit(r)) < _by_shard(share, "target")), "moves").select(F.col("hub").alias("h"), F.col("shard").alias("s"), "target")
        if not moves.limit(1).count():
            break
        moved = cold.join(moves, (F.col("hub") == F.col("h")) & (F.col("shard") == F.col("s")), "left")
        cold = written(moved.withColumn("shard", F.coalesce("target", "shard")).select(*cold.columns), "labels")
    return cold.unionByName(dealt)


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row; counts of shards differ by one at most, slots are gapless from 0."""
    text = whole_text(text_col)
    size = F.octet_length(text).cast("long") + 16
    crc = F.crc32(text.cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text, crc, size).alias("hub"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int")).withColumn("u", _unit("doc_id", F.lit(13)))
    rows = written(rows, "rows")
    n = rows.count()
    least, more = divmod(n, shards)
    quotas = [least + (s < more) for s in range(shards)]
    hubs = written(rows.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select(F.col("hub").alias("h")), "hubs")
    linked = rows.join(hubs, F.col("hub") == F.col("h"), "left_semi")
    alone = rows.join(hubs, F.col("hub") == F.col("h"), "left_anti")
    buckets = max(16, n // BUCKET // shards * 2)
    placed = _ranked(propagate(linked, shards, least) if least else linked, ["shard"], buckets)
    placed = written(placed, "placed")
    quota = _by_shard(quotas, "shard")
    stay = placed.where(F.col("rank") < quota).select("doc_id", "size", "text_crc32", "shard", F.col("rank").alias("slot"))
    pool = alone.unionByName(placed.where(F.col("rank") >= quota).select(*alone.columns))
    kept = _counts(stay, shards)
    rest = _ranked(pool.drop("shard").withColumn("all", F.lit(0)), ["all"], max(64, n // BUCKET))
    # intervals of the pool's ranks, one for each shard
    ends, upto = [], 0
    for s in range(shards):
        upto += quotas[s] - kept[s]
        ends.append(upto)
    to, slot = F.lit(shards - 1), F.col("rank") - (ends[-2] if shards > 1 else 0) + kept[-1]
    for s in reversed(range(shards - 1)):
        inside = F.col("rank") < ends[s]
        to = F.when(inside, s).otherwise(to)
        slot = F.when(inside, F.col("rank") - (ends[s - 1] if s else 0) + kept[s]).otherwise(slot)
    filled = rest.select("doc_id", "size", "text_crc32", to.cast("int").alias("shard"), slot.alias("slot"))
    return stay.unionByName(filled).withColumn("slot", F.col("slot").cast("long"))
