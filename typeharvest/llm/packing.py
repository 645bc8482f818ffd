"""Best-fit packing of documents into token sequences, by hierarchical residual packing.

Each partition tokenises its documents, cuts only those longer than a sequence, and packs the pieces best-fit, longest
first. Full bins are done; the others become items of the next round, in fewer partitions, where best-fit joins them to
fuller bins. Rounds go on until one partition of bounded size is left or a round joins nothing more. Each round is a
written table, so a lost executor repeats tasks of one round only. Texts are never shuffled; a bin that goes on carries
its pieces, of which a sequence has no more than its capacity.

Null text: empty (one end token). Null and repeated ids: each row is packed. An empty table: no rows. Other columns are
ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenization
from .common import scratch, ship, whole_text

CAPACITY = 2048
#: Partitions whose underfull bins meet in one of the next round, and the most bins that one task packs.
FAN_IN, TASK_BINS = 8, 200_000
#: Bins with at most this share of free places are nearly full; only the last round gives out others.
NEARLY = 0.002
_PIECE = "struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint, ids: binary>"
_BINS = f"sequence_id long, done boolean, size long, members array<{_PIECE}>"


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item numbers: longest item first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has r free places
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        if room > size:
            by_room[room - size].append(k)
            rooms |= 1 << (room - size)
    return bins


def _bins_of(sizes: list[int], members: list[list[dict]], capacity: int, level: int, last: bool) -> Iterator[pa.RecordBatch]:
    part, rows = TaskContext.get().partitionId(), []
    schema = pa.schema([("sequence_id", pa.int64()), ("done", pa.bool_()), ("size", pa.int64()), ("members", pa.list_(pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])))])
    least = capacity - math.floor(capacity * NEARLY)
    for k, found in enumerate(best_fit(np.array(sizes, dtype=np.int64), capacity)):
        size = sum(sizes[i] for i in found)
        rows.append({"sequence_id": (level << 56) | (part << 32) | k, "done": last or size >= least, "size": size, "members": [m for i in found for m in members[i]]})
        if len(rows) == 2000:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows = []
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset) of each piece; ids: its tokens as little-endian unsigned 32-bit numbers, null unless with_ids."""
    spark = docs.sparkSession
    ship(spark)
    end = end_id.to_bytes(4, "little")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = tokenization.load(tokenizer).packed
        sizes, members = [], []
        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                ids = packed(text.as_py()) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    sizes.append(len(own) // 4)
                    members.append([{"doc_id": doc_id, "piece": piece, "start": at // 4, "length": len(own) // 4, "ids_crc32": zlib.crc32(own), "ids": own if with_ids else None}])
        yield from _bins_of(sizes, members, capacity, 0, False)

    def again(level: int, last: bool):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sizes, members = [], []
            for b in batches:
                sizes += b.column("size").to_pylist()
                members += b.column("members").to_pylist()
            yield from _bins_of(sizes, members, capacity, level, last)

        return merge

    def stored(df: DataFrame, level: int) -> DataFrame:
        path = scratch(spark, f"bins-{level}")
        df.write.parquet(path)
        return spark.read.schema(_BINS).parquet(path)

    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    table = stored(pieces.mapInArrow(local, _BINS), 0)
    finished, level = [table.where("done")], 0
    parts = max(1, pieces.rdd.getNumPartitions())
    left = table.where("NOT done").count()
    while left:
        level += 1
        parts = max(math.ceil(left / TASK_BINS), parts // FAN_IN, 1)
        under = table.where("NOT done").select("size", "members")
        first = F.col("members")[0]
        # short bins are spread evenly; bins are small rows, and their number falls from round to round
        dealt = under.repartition(1) if parts == 1 else under.repartition(parts, F.xxhash64(first["doc_id"], first["piece"], F.lit(level)))
        table = stored(dealt.mapInArrow(again(level, parts == 1), _BINS), level)
        finished.append(table.where("done"))
        rest = table.where("NOT done").count()
        if rest and rest > 0.99 * left and level > 3:  # nothing joins any more, and the rest is too much for one task
            finished.append(table.where("NOT done"))
            break
        left = rest
    bins = finished[0]
    for df in finished[1:]:
        bins = bins.unionByName(df)
    placed = bins.select("sequence_id", F.explode(F.expr("transform(members, (m, i) -> named_struct('m', m, 'offset', aggregate(slice(members, 1, i), 0L, (a, x) -> a + x.length)))")).alias("p"))
    return placed.select(*(F.col(f"p.m.{c}").alias(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32", "ids")), "sequence_id", F.col("p.offset").alias("offset"))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids) of pieces that carry their ids: the pieces of a sequence joined in order."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.expr("aggregate(parts, X'', (a, p) -> a || p.ids)").alias("ids"))
