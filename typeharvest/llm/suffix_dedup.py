"""Removal of repeated substrings, by sorting sampled suffixes and naming them.

Every string of LENGTH bytes is judged: it goes if it also starts earlier. As in a difference-cover suffix sort, only a
sample of positions is sorted and named, such that equal strings are sampled at equal places, and the other positions are
settled from the sampled names. The sample is taken by content (a synchronising set: the least hash of the K-grams in each
window) in place of fixed residues, since residues keep a seventh of all positions or more and content a thirty-fifth.

1. A sampled position's first name is its K-gram, its second the whole stretch of strings that it stands for. Positions are
   sorted by both names. Stretches equal to an earlier one go whole.
2. Where stretches of one K-gram differ, the first of each kind go on with their bytes: all their strings are sorted, and
   adjacent equal ones compared by place.
3. Removed strings are joined to spans by document.

K-grams that are very frequent (found from bucket counts) take the same steps with each kind dealt by salt, and their
stretches in parts, so no task holds a hot one; the others are sorted in shuffled partitions. Texts shuffle twice, for step 2 and for
the remaining bytes; shuffle files go after each step.

Null text: empty. Null ids come first. Rows that repeat id and text are one document and each gets its result; rows of one
id with other texts are documents in the order of their texts' hashes. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import RollingHash, mix, n_partitions, ship, whole_text, written

LENGTH, K = 100, 24
#: Strings in a part of a hot K-gram's stretch.
CELL = 6
#: Bytes of a text that are hashed at once; positions fit into as many low bits as it has.
CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)
#: A bucket of K-grams is hot from so many rows on and so many times the mean; rows and bytes that a task sorts, about.
HOT_ROWS, HOT_TIMES, TASK_ROWS, TASK_BYTES = 2_000, 16, 2_000_000, 48 << 20


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (leftmost of equals) in each window."""
    keyed = (values & ~_LOW) | np.arange(len(values), dtype=np.uint64)
    size = 1
    while size * 2 <= width:
        keyed = np.minimum(keyed[:-size], keyed[size:])
        size *= 2
    if size < width:
        keyed = np.minimum(keyed[: len(keyed) - (width - size)], keyed[width - size :])
    return (keyed & _LOW).astype(np.int64)


def stretches(data: bytes, length: int = LENGTH, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """K-gram name, stretch name, first string's start and number of strings of each sampled position."""
    out = []
    for at in range(0, max(0, len(data) - length + 1), CHUNK):
        part = RollingHash(data[at : at + CHUNK + length - 1])
        names = mix(part.windows(k))
        place = _least(names, length - k + 1)
        cut = np.flatnonzero(np.diff(place)) + 1
        first, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]])
        out.append((names[place[first]], mix(part.spans(first, end - 1 + length)), first + at, end - first))
    if not out:
        return (np.empty(0, np.uint64),) * 2 + (np.empty(0, np.int64),) * 2
    return tuple(np.concatenate(x) for x in zip(*out))


def _sampled(texts: DataFrame, length: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, found, size = [], [], 0
            for doc, t in zip(b.column("doc").to_pylist(), b.column("text")):
                s = stretches(t.as_py().encode(), length)
                docs.append(np.full(len(s[0]), doc, dtype=np.int64))
                found.append(s)
                size += len(s[0])
                if size > 100_000:
                    yield batch(docs, found)
                    docs, found, size = [], [], 0
            if size:
                yield batch(docs, found)

    def batch(docs: list, found: list) -> pa.RecordBatch:
        gram, name, start, n = (np.concatenate(x) for x in zip(*found))
        return pa.record_batch([pa.array(gram.view(np.int64)), pa.array(name.view(np.int64)), pa.array(np.concatenate(docs)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["gram", "name", "doc", "start", "n"])

    return texts.mapInArrow(run, "gram long, name long, doc long, start int, n int")


def _by_kind(rows: DataFrame, keys: list[str], salts: int) -> tuple[DataFrame, DataFrame]:
    """Rows that are not the first (by doc, start) of their keys, and the first ones. A kind of any size is dealt by salt; only the first rows of each salt are compared across salts."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc", "start"), F.lit(salts)))
    place = [F.col("doc"), F.col("start")]
    dealt = written(salted.withColumn("place", F.row_number().over(W.partitionBy(*keys, "salt").orderBy(*place))), "dealt")
    heads = dealt.where("place = 1").withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(*place)))
    heads = written(heads, "heads")
    return dealt.where("place > 1").unionByName(heads.where("place > 1")), heads.where("place = 1")


def _named(sampled: DataFrame) -> DataFrame:
    """(gram, doc, start, n, later, open, hot) of sampled positions with company: later than an equal stretch, or first of its kind beside others."""
    spark = sampled.sparkSession
    total = sampled.count()
    buckets = 1 << min(22, max(16, (total >> 14).bit_length()))
    bucket = F.pmod("gram", F.lit(buckets))
    counts = sampled.groupBy(bucket.alias("hot_bucket")).agg(F.count("*").alias("rows"))
    # at most one bucket in HOT_TIMES: a bounded broadcast
    hot = F.broadcast(written(counts.where(F.col("rows") > max(HOT_ROWS, HOT_TIMES * total // buckets)).select("hot_bucket"), "hot-buckets"))
    parts = max(n_partitions(spark), math.ceil(total / TASK_ROWS))
    # hot K-grams are dealt by salt, the others have the salt -1
    salt = F.when(F.col("hot_bucket").isNotNull(), F.pmod(F.xxhash64("doc", "start"), F.lit(parts))).otherwise(-1).cast("int")
    own = sampled.join(hot, bucket == F.col("hot_bucket"), "left").select("gram", "name", "doc", "start", "n", salt.alias("salt"))
    group, kind, place = W.partitionBy("gram", "salt"), W.partitionBy("gram", "salt", "name"), [F.col("doc"), F.col("start")]
    dealt = own.repartition(parts, "gram", "salt").select("*", F.min("name").over(group).alias("lo"), F.max("name").over(group).alias("hi"), F.count("*").over(group).alias("c"))
    dealt = dealt.where("c > 1 OR salt >= 0").withColumn("place", F.row_number().over(kind.orderBy(*place)))
    dealt = written(dealt.where("place > 1 OR lo <> hi OR salt >= 0").drop("lo", "hi", "c"), "dealt")
    heads = dealt.where("place = 1 AND salt >= 0").withColumn("place", F.row_number().over(W.partitionBy("gram", "name").orderBy(*place)))
    heads = written(heads, "heads")
    kinds = heads.where("place = 1")
    several = kinds.groupBy("gram").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select(F.col("gram").alias("g"))
    later = dealt.where("place > 1").unionByName(heads.where("place > 1"))
    opened = dealt.where("place = 1 AND salt < 0").unionByName(kinds.join(several, F.col("gram") == F.col("g"), "left_semi"))
    columns = ["gram", "doc", "start", "n", (F.col("salt") >= 0).alias("hot")]
    later = later.select(*columns).withColumns({"later": F.lit(True), "open": F.lit(False)})
    return later.unionByName(opened.select(*columns).withColumns({"later": F.lit(False), "open": F.lit(True)}))


def _cells(data: RollingHash, start: int, n: int, length: int) -> Iterator[tuple[int, int, int, int, list[int]]]:
    """(core, name, start, n, names of the strings) of each part of a stretch of a hot K-gram. Parts are cut at fixed distances from the K-gram, so equal strings lie in parts that share their core, the bytes that all strings of a whole part have in common."""
    grams = np.arange(start, start + length - K + 1)
    gram = start + int(_least(mix(data.spans(grams, grams + K)), length - K + 1)[0])
    at = start
    while at < start + n:
        low = gram - -(-(gram - at) // CELL) * CELL
        end = min(low + CELL, start + n)
        places = np.arange(at, end)
        ends = np.array([[low + CELL - 1, at], [low + length, end - 1 + length]])
        core, name = mix(data.spans(ends[0], ends[1])).view(np.int64).tolist()
        yield core, name, at, end - at, mix(data.spans(places, places + length)).view(np.int64).tolist()
        at = end


def _strings(texts: DataFrame, opened: DataFrame, length: int) -> DataFrame:
    """Bytes of each open stretch (rare K-grams), or its parts (hot ones)."""
    wanted = opened.groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("gram", "start", "n", "hot")).alias("wanted"))
    schema = "gram long, core long, name long, doc long, start int, n int, names array<long>, bytes binary"
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    columns = ["gram", "core", "name", "doc", "start", "n", "names", "bytes"]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names=columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for doc, t, wanted in zip(b.column("doc").to_pylist(), b.column("text"), b.column("wanted").to_pylist()):
                data = t.as_py().encode()
                hashed = RollingHash(data) if any(w["hot"] for w in wanted) else None
                for w in wanted:
                    gram, start, n = w["gram"], w["start"], w["n"]
                    if w["hot"]:
                        rows += [(gram, core, name, doc, at, m, names, None) for core, name, at, m, names in _cells(hashed, start, n, length)]
                    else:
                        rows.append((gram, None, None, doc, start, n, None, data[start : start + n - 1 + length]))
                if len(rows) > 50_000:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    return texts.join(wanted, F.col("doc") == F.col("d")).select("doc", "text", "wanted").mapInArrow(run, schema)


def _later_hot(cells: DataFrame) -> DataFrame:
    """(doc, start, n) of strings of hot K-grams that also start earlier: whole parts by their names, then single strings of parts that share a core only."""
    parts = n_partitions(cells.sparkSession)
    whole, kinds = _by_kind(cells, ["gram", "core", "name"], parts)
    shared = kinds.groupBy("gram", "core").agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo <> hi").select(F.col("gram").alias("g"), F.col("core").alias("k"))
    apart = kinds.join(shared, (F.col("gram") == F.col("g")) & (F.col("core") == F.col("k")), "left_semi")
    single = apart.select("gram", "doc", "start", F.posexplode("names").alias("i", "name")).select("gram", "name", "doc", (F.col("start") + F.col("i")).alias("start"))
    later, _ = _by_kind(single, ["gram", "name"], parts)
    return whole.select("doc", "start", "n").unionByName(later.select("doc", "start", F.lit(1).alias("n")))


def _later_strings(strings: DataFrame, length: int) -> DataFrame:
    """(doc, start, n): runs of strings that also start earlier."""
    rare = strings.where("bytes IS NOT NULL").select("gram", "doc", "start", "n", "bytes")
    size = rare.agg(F.sum(F.length("bytes"))).first()[0] or 0
    parts = max(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / TASK_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        n, data = table.column("n").to_numpy(), b"".join(table.column("bytes").to_pylist())
        sizes = n.astype(np.int64) - 1 + length
        base, row = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(n)), n)
        step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        names = RollingHash(data).windows(length)[base[row] + step]
        names = mix(names ^ mix(table.column("gram").to_numpy().view(np.uint64))[row])
        doc, start = table.column("doc").to_numpy()[row], table.column("start").to_numpy()[row] + step
        order = np.lexsort((start, doc, names))
        names, doc, start = names[order], doc[order], start[order]
        later = np.flatnonzero(names[1:] == names[:-1]) + 1  # each but the first of equal neighbours
        doc, start = doc[later], start[later]
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(start) != 1)) + 1
        first, end = np.concatenate([[0], cut]).astype(int), np.concatenate([cut, [len(doc)]]).astype(int)
        if len(doc):
            yield pa.record_batch([pa.array(doc[first]), pa.array(start[first].astype(np.int32)), pa.array((end - first).astype(np.int32))], names=["doc", "start", "n"])

    cold = rare.repartition(parts, "gram").mapInArrow(run, "doc long, start int, n int")
    return cold.unionByName(_later_hot(strings.where("bytes IS NULL").drop("bytes")))


def repeated(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc, start, n): runs of n strings from `start` that each also start earlier; texts: (doc, text), in the order of doc, each once."""
    ship(texts.sparkSession)
    named = _named(written(_sampled(texts, length), "sampled"))
    strings = written(_strings(texts, named.where("open").select("gram", "doc", "start", "n", "hot"), length), "strings")
    return written(named.where("later").select("doc", "start", "n").unionByName(_later_strings(strings, length)), "repeated")


def remove(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of each row; kept: the remaining bytes, null unless with_text."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    plain = not rows.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").limit(1).count()
    if plain:
        texts = rows.select(F.col("doc_id").alias("doc"), "text")
        again = rows.withColumn("doc", F.col("doc_id"))
    else:
        # a sorted table's running numbers keep its order
        once = rows.distinct().orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text").withColumn("doc", F.monotonically_increasing_id())
        once = written(once, "ordered")
        texts = once.select("doc", "text")
        key = once.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h"), F.crc32(F.col("text").cast("binary")).alias("c"), "doc")
        again = rows.join(key, rows.doc_id.eqNullSafe(F.col("i")) & (F.xxhash64(rows.text) == F.col("h")) & (F.crc32(rows.text.cast("binary")) == F.col("c"))).select("doc_id", "text", "doc")
    spans = repeated(texts, length).groupBy(F.col("doc").alias("d")).agg(F.collect_list(F.struct("start", (F.col("start") + F.col("n") - 1 + length).alias("end"))).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for t, spans in zip(b.column("text"), b.column("spans").to_pylist()):
                data = t.as_py().encode()
                kept, at, removed, n = [], 0, 0, 0
                for start, end in sorted((s["start"], s["end"]) for s in spans or ()):
                    if start > at or n == 0:
                        kept.append(data[at:start])
                        n += 1
                        removed += end - start
                        at = end
                    elif end > at:
                        removed += end - at
                        at = end
                rest = b"".join([*kept, data[at:]])
                found.append((len(data), removed, n, hashlib.sha256(rest).hexdigest(), rest if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.record_batch([b.column("doc_id"), *(pa.array([f[i] for f in found], k) for i, k in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    joined = again.join(spans, F.col("doc") == F.col("d"), "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
