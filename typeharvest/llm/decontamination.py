"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping segments of two lengths: the long ones bear more edits, the short ones lie so close
that every excerpt of SURE bytes of an item holds a whole one. A shorter item is one segment. A place that holds a segment of m characters with at most k edits shares
at least m + 1 - q (k + 1) of its q-grams, all on diagonals that lie within k of each other. So shared q-grams are counted
in overlapping bands of diagonals; bands that reach the bound are verified by banded alignment. Documents are mapped where
they lie: nothing of them shuffles. Segments go to the tasks in blocks of BLOCK characters at most, one pass over the
documents for each; a benchmark of any size is compared whole.

Text is lower-cased and runs of white space are one space; characters are its UTF-8 bytes. Items shorter than LEAST bytes
(four or five words) are not looked for: they are met by chance. Null text, on either side: empty. Null and repeated ids: kept, each row is compared.
An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship

Q, LEAST, EDITS = 8, 24, 0.08
#: Lengths of segments and how far apart they start.
CUTS = ((120, 60), (48, 12))
SEGMENT = max(size for size, _ in CUTS)
#: Least bytes of an excerpt that surely holds a whole segment.
SURE = min(size + stride - 1 for size, stride in CUTS)
#: Most characters of segments that a pass sends to its tasks.
BLOCK = 4 << 20
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BITS = 20


def normalised(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode("utf-8", "replace")


def segments_of(text: str | None) -> list[tuple[int, bytes]]:
    """(start, segment) of an item; the last one of each length ends where the item ends."""
    whole = normalised(text)
    if len(whole) < LEAST:
        return []
    found = set()
    for size, stride in CUTS:
        last = max(0, len(whole) - size)
        found |= {(at, whole[at : at + size]) for at in (*range(0, last, stride), last)}
    return sorted(found)


def _grams(data: bytes) -> np.ndarray:
    """The q-grams by their start, as numbers."""
    n = len(data) - Q + 1
    return np.ndarray((n,), dtype="<u8", buffer=data, strides=(1,)) if n > 0 else np.empty(0, dtype=np.uint64)


def align(segment: bytes, region: bytes, most: int, low: int, high: int) -> tuple[int, int] | None:
    """(edits, end in region) of the best place of the segment in the region whose alignment stays on diagonals low to high; None beyond `most` edits."""
    at = region.find(segment)
    if at >= 0:
        return 0, at + len(segment)
    width = high - low + 1
    text = np.frombuffer(region, dtype=np.uint8)
    big, shift = len(segment) + width, np.arange(width)
    # row i, place d: the least edits of segment[:i] ending at region[:i + low + d]
    row = np.where((low + shift >= 0) & (low + shift <= len(text)), 0, big)
    for i, c in enumerate(segment, 1):
        end = i + low + shift
        inside = (end >= 1) & (end <= len(text))
        diagonal = np.where(inside, row + (text[np.clip(end - 1, 0, len(text) - 1)] != c), big)
        above = np.append(row[1:], big) + 1
        best = np.where((end >= 0) & (end <= len(text)), np.minimum(diagonal, above), big)
        row = np.minimum.accumulate(best - shift) + shift
        if row.min() > most:
            return None
    d = int(row.argmin())
    return int(row[d]), len(segment) + low + d


class Index:
    """The q-grams of a block of segments."""

    def __init__(self, segments: list[bytes]) -> None:
        self.segments = segments
        self.sizes = np.array([len(s) for s in segments], dtype=np.int64)
        self.most = np.minimum(np.floor(self.sizes * EDITS), (self.sizes - Q) // Q).astype(np.int64)
        self.bound = self.sizes + 1 - Q * (self.most + 1)
        grams = np.concatenate([_grams(s) for s in segments])
        owner = np.repeat(np.arange(len(segments)), self.sizes - Q + 1)
        place = np.concatenate([np.arange(n - Q + 1) for n in self.sizes])
        order = np.argsort(grams, kind="stable")
        self.owner, self.place = owner[order], place[order]
        self.grams, self.first = np.unique(grams[order], return_index=True)
        self.counts = np.diff(np.append(self.first, len(grams)))
        self.known = np.zeros(1 << _BITS, dtype=bool)
        self.known[(self.grams * _MULTIPLIER) >> np.uint64(64 - _BITS)] = True
        self.step = 1 << max(3, int(self.most.max()).bit_length())  # bands start a step apart and overlap by the largest budget

    def find(self, data: bytes) -> list[tuple[int, int, int, int]]:
        """(segment, edits, start, end) of each verified place in the normalised text."""
        grams = _grams(data)
        at = np.flatnonzero(self.known[(grams * _MULTIPLIER) >> np.uint64(64 - _BITS)])
        if len(at) == 0:
            return []
        k = np.searchsorted(self.grams, grams[at])
        k[k == len(self.grams)] = 0
        hit = self.grams[k] == grams[at]
        at, k = at[hit], k[hit]
        n = self.counts[k]
        if len(at) < 4:
            return []
        post = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        owner, place, spot = self.owner[post], self.place[post], np.repeat(at, n)
        shift = spot - place
        band = shift // self.step
        over = shift - band * self.step < self.most.max()
        owner, band, place = (np.concatenate([x, y[over]]) for x, y in ((owner, owner), (band, band - 1), (place, place)))
        # a q-gram of the segment counts once in a band
        bands = len(data) // self.step + SEGMENT // self.step + 4
        cell = owner * bands + band + SEGMENT // self.step + 2
        cells, counts = np.unique(cell, return_counts=True)
        own = cells // bands
        full = counts >= self.bound[own]
        if full.any():
            keys = np.unique(cell[np.isin(cell, cells[full])] * SEGMENT + place[np.isin(cell, cells[full])])
            cells, counts = np.unique(keys // SEGMENT, return_counts=True)
            own = cells // bands
            full = counts >= self.bound[own]
        found, seen = [], set()
        for c, s in zip(cells[full].tolist(), own[full].tolist()):
            low = (c % bands - SEGMENT // self.step - 2) * self.step
            most, segment = int(self.most[s]), self.segments[s]
            begin = max(0, low - most)
            region = data[begin : low + self.step + 2 * most + len(segment)]
            place_found = align(segment, region, most, low - most - begin, low + self.step + 2 * most - begin)
            if place_found:
                edits, end = place_found
                if (s, begin + end) not in seen:
                    seen.add((s, begin + end))
                    found.append((s, edits, max(0, begin + end - len(segment)), begin + end))
        return found


def segments(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, start, segment) of all items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, at, s) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()) for at, s in segments_of(t)]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], names=["item_id", "start", "segment"])

    return benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, "item_id long, start long, segment binary")


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, list, list]]:
    """Item ids, starts and bytes of the benchmark's segments, at most about BLOCK characters at a time."""
    cut = segments(benchmark)
    size = cut.agg(F.sum(F.length("segment"))).first()[0] or 0
    blocks = math.ceil(size / BLOCK)
    for k in range(blocks):
        rows = cut.where(F.pmod(F.xxhash64("item_id", "start", "segment"), F.lit(blocks)) == k).collect()
        if rows:
            yield [r.item_id for r in rows], [r.start for r in rows], [bytes(r.segment) for r in rows]


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, item_start, edits, start, end) of each place that holds a segment; places in normalised characters."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, item_id long, item_start long, edits int, start long, end long"
    out = spark.createDataFrame([], schema)
    for items, starts, texts in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], items=items, starts=starts, texts=texts) -> Iterator[pa.RecordBatch]:
            index = Index(texts)
            for b in batches:
                found = [(i, *m) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text")) for m in index.find(normalised(t.as_py()))]
                yield pa.record_batch([
                    pa.array([f[0] for f in found], pa.int64()), pa.array([items[f[1]] for f in found], pa.int64()), pa.array([starts[f[1]] for f in found], pa.int64()),
                    pa.array([f[2] for f in found], pa.int32()), pa.array([f[3] for f in found], pa.int64()), pa.array([f[4] for f in found], pa.int64())],
                    names=["doc_id", "item_id", "item_start", "edits", "start", "end"])

        out = out.unionByName(own.mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs (text, ...) that hold no segment of the benchmark, as they are."""
    ship(docs.sparkSession)
    for _, _, texts in _blocks(benchmark):

        def run(batches: Iterator[pa.RecordBatch], texts=texts) -> Iterator[pa.RecordBatch]:
            index = Index(texts)
            for b in batches:
                yield b.filter(pa.array([not index.find(normalised(t.as_py())) for t in b.column("text")], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, n_segments, edits, start, end): each document and the item that it holds, with the matched segments' number, edits and outer places."""
    return matches(docs, benchmark, id_col, text_col).groupBy("doc_id", "item_id").agg(
        F.count_distinct("item_start").alias("n_segments"), F.sum("edits").cast("int").alias("edits"), F.min("start").alias("start"), F.max("end").alias("end"))
