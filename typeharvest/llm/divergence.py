"""Divergence of sources within their language, by run-length columns.

Each kept term of a language has one count for each source. Terms with the same counts in all sources are one row with a
length; rows are dealt into chunks by their counts and ordered there by them, the largest source first, so that equal counts
lie together. In a chunk each source is a column of runs (where its count changes, and that count). For a pair of sources the
boundaries of both columns are merged: between two of them neither count changes, so f is worked out once and multiplied by
the number of terms there. Chunks are summed by pair. Single terms, which the report names, come from the same rows.

All arithmetic is on whole numbers. Texts are tokenised once; tasks add up before the shuffle, so neither a frequent term nor a
source with a third of all rows is one task. A row holds as many counts as its language has sources; sources are compared in
blocks of SOURCES, since a pair is a row of the result anyhow.

Null text, lang or source: ''. A source without any kept term has count 0 throughout. Each row of docs is a document, repeated
ids too. An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import n_partitions, segments, ship, whole_text, written

LEAST_DOCS, FIRST, UNIT = 10, 10, 1_000_000_000
#: Entries that a task adds up before it passes them on; rows of a chunk, at most and where there are few; sources of a block.
HELD, ROWS, FEW, SOURCES = 200_000, 8192, 512, 256
#: Most groups whose totals are broadcast; beyond that they are joined.
BROADCAST = 100_000

#: ASCII letters in lower case and all other bytes from 0x80 on are themselves, the rest separates.
_LETTERS = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def _counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of each task; the term '' stands for the group itself."""

    def rows(held: dict[tuple, tuple[Counter, Counter]]) -> pa.RecordBatch:
        out = [(lang, source, term, n, seen[term]) for (lang, source), (total, seen) in held.items() for term, n in total.items()]
        columns = list(zip(*out))
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()))], names=["lang", "source", "term", "n", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                if (lang, source) not in held:
                    held[lang, source] = Counter({b"": 0}), Counter()
                    size += 1
                total, seen = held[lang, source]
                before = len(total)
                own: set[bytes] = set()
                for part in segments(text.as_py().translate(_LETTERS)):
                    words = part.split()
                    total.update(words)
                    own.update(words)
                seen.update(own)
                size += len(total) - before
                if size > HELD:
                    yield rows(held)
                    held, size = {}, 0
        if held:
            yield rows(held)

    return docs.mapInArrow(run, "lang string, source string, term binary, n long, docs long")


def shares(counts: np.ndarray, all_: int) -> np.ndarray:
    """p = 1 + floor(UNIT * (count + 2) / all) of each count."""
    own, at = np.unique(counts, return_inverse=True)
    return np.array([1 + UNIT * (c + 2) // all_ for c in own.tolist()], np.int64)[at]


def runs(column: np.ndarray) -> np.ndarray:
    """The places where a run of equal counts begins."""
    return np.concatenate([[0], np.flatnonzero(np.diff(column)) + 1])


def diverged(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """f of each two shares; below 2**31, so their squares are whole 64-bit numbers."""
    return (p - q) ** 2 // (p + q)


def pair_values(counts: np.ndarray, lengths: np.ndarray, alls: list[int], pairs: list[tuple[int, int]]) -> list[int]:
    """The sum of f over the terms of a chunk for each pair of columns; counts: rows by columns, one row for lengths[row] terms."""
    heavy = np.argsort(-counts.sum(axis=0), kind="stable")
    order = np.lexsort(counts[:, heavy[::-1]].T)
    counts = counts[order]
    before = np.concatenate([[0], np.cumsum(lengths[order])])  # terms before each row
    starts = [runs(counts[:, c]) for c in range(counts.shape[1])]
    share = [shares(counts[starts[c], c], alls[c]) for c in range(counts.shape[1])]
    out = []
    for i, j in pairs:
        cuts = np.union1d(starts[i], starts[j])
        p = share[i][np.searchsorted(starts[i], cuts, side="right") - 1]
        q = share[j][np.searchsorted(starts[j], cuts, side="right") - 1]
        terms = before[np.concatenate([cuts[1:], [len(counts)]])] - before[cuts]
        out.append(int((diverged(p, q) * terms).sum()))
    return out


def _pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of each two sources of a language."""
    spark = kept.sparkSession
    rows = written(kept.groupBy("lang", "counts").agg(F.count("*").alias("length")), "runs")
    n = rows.count()
    widest = groups.groupBy("lang").count().agg(F.max("count")).first()[0] or 1
    chunks, blocks = max(1, math.ceil(n / ROWS), min(n_partitions(spark), math.ceil(n / FEW))), math.ceil(widest / SOURCES)

    def block_of(source: Column) -> Column:
        return F.pmod(F.xxhash64(source), F.lit(blocks)).cast("int")

    both = F.explode(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: F.transform(F.sequence(i, F.lit(blocks - 1)), lambda j: F.struct(i.alias("i"), j.alias("j")))))).alias("ij")
    left = rows.select("lang", "counts", "length", both).select("lang", "length", F.col("ij.i").alias("i"), F.col("ij.j").alias("j"), F.filter("counts", lambda c: block_of(c.source).isin(F.col("ij.i"), F.col("ij.j"))).alias("counts"))
    left = left.withColumn("chunk", F.pmod(F.xxhash64("counts"), F.lit(chunks)).cast("int"))
    if blocks > 1:  # rows that differ in other blocks only
        left = left.groupBy("lang", "chunk", "i", "j", "counts").agg(F.sum("length").alias("length"))
    right = groups.select("lang", "source", "all", block_of(F.col("source")).alias("own"), both).where("own IN (ij.i, ij.j)")
    right = right.select("lang", "source", "all", "own", "ij.i", "ij.j", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"))

    def chunk(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
        lang, nth, i, j = (k.as_py() for k in key)
        names, alls, own = (sources.column(c).to_pylist() for c in ("source", "all", "own"))
        pairs = [(s, t) for s in range(len(names)) for t in range(s + 1, len(names)) if i == j or own[s] != own[t]]
        values = [0] * len(pairs)
        if terms.num_rows and pairs:
            lists = terms.column("counts").combine_chunks()
            lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
            entry, place = lists.flatten(), {s: k for k, s in enumerate(names)}
            counts = np.zeros((terms.num_rows, len(names)), np.int64)
            column = np.array([place[s] for s in entry.field("source").to_pylist()], np.int64)
            counts[np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), column] = entry.field("n").to_numpy()
            values = pair_values(counts, terms.column("length").to_numpy(), alls, pairs)
        elif nth:  # chunk 0 speaks for pairs without terms
            pairs, values = [], []
        return pa.table([pa.array([lang] * len(pairs), pa.string()), pa.array([names[s] for s, _ in pairs], pa.string()), pa.array([names[t] for _, t in pairs], pa.string()), pa.array(values, pa.int64())], names=["lang", "source", "item", "value"])

    keys = "lang", "chunk", "i", "j"
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(chunk, "lang string, source string, item string, value long")
    total = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    return total.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("r"), "value").select("lang", "r.source", "r.item", "value")


def _terms(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source uses more than its language."""
    single = kept.select("lang", F.col("term").alias("item"), F.col("n").alias("in_lang"), F.explode("counts").alias("c")).select("lang", "c.source", "item", "in_lang", "c.n")
    totals = groups.where("terms > 0").select("lang", "source", "all", "lang_all")
    joined = single.join(F.broadcast(totals) if totals.count() <= BROADCAST else totals, ["lang", "source"])

    def share(count: str, all_: str) -> Column:
        return F.expr(f"1 + CAST({UNIT} AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0)) div CAST({all_} AS DECIMAL(20,0))")

    both = joined.select("lang", "source", "item", share("n", "all").alias("p"), share("in_lang", "lang_all").alias("q")).where("p > q")
    return both.select("lang", "source", "item", F.expr("(p - q) * (p - q) div (p + q)").alias("value"))


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, first: int = FIRST) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language in docs (text, lang, source), its divergence from each other one (`pair`) and the `first` terms that it uses most beyond the language's share (`term`)."""
    ship(docs.sparkSession)
    texts = docs.select(whole_text("lang").alias("lang"), whole_text("source").alias("source"), whole_text().cast("binary").alias("text"))
    counted = _counted(texts).groupBy("lang", "source", F.col("term").cast("string").alias("term")).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    counted = written(counted, "term_counts")
    kept = counted.where("term <> ''").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.sort_array(F.collect_list(F.struct("source", "n"))).alias("counts"))
    kept = written(kept.where(F.col("docs") >= least_docs).drop("docs"), "kept_terms")
    in_group = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("in_group"))
    in_lang = kept.groupBy("lang").agg(F.sum("n").alias("in_lang"), F.count("*").alias("terms"))
    groups = counted.where("term = ''").select("lang", "source").join(in_group, ["lang", "source"], "left").join(in_lang, "lang", "left").na.fill(0)
    groups = written(groups.select("lang", "source", "terms", (F.col("in_group") + 2 * F.col("terms")).alias("all"), (F.col("in_lang") + 2 * F.col("terms")).alias("lang_all")), "groups")
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = _pairs(kept, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    terms = _terms(kept, groups).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank.alias("rank")).where(F.col("rank") <= first)
    return pairs.unionByName(terms)
