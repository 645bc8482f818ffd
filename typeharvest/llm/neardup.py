"""Near-duplicates by a chosen-path set similarity join.

Documents are sets of word shingles. Equal sets are one item, whatever their number. In each of several independent trees an
item goes down the branches of selected minwise tokens: a node's items share the tokens on its path. Nodes of one item are
dropped. A node of up to LARGE items is one group of a task, which goes on branching there: each step takes one more minwise
token, or two, so that a similar pair is expected to stay together in more than one child. Nodes of up to SMALL items are
compared exhaustively, by one product of their items' low hashes. Larger nodes branch on by joins of written tables.

Before a large node branches, its items are compared with the few that lie nearest to its middle: that settles a group of near
copies by its middle, not by its pairs. Only links that join two parts of a node are passed on, the most similar first, so a
node gives fewer links than it has items; parts whose items are all linked are not looked at again. The low hashes of an item
are its whole set, if that has no more than LOW, and a sample otherwise. Links are confirmed on the full sets. Where one fails,
the node is gone through again for all pairs that are still open. Links are joined to components; the first FIRST trees go
before, and a node whose items are all in one component needs no further work.

The only pairs that can be missed are those that separate in every tree, or whose low hashes differ far more than their sets.
plan() takes so many trees that, by the branch rule and the spread of the tokens, it is at most MISSED of the pairs at the least
similarity, though their nodes stay large down to DEPTH. Nodes that stay larger than LARGE even there are compared chunk by chunk.

Neither items nor links reach the driver. Spent tables are deleted.

Null or empty text: no shingles, linked with nothing. Null ids: component null, kept. Rows of one id count as one document
(linked with all that any of them is linked with). An empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce
from math import lgamma

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import RollingHash, discard, mix, n_partitions, ship, unused, whole_text, written

WORDS, DEPTH = 5, 7
#: Share of the pairs at the least similarity that may be missed.
MISSED = 1e-4
#: Trees of the first batch; what it links need not be compared in the others.
FIRST = 3
#: Minwise tokens and low hashes of an item, share of nodes with two branches.
TOKENS, LOW, TWO = 96, 256, 0.7
#: Most items of a node that is compared exhaustively, and of one that is a task's; items in its middle that all are compared with.
SMALL, LARGE, HUBS = 256, 4096, 8

_RNG = np.random.Generator(np.random.PCG64(977))
_FACTORS = _RNG.integers(1, 2**31, TOKENS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_MASKS = _RNG.integers(0, 2**32, TOKENS, dtype=np.uint32)


def _binomial(n: int, p: float) -> np.ndarray:
    k = np.arange(n + 1)
    ways = np.array([lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) for i in k])
    return np.exp(ways + k * np.log(p) + (n - k) * np.log1p(-p))


@cache
def plan(percent: int) -> tuple[int, float]:
    """(trees, least similarity of samples of a pair that is confirmed) by which at most MISSED of the pairs that are `percent` similar are missed. An error where no number of trees up to TOKENS does it."""
    similar = min(max(percent / 100, 1e-9), 1 - 1e-9)
    weight, equal = _binomial(TOKENS, similar), np.arange(TOKENS + 1) / TOKENS
    least = int(np.argmax(np.cumsum(_binomial(LOW, similar)) > MISSED / 4))
    together = np.ones(TOKENS + 1)  # in some node of the last level, by the share of equal tokens
    for _ in range(DEPTH - 1):
        together = 1 - (1 - equal * together) * (1 - TWO * equal * together)
    for trees in range(1, TOKENS + 1):
        if MISSED / 4 + (weight * (1 - equal * together) ** trees).sum() <= MISSED:
            return trees, least / LOW
    raise ValueError(f"{percent} in a hundred is too little for {TOKENS} tokens")


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; fewer words are one shingle, none give none."""
    parts = text.encode().lower().split()  # ASCII letters and white space only
    if not parts:
        return np.empty(0, dtype=np.uint64)
    data = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(parts) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    return np.unique(mix(RollingHash(data).spans(starts, ends)))


def minwise(hashes: np.ndarray) -> np.ndarray:
    """The minwise tokens of a set."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    found = np.full(TOKENS, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 4096):
        np.minimum(found, (((low[at : at + 4096, None] ^ _MASKS) * _FACTORS)).min(axis=0), out=found)
    return found


def _sketch(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                s = shingles(t.as_py(), words)
                if len(s):
                    rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), minwise(s).tobytes(), np.unique((s[:LOW] >> np.uint64(32)).astype(np.uint32)).tobytes()))
                else:
                    rows.append((0, None, None, None))
            n, key, tokens, low = zip(*rows) if rows else ((),) * 4
            yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (key, tokens, low))], names=["doc_id", "text_hash", "n_shingles", "set_key", "tokens", "low"])

    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text").mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, tokens binary, low binary")


def _tokens(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), TOKENS)


def _first_paths(items: DataFrame, trees: range) -> DataFrame:
    """(path, item): the first branch of each item in each tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = np.array([t * 37 % TOKENS for t in trees])
        salt = np.array(trees, dtype=np.uint64) << np.uint64(32)
        for b in batches:
            paths = mix(_tokens(b.column("tokens"))[:, chosen].astype(np.uint64) + salt + np.uint64(1 << 60))
            yield pa.record_batch([pa.array(paths.ravel().view(np.int64)), pa.array(np.repeat(b.column("item").to_numpy(), len(chosen)))], names=["path", "item"])

    return items.select("item", "tokens").mapInArrow(run, "path long, item long")


def _children(path: np.ndarray, tokens: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their paths) of the first child, and of the second where there is one."""
    for child in (0, 1):
        at = mix(path + np.uint64(depth * 2 + child + 1))
        rows = np.arange(len(path)) if child == 0 else np.flatnonzero((at >> np.uint64(40)) < np.uint64(int(TWO * 2**24)))
        token = tokens[rows, (at[rows] % np.uint64(TOKENS)).astype(np.int64)]
        yield rows, mix(at[rows] ^ mix(token.astype(np.uint64)))


def _branch(members: DataFrame, depth: int) -> DataFrame:
    """(path, item) of the children; members: (path, item, tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                for rows, paths in _children(b.column("path").to_numpy().view(np.uint64), _tokens(b.column("tokens")), depth):
                    yield pa.record_batch([pa.array(paths.view(np.int64)), pa.array(b.column("item").to_numpy()[rows])], names=["path", "item"])

    return members.mapInArrow(run, "path long, item long")


class _Node:
    """The items of a node: ids of their components, sizes of their sets, tokens and low hashes."""

    def __init__(self, parts: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, lows: list[np.ndarray], percent: int, least: float, every: bool) -> None:
        self.tokens, self.lows, self.percent, self.least, self.every = tokens, lows, percent, least, every
        self.part = np.unique(parts, return_inverse=True)[1]
        self.up = np.arange(self.part.max() + 1)
        self.counts = np.array([len(x) for x in lows])
        self.whole = self.counts == sizes
        # hashes up to here are all that the set has
        self.top = np.where(self.whole, np.int64(2**32), np.array([x[-1] for x in lows], np.int64))
        self.found: dict[tuple[int, int], None] = {}

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def roots(self, at: np.ndarray) -> np.ndarray:
        return np.array([self.root(x) for x in self.part[at].tolist()])

    def compare(self, left: np.ndarray, right: np.ndarray) -> None:
        """Links of items of left with items of right."""
        both = np.concatenate([left, right]) if left is not right else left
        hashes = np.concatenate([self.lows[i] for i in both])
        owner = np.repeat(np.arange(len(both)), self.counts[both])
        known, at, times = np.unique(hashes, return_inverse=True, return_counts=True)
        shared = times > 1
        use, column = shared[at], np.cumsum(shared) - 1
        x = np.zeros((len(both), int(shared.sum())), np.float32)
        x[owner[use], column[at[use]]] = 1
        y = x if left is right else x[len(left) :]
        x = x[: len(left)]
        same = x @ y.T
        reach = np.minimum(self.top[left][:, None], self.top[right][None, :])
        all_ = np.add.outer(self.counts[left], self.counts[right]).astype(np.float64)
        if not (self.whole[left].all() and self.whole[right].all()):  # what either knows counts up to the reach of both only
            for k, i in enumerate(left):
                all_[k] += np.searchsorted(self.lows[i], reach[k], side="right") - self.counts[i]
            for k, j in enumerate(right):
                all_[:, k] += np.searchsorted(self.lows[j], reach[:, k], side="right") - self.counts[j]
        all_ -= same
        exact = self.whole[left][:, None] & self.whole[right][None, :]
        good = np.where(exact, 100 * same >= self.percent * all_, same >= self.least * all_)
        good &= self.roots(left)[:, None] != self.roots(right)[None, :]
        i, j = np.nonzero(np.triu(good, 1) if left is right else good)
        if not len(i):
            return
        for k in np.argsort(-same[i, j] / all_[i, j], kind="stable").tolist():
            a, b = int(left[i[k]]), int(right[j[k]])
            p, q = self.root(self.part[a]), self.root(self.part[b])
            if p != q:
                self.found[a, b] = None
                if not self.every:
                    self.up[max(p, q)] = min(p, q)

    def middle(self, at: np.ndarray) -> np.ndarray:
        """The items whose tokens are the most frequent."""
        often = np.zeros(len(at))
        for column in self.tokens[at].T:
            _, place, times = np.unique(column, return_inverse=True, return_counts=True)
            often += times[place]
        return at[np.argsort(-often, kind="stable")[:HUBS]]

    def join(self, path: int, depth: int) -> list[tuple[int, int]]:
        waiting = [(np.arange(len(self.part)), path, depth)]
        while waiting:
            at, path, depth = waiting.pop()
            if (self.roots(at) == self.root(self.part[at[0]])).all():
                continue
            if len(at) <= SMALL:
                self.compare(at, at)
            elif depth >= DEPTH:
                cuts = [at[k : k + SMALL] for k in range(0, len(at), SMALL)]
                for k, x in enumerate(cuts):
                    for y in cuts[k:]:
                        self.compare(x, y if y is not x else x)
            else:
                if HUBS:
                    self.compare(self.middle(at), at)
                for rows, paths in _children(np.full(len(at), path, np.uint64), self.tokens[at], depth):
                    if len(rows):
                        order = np.argsort(paths, kind="stable")
                        cuts = np.flatnonzero(np.diff(paths[order])) + 1
                        waiting += [(at[rows[g]], paths[g[0]], depth + 1) for g in np.split(order, cuts) if len(g) > 1]
        return list(self.found)


def _compare(members: DataFrame, percent: int, least: float, every: bool) -> DataFrame:
    """(path, a, b) of similar items in nodes that lie together; members: (path, depth, item, component, n_shingles, tokens, low). Links that join parts of a node, or `every` pair of items of two components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def settle(table: pa.Table) -> pa.RecordBatch:
            path, depth, item, parts, sizes = (table.column(c).to_numpy() for c in ("path", "depth", "item", "component", "n_shingles"))
            cuts = np.flatnonzero(np.diff(path)) + 1
            out = []
            for i, j in zip([0, *cuts], [*cuts, len(path)]):
                if j - i > 1 and (parts[i:j] != parts[i]).any():
                    lows = [np.frombuffer(x, np.uint32) for x in table.column("low").slice(i, j - i).to_pylist()]
                    node = _Node(parts[i:j], sizes[i:j], _tokens(table.column("tokens").slice(i, j - i)), lows, percent, least, every)
                    out += [(int(path[i]), *sorted((int(item[i + a]), int(item[i + b])))) for a, b in node.join(path[i : i + 1].view(np.uint64)[0], int(depth[i]))]
            return pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["path", "a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            path = b.column("path").to_numpy()
            cut = len(path) - int(np.argmax(path[::-1] != path[-1])) if path[0] != path[-1] else 0
            if cut:  # the last node may go on in the next batch
                yield settle(pa.Table.from_batches([*held[:-1], b.slice(0, cut)]))
                held = [b.slice(cut)]
        if held:
            yield settle(pa.Table.from_batches(held))

    return members.mapInArrow(run, "path long, a long, b long")


def _confirm(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, id_a, id_b, good) of pairs (a, b) of items: whether their full sets are similar enough; texts: (item, id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[int, np.ndarray] = {}
        for b in batches:
            good = []
            for a, s, t in zip(b.column("a").to_pylist(), b.column("text_a"), b.column("text_b")):
                if a not in last:
                    last = {a: shingles(s.as_py(), words)}
                x, y = last[a], shingles(t.as_py(), words)
                both = len(x) + len(y) - len(np.union1d(x, y))
                good.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.record_batch([*(b.column(c) for c in ("a", "b", "id_a", "id_b")), pa.array(good, pa.bool_())], names=["a", "b", "id_a", "id_b", "good"])

    left, right = (texts.select(F.col("item").alias(x), F.col("id").alias(f"id_{x}"), F.col("text").alias(f"text_{x}")) for x in "ab")
    return pairs.join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "id_a", "id_b", "text_a", "text_b").mapInArrow(run, "a long, b long, id_a long, id_b long, good boolean")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all ids in links (a, b): stars of larger and of smaller neighbours in turn, until nothing changes."""

    def stored(df: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        found = written(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "stars")
        return found, (seen.get["n"], seen.get["h"])

    now, before = stored(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "stars")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).distinct()
        now, after = stored(small)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


class _Join:
    """The state of one join: items, confirmed links of their ids, components of ids."""

    def __init__(self, spark: SparkSession, docs: DataFrame, items: DataFrame, words: int, percent: int) -> None:
        self.spark, self.docs, self.items, self.words, self.percent = spark, docs, items, words, percent
        self.trees, self.least = plan(percent)
        self.links: DataFrame = spark.createDataFrame([], "a long, b long")
        self.parts: DataFrame | None = None  # (id, component) of linked ids

    def components_of(self, rows: DataFrame) -> DataFrame:
        """rows with `item`, and its component: the least id that links reach so far."""
        ids = self.items.select("item", "id")
        if self.parts is not None:
            ids = ids.join(self.parts, "id", "left").select("item", F.coalesce("component", "id").alias("component"))
        else:
            ids = ids.withColumnRenamed("id", "component")
        return rows.join(ids, "item")

    def open_nodes(self, nodes: DataFrame, depth: int) -> DataFrame:
        """(path, item, depth, component, size) of nodes with items of more than one component."""
        own = self.components_of(nodes)
        sizes = own.groupBy("path").agg(F.count("*").alias("size"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("path", "size")
        return written(own.join(sizes, "path").select("path", "item", F.lit(depth).alias("depth"), "component", "size"), "nodes")

    def pairs(self, nodes: DataFrame, every: bool = False) -> DataFrame:
        """(path, a, b) found in nodes that are each one group of a task."""
        members = nodes.join(self.items.select("item", "n_shingles", "tokens", "low"), "item").select("path", "depth", "item", "component", "n_shingles", "tokens", "low")
        return _compare(members.repartition(n_partitions(self.spark), "path").sortWithinPartitions("path"), self.percent, self.least, every)

    def chunked(self, nodes: DataFrame) -> DataFrame:
        """Nodes that are still too large at the last level, as nodes of each two of their chunks."""
        count = F.ceil(F.col("size") * 2 / LARGE).cast("int")
        own = nodes.withColumn("chunks", count).withColumn("chunk", F.pmod(F.xxhash64("item", F.lit(5)), count).cast("int"))
        met = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        # a chunk meets itself in each of its pairs
        met = met.where((F.col("chunk") != F.col("other")) | (F.col("chunks") == 1))
        return met.withColumn("path", F.xxhash64("path", F.least("chunk", "other"), F.greatest("chunk", "other"))).select(*nodes.columns)

    def judge(self, pairs: DataFrame) -> DataFrame:
        """Pairs confirmed or not; what is confirmed is linked."""
        pairs = written(pairs, "pairs")
        # one text of each item in a pair; nothing bounds their number, so nothing here is broadcast
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("item")).distinct().join(self.items.select("item", "id", "text_hash"), "item")
        wanted = written(wanted.withColumnRenamed("text_hash", "own_hash"), "wanted")
        rows = self.docs.withColumn("text_hash", F.xxhash64("text")).join(wanted.hint("shuffle_hash"), F.expr("doc_id = id AND text_hash = own_hash"))
        texts = written(rows.groupBy("item", "id").agg(F.any_value("text").alias("text")), "texts")
        judged = written(_confirm(pairs, texts, self.words, self.percent), "judged")
        discard(pairs, wanted, texts)
        self.links = self.links.unionByName(judged.where("good").select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))
        return judged

    def batch(self, trees: range) -> None:
        nodes, depth, groups, levels = self.open_nodes(_first_paths(self.items, trees), 1), 1, [], []
        while True:
            levels.append(nodes)
            groups.append(nodes.where(F.col("size") <= LARGE))
            large = nodes.where(F.col("size") > LARGE)
            if not large.limit(1).count():
                break
            if depth == DEPTH:
                groups.append(self.chunked(large))
                break
            members = large.join(self.items.select("item", "tokens"), "item").select("path", "item", "tokens")
            nodes, depth = self.open_nodes(_branch(members, depth), depth + 1), depth + 1
        groups = reduce(DataFrame.unionByName, groups)
        found = written(self.pairs(groups), "pairs")
        judged = self.judge(found.select("a", "b").distinct())
        failed = judged.where("NOT good").select("a", "b")
        again = bool(failed.limit(1).count())
        self.parts = written(components(self.links), "components")
        if again:
            paths = found.join(failed, ["a", "b"]).select("path").distinct()
            redo = self.components_of(groups.drop("component").join(paths, "path", "left_semi"))
            rest = self.pairs(redo, every=True).select("a", "b").distinct().join(judged.select("a", "b"), ["a", "b"], "left_anti")
            self.judge(rest)
            self.parts = written(components(self.links), "components")
        discard(found, *levels)

    def run(self, trees: int | None) -> None:
        trees = trees or self.trees
        for some in (range(min(FIRST, trees)), range(min(FIRST, trees), trees)):
            if len(some):
                self.batch(some)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = 85, trees: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs (doc_id, text). Documents are linked whose shared shingles are at least `percent` in a hundred of all theirs; component_id: the smallest id that links reach."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    whole = written(_sketch(rows, words), "sketches")
    sketched = written(whole.select("doc_id", "n_shingles", "set_key"), "sets")
    first = F.min(F.struct("doc_id", "text_hash"))
    items = whole.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(first.alias("f"), *(F.any_value(c).alias(c) for c in ("n_shingles", "tokens", "low")))
    items = items.select("set_key", F.col("f.doc_id").alias("id"), "f.text_hash", "n_shingles", "tokens", "low", F.monotonically_increasing_id().alias("item"))
    items = written(items, "items")
    discard(whole)
    join = _Join(spark, rows, items, words, percent)
    join.run(trees)
    # an id may stand for several sets, and ids of equal sets are linked with the set's first
    real = sketched.where("n_shingles > 0 AND doc_id IS NOT NULL")
    twice = sketched.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if twice:
        same = real.select("doc_id", "set_key").distinct().join(items.select("set_key", "id"), "set_key")
        parts = components(join.links.unionByName(same.select(F.col("id").alias("a"), F.col("doc_id").alias("b")).where("a <> b")))
        own = sketched.join(parts, F.col("doc_id") == F.col("id"), "left")
    else:
        whole = items.select("set_key", "id").join(join.parts, "id", "left").select(F.col("set_key").alias("k"), F.coalesce("component", "id").alias("component"))
        own = sketched.join(written(whole, "classes"), F.col("set_key") == F.col("k"), "left")
    component = F.coalesce("component", "doc_id")
    return own.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = 85, trees: int | None = None) -> DataFrame:
    """One row of docs (doc_id, text, ...) for each group of near-duplicates, as it is; rows with a null id stay."""
    own, count, rank = (unused(docs, c) for c in ("_kept", "_rows", "_rank"))
    keep = near_duplicates(docs, words, percent, trees).where("kept AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(count))
    keep = written(keep, "kept").hint("shuffle_hash")
    known = docs.where(F.col("doc_id").isNotNull())
    if keep.where(F.col(count) > 1).limit(1).count():  # rows of one id are one document: the first by its text's hash stays
        nth = F.row_number().over(W.partitionBy("doc_id").orderBy(F.xxhash64("text")))
        known = known.withColumn(rank, nth).where(F.col(rank) == 1).drop(rank)
    return known.join(keep.select(own), F.col("doc_id") == F.col(own), "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))
