import random
from collections import defaultdict

import numpy as np
import pytest

from typeharvest.llm import neardup, queries


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset() if not w else frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def brute(rows):
    up = {i: i for i, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    by = defaultdict(list)
    for i, t in sorted(rows):
        by[shingle_set(t)].append(i)
    sets = [(s, ids) for s, ids in by.items() if s]
    pairs = [(ids[0], i) for _, ids in sets for i in ids[1:]]
    for k, (x, a) in enumerate(sets):
        for y, b in sets[k + 1 :]:
            both = len(x & y)
            if 100 * both >= 85 * (len(x) + len(y) - both):
                pairs.append((a[0], b[0]))
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: (len(shingle_set(t)), root(i), root(i) == i) for i, t in rows}


def corpus(rnd):
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(4))
    rows, i, common = [], 0, [word() for _ in range(60)]
    for _ in range(12):
        own = [word() for _ in range(rnd.randint(30, 160))]
        for _ in range(rnd.choice([1, 2, 6, 40])):
            w = list(own)
            for _ in range(rnd.randint(0, 3)):
                w[rnd.randrange(len(w))] = word()
            rows.append((i := i + 1, " ".join(w)))
    rows += [(i := i + 1, " ".join([word() for _ in range(20)] + common)) for _ in range(80)]  # a passage that many share
    return rows


def test_against_brute_force(frame, monkeypatch):
    rows = corpus(random.Random(8))
    rows += [(5000 + k, rows[3][1]) for k in range(70)] + [(9000, None), (9001, ""), (9002, "A b"), (9003, "a  B"), (9004, "a b c d e"), (9005, "x " * 20_000)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("depth, small, large, hubs", [(1, 4, 4096, 8), (1, 4, 10, 0), (2, 4, 30, 2), (7, 3, 12, 1)])
def test_nodes_that_stay_large(frame, monkeypatch, depth, small, large, hubs):
    for name, value in (("DEPTH", depth), ("SMALL", small), ("LARGE", large), ("HUBS", hubs)):
        monkeypatch.setattr(neardup, name, value)
    neardup.plan.cache_clear()
    rows = corpus(random.Random(3))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(rows)).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("low", [16, 48])
def test_sets_larger_than_their_sample(frame, monkeypatch, low):
    monkeypatch.setattr(neardup, "LOW", low)  # most sets are samples here, and some pairs fail on their full sets
    neardup.plan.cache_clear()
    rows = corpus(random.Random(11))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(rows)).collect()}
    neardup.plan.cache_clear()
    assert got == brute(rows)


def test_samples_estimate_like_sets():
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 2**32, n, dtype=np.uint64).astype(np.uint32)) for n in (40, 500, 900)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rnd.integers(0, 2**32, len(s) // 20, dtype=np.uint64).astype(np.uint32)])) for s in sets]
    lows, sizes = [s[:100] for s in sets], np.array([len(s) for s in sets])
    node = neardup._Node(np.arange(6), sizes, np.zeros((6, neardup.TOKENS), np.uint32), lows, 85, 0.75, True)
    node.compare(at := np.arange(6), at)
    for i in range(6):
        for j in range(i + 1, 6):
            reach = min(2**32 if len(sets[k]) <= 100 else sets[k][99] for k in (i, j))
            x, y = (set(sets[k][sets[k] <= reach].tolist()) for k in (i, j))
            share = len(x & y) / len(x | y)
            assert ((i, j) in node.found) == (share >= (0.85 if sizes[i] <= 100 and sizes[j] <= 100 else 0.75))
    assert (0, 3) in node.found and (1, 4) in node.found


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", 5, "x", 7), (2, "a b c d e f", 6, "y", 8), (1, "a b c d e f", 9, "z", 1)], "doc_id long, text string, _kept int, _rows string, _rank int")
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    assert [(r.doc_id, r._kept in (5, 9)) for r in kept.collect()] == [(1, True)]


def test_repeated_and_null_ids(frame):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = neardup.near_duplicates(frame([(1, a), (2, a), (2, b), (3, b), (4, "other words that stand alone here"), (None, a), (4, "other words that stand alone here")])).collect()
    assert {r.doc_id: r.component_id for r in rows} == {1: 1, 2: 1, 3: 1, 4: 4, None: None} and len(rows) == 7
    kept = neardup.one_of_each(frame([(1, a), (1, a), (2, a), (None, a), (3, b)])).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == [(1, a), (3, b), (None, a)]


def test_empty_table_and_query(spark, frame, sf):
    assert neardup.near_duplicates(frame([])).collect() == []
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_near_duplicates(spark, sf).collect()}
    assert got == brute(rows)
