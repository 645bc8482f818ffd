"""Divergence against dense counts in plain integers; odd rows; runs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from typeharvest.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, value long, rank string, counts string, `all` int"


def brute(rows, least=10, first=10):
    """rows: (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [(TERM.findall(t.translate(LOWER)), lang, s) for t, lang, s in rows]
    out = set()
    for lang in {r[1] for r in rows}:
        docs, groups = Counter(), defaultdict(Counter)
        for w, k, s in words:
            if k == lang:
                docs.update(set(w))
                groups[s].update(w)
        kept = [t for t in docs if docs[t] >= least]

        def shares(count):
            total = sum(count[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (count[t] + 2) // total for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = {s: shares(groups[s]) for s in groups}
        q = shares(sum(groups.values(), Counter()))
        for s in groups:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in groups if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, first)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, value, r) for r, (value, item) in enumerate(found[:most], 1)}
    return out


def audited(spark, rows, **how):
    df = spark.createDataFrame([(i, *r, 1, "r", "c", 2) for i, r in enumerate(rows)], SCHEMA)
    return [tuple(r) for r in D.audit(df, **how).select("lang", "source", "part", "item", "value", "rank").collect()]


def texts(n, seed=3, sources=5):
    rng = random.Random(seed)
    letters = ["the", "The", "ein", "ähre", "ÄHRE", "𝒳y", "x1y", "a-b", "[z]", "K", "日本", "q r"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    return [(" ".join(rng.choices(letters, k=rng.randint(0, 30))), rng.choice(["en", "de"]), f"s{min(int(rng.expovariate(0.7)), sources - 1)}") for _ in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_matches_dense_counts(spark, monkeypatch, small):
    if small:  # several chunks, blocks of sources, flushes
        for name, value in (("ROWS", 5), ("SOURCES", 2), ("HELD", 20), ("BROADCAST", 0)):
            monkeypatch.setattr(D, name, value)
    rows = texts(150)
    found = audited(spark, rows, least_docs=4)
    assert len(found) == len(set(found)) and set(found) == brute(rows, 4)
    assert sum(r[2] == "pair" for r in found) == 40


def test_odd_rows(spark):
    rows = texts(60) + [(None, "en", "s0"), ("", "en", "quiet"), ("1 2 3", None, None), (None, None, "s1"), ("the " * 50_000, "xx", "alone")]
    found = audited(spark, rows, least_docs=3)
    assert set(found) == brute(rows, 3)
    assert {("", "", "pair", "s1", 0, 1), ("", "s1", "pair", "", 0, 1)} <= set(found)  # no kept terms
    assert any(r[1] == "quiet" and r[2] == "pair" and r[4] > 0 for r in found)
    assert audited(spark, []) == []


def test_runs_sum_like_single_terms():
    rng = np.random.default_rng(4)
    counts = np.sort(rng.integers(0, 4, (200, 3)) * rng.integers(0, 2, (200, 1)), axis=0)[::-1]
    lengths, alls = rng.integers(1, 9, 200), [900, 10**13, 5000]
    pairs = [(0, 1), (0, 2), (1, 2)]
    got = D.pair_values(counts, lengths, alls, pairs)
    for (i, j), value in zip(pairs, got):
        p, q = ([1 + 10**9 * (int(c) + 2) // alls[k] for c in counts[:, k]] for k in (i, j))
        assert value == sum((a - b) ** 2 // (a + b) * int(n) for a, b, n in zip(p, q, lengths))
    assert D.runs(np.array([5, 5, 0, 0, 0, 7])).tolist() == [0, 2, 5]
    assert D.shares(np.array([10**12]), 10**13).tolist() == [1 + 10**9 * (10**12 + 2) // 10**13]
