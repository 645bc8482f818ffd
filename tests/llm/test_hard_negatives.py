"""Hard negatives against all scores in plain integers; odd rows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from typeharvest.llm import hard_negatives as H
from typeharvest.llm import vectors as V

SCHEMA = "vec_id long, embedding array<double>, label int, a int, v string, score long, slot string"
CLASH = (7, "v", 3, "s")


def whole(x):
    return int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x)


def brute(rows, positives=5, negatives=3):
    """rows: (id, vector, label) of rows that take part; distinct ids."""
    v = {i: ([whole(x) for x in e], label) for i, e, label in rows}
    out = set()
    for a in (i for i in v if i % 3 == 0):
        score = {i: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(v[a][0], v[i][0])))) for i in v if i != a}
        first = sorted(score, key=lambda i: (-score[i], i))
        for p in [i for i in first if v[i][1] == v[a][1]][:positives]:
            fit = [n for n in first if v[n][1] != v[a][1] and 50 * score[p] <= 100 * score[n] <= 95 * score[p]]
            out |= {(a, p, r, n, score[p], score[n]) for r, n in enumerate(fit[:negatives], 1)}
    return out


def mined(spark, rows, monkeypatch=None, size=None):
    if size:
        for name in ("ROWS", "ANCHORS", "FEW", "AT_ONCE"):
            monkeypatch.setattr(H, name, size)
    df = spark.createDataFrame([(i, e, label, *CLASH) for i, e, label in rows], SCHEMA)
    return [tuple(r) for r in H.mine(df, F.col("vec_id") % 3 == 0, F.col("label")).collect()]


@pytest.mark.parametrize("size", [None, 7])
def test_ties_and_blocks_match_all_scores(spark, monkeypatch, size):
    rng = random.Random(5)
    rows = [(i, [rng.randint(-1, 3) / 256 for _ in range(rng.choice([0, 3, 6]))], rng.randint(0, 2)) for i in range(90)]
    found = mined(spark, rows, monkeypatch, size)
    assert len(found) == len(set(found)) and set(found) == brute(rows)
    assert len(found) > 100


@pytest.mark.parametrize("scale", [1.0, 3e5, 4e6, 1e9, 1e300])
def test_exact_at_any_size(spark, scale):
    rng = random.Random(8)
    rows = [(i, [scale * rng.uniform(0.5, 1), 0.01 * rng.randint(1, 9)], i % 2) for i in range(24)]
    assert set(mined(spark, rows)) == brute(rows)


def test_kinds_of_numbers():
    kinds = [V.kind(64, most, 256) for most in (0.5, 1e3, 1e6, 1e9)]
    assert [k.__name__ for k in kinds] == ["float32", "float64", "int64", "object"]


def test_odd_rows(spark):
    rows = [(i, [1.0 + i / 10, 1.0], i % 2) for i in range(12)]
    odd = [(None, [1.0, 1.0], 0), (100, None, 1), (102, [1.0, None], 0), (105, [float("nan"), 1.0], 1), (108, [float("inf")], 0), (111, [1.0, 1.0], None)]
    assert set(mined(spark, rows + odd)) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, odd) == []
    # the same row twice is one anchor, and a row of its own as a partner; never a partner of its own id
    twice = mined(spark, rows + [rows[3]])
    assert sorted(r for r in twice if r[0] == 3) == sorted(r for r in brute(rows) if r[0] == 3)
    assert all(a != p and a != n for a, p, _, n, _, _ in twice)


def test_one_label_and_one_id_hold_most_rows(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.random() for _ in range(4)], 0 if i % 5 else 1) for i in range(200)]
    assert set(mined(spark, rows, monkeypatch, 16)) == brute(rows)
    many = mined(spark, rows + [(1000, [1.0] * 4, 1)] * 80, monkeypatch, 16)
    assert {n for _, _, _, n, _, _ in many} <= {i for i, _, _ in rows} | {1000}
    assert max(len(list(g)) for _, g in itertools.groupby(sorted(many), key=lambda r: r[:3])) <= 5
