import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from typeharvest.llm import decontamination, queries, sharding, topk


def test_shards(frame):
    rnd = random.Random(7)
    rows = [(i, f"text {i}") for i in range(300)] + [(1000 + i, "hot") for i in range(200)] + [(2000 + i, f"group {i // 4}") for i in range(120)]
    rows += [(5, None), (5, ""), (None, "x"), (7, "text 7"), (7, "text 7"), (9999, "long " * 50_000)]
    rnd.shuffle(rows)
    got = sharding.shard(frame(rows), 10).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    by = defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert len(by) == 10 and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    place = defaultdict(set)
    for r in got:
        if r.doc_id is not None and 2000 <= r.doc_id < 9000:
            place[(r.doc_id - 2000) // 4].add(r.shard)
    assert sum(len(s) == 1 for s in place.values()) >= 0.9 * len(place)  # few groups are cut
    assert len({r.shard for r in got if r.doc_id is not None and 1000 <= r.doc_id < 1200}) <= 8
    assert {r.size for r in got if r.doc_id == 5} >= {16}


def test_few_rows_and_none(frame):
    assert sharding.shard(frame([])).collect() == []
    got = sharding.shard(frame([(1, "a"), (2, "a"), (3, None)])).collect()
    assert len(got) == 3 and len({(r.shard, r.slot) for r in got}) == 3 and all(r.slot == 0 for r in got)


def test_threshold_stops_and_is_exact():
    rng = np.random.default_rng(1)
    x = rng.integers(-40, 40, (3000, 8)).astype(np.float64)
    x[:, 0] *= 30  # one dimension rules: the bound falls early
    ids = rng.permutation(3000)
    order = np.argsort(x, axis=0, kind="stable")
    for q in x[:20]:
        got = topk.threshold(x, ids, q, -1, 5, (order, np.take_along_axis(x, order, axis=0)))
        want = sorted(((-int(s), int(i)) for s, i in zip(x @ q, ids)))[:5]
        assert got == [(-s, i) for s, i in want]


def test_top_k_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 4)
    monkeypatch.setattr(topk, "QUERIES", 2)
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, 0.5]), (1, [0.5, 0.5]), (2, [0.5]), (3, [nan, 1.0]), (4, None), (5, []), (6, [1.0, None]), (7, [inf, 0.0]), (8, [-1.0, -1.0]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (50, [0.25, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS score", "2 AS rank")
    got = topk.top_k(df, F_col("vec_id") % 50 == 0, k=3).collect()
    assert [(r.rank, r.vec_id, r.score) for r in got if r.query_id == 0] == [(1, 1, 32768), (2, 2, 16384), (3, 50, 8192)]
    assert topk.top_k(df.limit(0), F_col("vec_id") % 50 == 0).collect() == []


def F_col(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_top_k_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.execute(queries.oracle_sql()["op7_exact_top_k"]).fetchall())
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in queries.op7_exact_top_k(spark, sf).collect()) == want


def edits(a, b):
    """Least edits of a against any part of b."""
    text, place = np.frombuffer(b, dtype=np.uint8), np.arange(len(b) + 1)
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for i, c in enumerate(a, 1):
        best = np.append(i, np.minimum(row[:-1] + (text != c), row[1:] + 1))
        row = np.minimum.accumulate(best - place) + place
    return int(row.min())


def test_decontamination_against_brute_force(spark, frame):
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 6)))
    items = [" ".join(word() for _ in range(rnd.randint(12, 60))) for _ in range(8)] + ["short", "", None]
    rows = []
    for i in range(80):
        text = [" ".join(word() for _ in range(rnd.randint(0, 40)))]
        if i % 2:
            item = list(items[rnd.randrange(8)])
            for _ in range(rnd.randint(0, len(item) // 6)):
                k = rnd.randrange(len(item))
                item[k] = rnd.choice(["", "x", item[k] + "y"])
            text.append("".join(item))
        rows.append((i, "  ".join([*text, word()]).upper()))
    rows += [(100, None), (101, ""), (102, items[0] * 2), (102, items[0]), (103, "z " * 50_000 + items[1]), (None, items[2])]
    benchmark = spark.createDataFrame(list(enumerate(items)) + [(0, items[0])], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(rows), benchmark).collect()}
    want = set()
    for i, t in rows:
        data = decontamination.normalised(t)
        for k, item in enumerate(items):
            for _, s in decontamination.segments_of(item):
                if s in data or (len(data) < 5000 and edits(s, data) <= min(int(len(s) * decontamination.EDITS), (len(s) - 8) // 8)):
                    want.add((i, k))
    assert got == want
    clean = decontamination.clean(frame(rows), benchmark).collect()
    assert sorted(str(r.doc_id) for r in clean) == sorted(str(i) for i, _ in rows if not any(w[0] == i for w in want))


def test_excerpts_and_short_items(spark, frame):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 9)))
    item, short = " ".join(word() for _ in range(80)), "an item of thirty-seven bytes in all."
    rows, key = [(1000, f"before {short} after"), (1001, "an item of thirty-six bytes in all"), (1002, "of thirty-seven")], 0
    for n in (decontamination.SURE, 80, 120, 160):
        for _ in range(30):
            at = rnd.randrange(len(item) - n)
            rows.append((key, f"{word()} {item[at : at + n].strip()}{'' if item[at + n - 1] != ' ' else ' ' + item[at + n]}{item[at + n : at + n + 2]} {word()}"))
            key += 1
    assert len(short) == 37
    benchmark = spark.createDataFrame([(1, item), (2, short)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(rows), benchmark).collect()}
    assert got >= {(k, 1) for k in range(key)} | {(1000, 2)} and not {k for k, _ in got} & {1002}


def test_decontamination_in_blocks(spark, frame, monkeypatch):
    items = [f"the item number {k} has words of its own like {'abcdefgh'[k] * 7} and {k * 7919} to tell" for k in range(6)]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    rows = [(k, f"before {t} after") for k, t in enumerate(items)] + [(50, "nothing of the kind")]
    one = sorted(map(tuple, decontamination.leaks(frame(rows), benchmark).collect()))
    monkeypatch.setattr(decontamination, "BLOCK", 150)
    assert sorted(map(tuple, decontamination.leaks(frame(rows), benchmark).collect())) == one and len(one) >= 6
    assert decontamination.leaks(frame(rows), benchmark.limit(0)).collect() == [] == decontamination.leaks(frame([]), benchmark).collect()
    assert decontamination.clean(frame(rows), benchmark.limit(0)).count() == 7


def test_decontamination_query(spark):
    sf = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, sf).collect()}
    items = [(r.item_id, decontamination.normalised(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = [(r.doc_id, decontamination.normalised(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got >= {(i, k) for i, t in texts for k, b in items if b in t}


@pytest.mark.parametrize("scale", [1.0, 3e5, 4e6, 1e9, 1e300])
def test_top_k_is_exact_at_any_size(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "CANDIDATES", 16)
    rnd = random.Random(9)
    rows = [(i, [scale * rnd.choice([-1, 0.5, 1]), 0.01 * rnd.randint(1, 9), scale * rnd.random()]) for i in range(60)]
    rows += [(100 + i, v) for i, v in rows[:20]]  # ties, also between blocks
    whole = {i: [int(x) * 256 if abs(x) >= 2**53 else math.floor(256 * x) for x in v] for i, v in rows}
    want = set()
    for q in (i for i in whole if i % 50 == 0):
        score = {i: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(whole[q], whole[i])))) for i in whole if i != q}
        best = sorted(score, key=lambda i: (-score[i], i))[:5]
        want |= {(q, r, i, score[i]) for r, i in enumerate(best, 1)}
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = topk.top_k(df, F_col("vec_id") % 50 == 0)
    assert {tuple(r) for r in got.collect()} == want
