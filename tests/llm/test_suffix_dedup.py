import hashlib
import random

from typeharvest.llm import queries, suffix_dedup


def brute(rows, length):
    """Of rows in order: removed flags by string, first come first kept."""
    seen, out = set(), []
    for text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            s = data[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(s)
        kept = bytes(c for c, g in zip(data, gone) if not g)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def check(frame, rows, length=100):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove(frame(rows), length).collect()}
    ordered = sorted(rows)
    assert got == {i: w for (i, _), w in zip(ordered, brute([t for _, t in ordered], length))}


def corpus(rnd, n, words):
    vocabulary = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9))) for _ in range(words)]
    passages = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(10, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(0, 40))) for _ in range(rnd.randint(0, 5))]
        rows.append((i * 3 % (3 * n + 1), "".join(parts)))
    return rows


def test_against_brute_force(frame):
    rnd = random.Random(4)
    rows = corpus(rnd, 150, 60)
    copy = rows[5][1] * 2
    rows += [(10_000 + i, copy) for i in range(40)] + [(20_000, ""), (20_001, None), (20_002, "ab" * 400), (20_003, "a" * 1000), (20_004, "x" * 99), (20_005, "x" * 100), (20_006, "x" * 100)]
    check(frame, rows)


def test_hot_grams_take_the_same_steps(frame, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_ROWS", 1)
    monkeypatch.setattr(suffix_dedup, "HOT_TIMES", 0)
    check(frame, corpus(random.Random(9), 120, 40))


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 512)
    rnd = random.Random(1)
    data = bytes(rnd.choice(b"abc") for _ in range(5000))
    gram, name, start, n = suffix_dedup.stretches(data)
    assert n.sum() == len(data) - 99 and start[0] == 0
    assert all(a + b == c for a, b, c in zip(start.tolist(), n.tolist(), start.tolist()[1:]))


def test_repeated_and_null_ids(frame):
    a, b = "a long enough text, " * 10, "another text of its own; " * 10
    rows = suffix_dedup.remove(frame([(1, a), (1, a), (1, b), (None, a), (2, b)])).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed) for r in rows), key=str)
    alone = {t: brute([t], 100)[0][1] for t in (a, b)}
    assert (None, 200, alone[a]) in got and got.count((1, 200, 200)) == 2 and (2, 250, 250) in got and (1, 250, alone[b]) in got


def test_empty_table_and_query(spark, frame, sf):
    assert suffix_dedup.remove(frame([])).collect() == []
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_suffix_dedup(spark, sf).collect()}
    assert got == {i: w for (i, _), w in zip(rows, brute([t for _, t in rows], 100))}
