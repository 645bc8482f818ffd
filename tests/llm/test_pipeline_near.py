import os
import random
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402


def shingle_set(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_from_80_in_a_hundred(spark, frame):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(7))
    rows = []
    for k in range(60):
        own, changed = [word() for _ in range(94)], 7 + k % 6  # 0.86 down to 0.76
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(own[: 94 - changed] + [word() for _ in range(changed)]))]
    sets = {i: shingle_set(t) for i, t in rows}
    shares = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}
    assert {(2 * k, 2 * k + 1) for k in range(60)} >= {p for p, s in shares.items() if s >= 0.8} and sum(0.8 <= s < 0.85 for s in shares.values()) >= 20
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame(rows), "").collect()}
    assert kept == sets.keys() - {b for (_, b), s in shares.items() if s >= 0.8}
