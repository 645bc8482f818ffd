import random
import zlib
from array import array

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from typeharvest.llm import packing, queries

WORDS = public_tokenizers.path("word_bpe_49k.json")


def reference(text):
    ids = Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids + [0]
    return [ids[i : i + 2048] for i in range(0, len(ids), 2048)]


def check(rows, got):
    want = sorted((i, p, 2048 * p, len(ids), zlib.crc32(array("I", ids).tobytes())) for i, t in rows for p, ids in enumerate(reference(t)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_pieces_and_sequences(frame):
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice(["the", "Über", "x1", "don't", "!?", "longish"]) for _ in range(rnd.choice([0, 3, 700, 900])))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "word " * 9000), (103, "word " * 2047), (103, "word " * 2047)]
    n = check(rows, packing.pack(frame(rows).repartition(5), WORDS).collect())
    sizes = np.array([len(p) for _, t in rows for p in reference(t)])
    assert n <= len(packing.best_fit(sizes, 2048)) + 1  # nearly as few as when all pieces meet in one task


def test_best_fit_is_tight_and_exact():
    sizes = np.array([1200, 848, 1000, 1048, 2048, 1, 500, 1548])
    bins = packing.best_fit(sizes, 2048)
    assert sorted(i for b in bins for i in b) == list(range(8)) and len(bins) == 5
    assert all(sizes[b].sum() <= 2048 for b in bins)


def test_ids_round_trip(frame):
    rows = [(1, "one two three"), (2, None), (3, "four")]
    pieces = packing.pack(frame(rows), WORDS, with_ids=True)
    ids = array("I", packing.sequences(pieces).first().ids).tolist()
    assert sorted(ids) == sorted(i for _, t in rows for p in reference(t) for i in p)


def test_empty_table_and_query(spark, frame, sf):
    assert packing.pack(frame([]), WORDS).collect() == []
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    check(rows, queries.op1_best_fit_packing(spark, sf).collect())
