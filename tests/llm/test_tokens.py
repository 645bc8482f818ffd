import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from typeharvest.llm import queries, token_counts, tokenization
from typeharvest.llm.common import scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_fast_paths_give_the_librarys_ids(name):
    path = public_tokenizers.path(name)
    fast, library = tokenization.Tokens(path), Tokenizer.from_file(path)
    assert fast.fast or fast.words
    rnd = random.Random(1)
    pieces = list("aabcdeEIÀéßſİ'’½²_-! \n\t\r\x85\xa0\x01\x00中😀") + ["'s", "'re", "ing ", "the ", "<|endoftext|>", "<|startoftext|>", "  "]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 40))) for _ in range(1500)] + ["a" * 3000, " " * 900 + "x", ""]
    for t in texts:
        assert memoryview(fast.packed(t)).cast("I").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_sentencepiece():
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert tokenization.Tokens(path).count("Hello, world") == len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello, world"))


def test_counts_and_cache(spark, frame):
    rows = [(1, "a b"), (1, "a b"), (2, "a b"), (None, "<|endoftext|> x"), (3, None), (4, ""), (5, "é" * 50_000)]
    cache = scratch(spark, "cache")
    library = Tokenizer.from_file(BYTES)
    want = sorted(((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows), key=str)
    run = lambda r: sorted((tuple(x) for x in token_counts.count_tokens(frame(r), BYTES, cache).collect()), key=str)
    assert run(rows) == want
    stored = lambda: spark.read.parquet(cache).select("digest").distinct().count()
    assert stored() == 4  # distinct texts, an empty one among them
    assert run(rows[:3]) == [w for w in want if w[0] in (1, 2)] and stored() == 4
    run([(9, "new"), *rows])
    assert stored() == 5
    spark.read.parquet(cache).limit(2).write.mode("append").parquet(cache)  # a job that ran twice
    assert run(rows) == want


def test_empty_table_and_query(spark, frame, sf):
    assert token_counts.count_tokens(frame([]), BYTES).collect() == []
    library = Tokenizer.from_file(BYTES)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op5_token_counts(spark, sf).collect()}
    assert got == {i: (len(t.encode()), n := len(library.encode(t).ids), n > 512) for i, t in texts.items()}
