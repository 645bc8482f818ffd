"""Quality rules against plain counts on all documents; bands; odd rows."""

import base64
import random
import re

import zstandard

from typeharvest.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, lines = WORD.findall(text), text.split("\n")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen, inside = {}, set()
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    for at in seen.values():
        if len(at) > 1:
            inside |= {i + k for i in at for k in range(5)}
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(words) < 10 or 100 * len(inside) > 20 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), failed


def verdict(text):
    data, z = (text or "").encode(), zstandard.ZstdCompressor(level=Q.LEVEL, write_content_size=False, write_checksum=False)

    def bad(part):
        limits = [b for b in Q.BANDS if b[0] <= len(part)][-1:]
        return any(not low <= len(z.compress(part)) / len(part) <= high for _, low, high in limits)

    chunks = [data[i : i + Q.CHUNK] for i in range(0, len(data), Q.CHUNK)]
    return not bad(data) and 4 * sum(len(c) for c in chunks if bad(c)) <= len(data)


NAMES = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def judged(df):
    return [tuple(r) for r in Q.judge(df).select(*NAMES).collect()]


def test_all_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = []
    for r in docs.select("doc_id", "text").collect():
        base = brute(r.text)
        want.append((r.doc_id, *base, verdict(r.text) and not base[-1]))
    assert sorted(judged(docs)) == sorted(want)
    assert 0.5 < sum(w[-1] for w in want) / len(want) < 1


def test_odd_texts(frame, monkeypatch):
    rng = random.Random(1)
    few = ["a", "bb", "c c", "ü", "𝒳", "x y"]
    texts = [None, "", " \n\t", "\n\n \n", "one", "a\x0bb\x0cc\r\nd\x1ce\x85f", "a b c d e a b c d e", "same\nsame\n same\nsame\r\n\nsame", "#*$%&|<> #"]
    texts += [rng.choice([" ", "\n"]).join(rng.choices(few, k=rng.randint(0, 40))) for _ in range(60)] + ["a " * 300_000, "word" * 200_000]
    monkeypatch.setattr(Q.segments, "__defaults__", (16,))
    got = {r[0]: r[1:7] for r in judged(frame([(i, t) for i, t in enumerate(texts)]))}
    assert got == {i: brute(t) if t is None or len(t) < 10_000 else got[i] for i, t in enumerate(texts)}
    assert got[len(texts) - 2] == (300_000, 300_000, 0, 0, 300_000, True)
    assert judged(frame([])) == []
    assert judged(frame([(None, "x"), (None, "x")])) == [(None, 1, 1, 0, 0, 0, True, False)] * 2


def test_segments_cut_no_word():
    data = " ".join(f"word{i}" for i in range(500)).encode()
    parts = list(Q.segments(data, 7))
    assert len(parts) > 100 and b"".join(parts) == data and [w for p in parts for w in p.split()] == data.split()


def test_bands_tell_repeats_and_noise_from_prose():
    rng = random.Random(6)
    syllables = [a + b for a in "b d f g h k l m n r s t v".split() for b in "a e i o u an en in ou".split()]
    lexicon = ["".join(rng.choices(syllables, k=rng.choice([1, 1, 2, 2, 3, 4]))) for _ in range(4000)]

    def prose(n):
        return " ".join(lexicon[min(int(rng.paretovariate(0.5)) - 1, 3999)] for _ in range(n)).encode()

    z = zstandard.ZstdCompressor(level=Q.LEVEL, write_content_size=False, write_checksum=False)
    assert all(Q.compression(prose(n), z)[2] for n in (5, 20, 60, 200, 800, 4000, 20000) for _ in range(5))
    noise = base64.b64encode(rng.randbytes(6000))
    line = prose(12) + b"\n"
    assert not Q.compression(noise, z)[2] and not Q.compression(line * 40, z)[2]
    mixed = prose(1500) + noise  # fine as a whole, a part of its chunks is not
    ratio, share, fine = Q.compression(mixed, z)
    assert not Q.out_of_band(len(mixed), ratio) and share > Q.BAD_SHARE and not fine
    page = prose(800)  # chunks are fine, the whole repeats
    ratio, share, fine = Q.compression(page * 12, z)
    assert share < Q.BAD_SHARE and Q.out_of_band(12 * len(page), ratio) == -1 and not fine
    assert Q.out_of_band(10, 9.0) == 0 and Q.compression(b"", z) == (0.0, 0.0, True)
