"""Quality rules by bands of compression ratios.

A text is compressed with zstandard twice: as a whole, and in fixed chunks of CHUNK bytes. Each ratio (compressed bytes to
bytes) is held against the limits of its length: below the lower one the text repeats itself, above the upper one it is not
language (keys, hashes, encoded data). Short texts compress badly whatever they say, so the limits widen with falling length,
and below the first band there is no verdict. A document goes if its whole is out of its band, or chunks out of theirs hold
more than BAD_SHARE of its bytes: the whole shows repeats that lie far apart, the chunks a part that the rest would hide.

Before that stand plain counts of words, lines and symbols, and the base rule on repeated word windows. Row by row, no shuffle;
texts are read as bytes and cut into words a segment at a time.

Null text: no words, fails the base rule; an empty one too. Ids may be null or repeat: each row is judged on its own. An empty
table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import segments, ship

LEVEL, CHUNK, BAD_SHARE = 3, 2048, 0.25
#: (from so many bytes on, least ratio, greatest ratio); running prose lies well between, doubled text well below.
BANDS = ((64, 0.30, 1.25), (256, 0.27, 0.95), (1024, 0.24, 0.74), (4096, 0.21, 0.71), (16384, 0.18, 0.68), (65536, 0.15, 0.66))
LEAST_WORDS, WINDOW, MOST_REPEATED = 10, 5, 20

_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"
#: White space and the bytes that only continue a character.
_NOT_STARTS = _SPACE + bytes(range(0x80, 0xC0))
_SYMBOLS = b"#*$%&|<>"
_STARTS = [b[0] for b in BANDS]


def out_of_band(n_bytes: int, ratio: float, bands: tuple = BANDS) -> int:
    """-1: below its band (repetitive), 1: above it (incompressible), 0: within it or too short for a verdict."""
    at = bisect.bisect_right(_STARTS if bands is BANDS else [b[0] for b in bands], n_bytes) - 1
    if at < 0:
        return 0
    return -1 if ratio < bands[at][1] else 1 if ratio > bands[at][2] else 0


def compression(data: bytes, compressor: zstandard.ZstdCompressor, bands: tuple = BANDS, chunk: int = CHUNK) -> tuple[float, float, bool]:
    """(ratio of the whole, share of bytes in chunks out of their bands, whether the text passes)."""
    if not data:
        return 0.0, 0.0, True
    whole = len(compressor.compress(data)) / len(data)
    bad = 0
    for at in range(0, len(data), chunk):
        part = data[at : at + chunk]
        if out_of_band(len(part), len(compressor.compress(part)) / len(part), bands):
            bad += len(part)
    share = bad / len(data)
    return whole, share, not out_of_band(len(data), whole, bands) and share <= BAD_SHARE


def repeated_words(data: bytes, window: int = WINDOW) -> tuple[int, int]:
    """(number of words, words that lie in windows found twice or more)."""
    numbers: dict[bytes, int] = {}
    found = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)) for words in map(bytes.split, segments(data))]
    ids = np.concatenate(found) if found else np.empty(0, np.int64)
    n = len(ids)
    if n <= window:
        return n, 0
    # windows are named exactly: a longer one by the names of its front and its last word
    names = ids
    for length in range(2, window + 1):
        names, count = np.unique(names[:-1] * len(numbers) + ids[length - 1 :], return_inverse=True, return_counts=True)[1:]
        if length < window and len(count) == len(names):
            return n, 0  # no shorter window is there twice
    cover = np.zeros(n + 1, np.int64)
    twice = np.flatnonzero(count[names] > 1)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return n, int((np.cumsum(cover) > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return len(lines) - len(set(lines))


def judge(docs: DataFrame, bands: tuple = BANDS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio, bad_share) of each row of docs (doc_id, text)."""
    ship(docs.sparkSession)
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_share double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        for b in batches:
            rows = []
            for value in b.column("text"):
                data = value.as_py() or b""
                words, repeated = repeated_words(data)
                failed = words < LEAST_WORDS or 100 * repeated > MOST_REPEATED * words
                ratio, bad, fine = compression(data, compressor, bands, chunk)
                chars = len(data.translate(None, _NOT_STARTS))
                symbols = len(data) - len(data.translate(None, _SYMBOLS))
                rows.append((words, chars, symbols, repeated_lines(data), repeated, failed, fine and not failed, ratio, bad))
            columns = list(zip(*rows)) or [()] * 9
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.record_batch([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, schema)
