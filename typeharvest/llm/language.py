"""Language ID by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability in a language is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. Piece
probabilities are fitted by expectation maximisation over word counts of a sample: SAMPLE ids of known language at most, by
turns the next of each language in the order of hashed ids. Every round is a map over the counted words, then a sum by
language and piece, of which there are no more than languages times vocabulary. Prediction is a map over all rows without a
shuffle.

Words are runs of letters, lower-cased; one longer than WORD letters is scored as consecutive parts, of which only the first
has the mark of a word's start. All pieces of letters take part, however long. Null text, or text
without letters: `und`, score 0. Null language: not learned from. Nothing to learn from: `und`. Ties: the language first in
order. Null and repeated ids: each row is predicted. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, whole_text, written

#: Most labelled ids that the fit reads; rounds of expectation maximisation.
SAMPLE, ROUNDS = 3_000, 2
#: Letters that are scored at once.
WORD = 24
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_LOADED: dict[str, frozenset[str]] = {}


def vocabulary(path: str) -> frozenset[str]:
    """The pieces of a sentencepiece model that consist of letters, lower-cased, word starts marked."""
    if path not in _LOADED:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
        _LOADED[path] = frozenset(p for p in pieces if _LETTERS.fullmatch(p.removeprefix("▁") or "x"))
    return _LOADED[path]


def words_of(text: str) -> list[str]:
    """The scored parts of a text; the first part of a word is marked."""
    words = [f"▁{w}" for w in _LETTERS.findall(text.lower())]
    if all(len(w) <= WORD + 1 for w in words):
        return words
    cuts = ([0, *range(WORD + 1, len(w), WORD), len(w)] for w in words)
    return [w[a:b] for w, ends in zip(words, cuts) for a, b in zip(ends, ends[1:])]


class Lattice:
    """All segmentations of parts of one length: by their end, the start and the piece number of each step (-1: no piece)."""

    def __init__(self, words: list[str], number: dict[str, int], longest: int) -> None:
        self.n, self.size = len(words[0]), len(words)
        self.steps: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(self.n + 1)]
        for j in range(1, self.n + 1):
            for i in range(max(0, j - longest), j):
                ids = np.fromiter((number.get(w[i:j], -1) for w in words), dtype=np.int64, count=self.size)
                if j == i + 1:
                    ids[ids < 0] = 0  # number 0: a letter that is no piece
                elif ids.max() < 0:
                    continue  # no segmentation takes this step
                self.steps[j].append((i, ids))

    def forward(self, probability: np.ndarray) -> np.ndarray:
        """Sums over the segmentations of the first letters, by their number, word and language; probability: by piece and language, its last row 0."""
        sums = np.zeros((self.n + 1, self.size, probability.shape[1]))
        sums[0] = 1
        for j in range(1, self.n + 1):
            for i, ids in self.steps[j]:
                sums[j] += sums[i] * probability[ids]
        return sums

    def expected(self, probability: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Each piece's expected count over the segmentations in one language; weight: how often each word occurs."""
        one = probability[:, None]
        forward = self.forward(one)[:, :, 0]
        backward = np.zeros_like(forward)
        backward[self.n] = 1
        scale = weight / np.maximum(forward[self.n], 1e-300)
        counts = np.zeros(len(probability))
        for j in range(self.n, 0, -1):
            for i, ids in self.steps[j]:
                p = probability[ids] * backward[j]
                backward[i] += p
                counts += np.bincount(ids % len(probability), weights=forward[i] * p * scale, minlength=len(probability))
        return counts


def _by_length(words: list[str], most: int = 20_000) -> Iterator[list[int]]:
    """Places of words of equal length, in parts."""
    groups: dict[int, list[int]] = defaultdict(list)
    for k, w in enumerate(words):
        groups[len(w)].append(k)
    for own in groups.values():
        for at in range(0, len(own), most):
            yield own[at : at + most]


def numbered(pieces: frozenset[str]) -> dict[str, int]:
    """A number from 1 for each piece."""
    return {p: i for i, p in enumerate(sorted(pieces), 1)}


def longest_of(pieces: Iterable[str]) -> int:
    return max(map(len, pieces), default=1)


class Scorer:
    """Log probability of words in all languages; words are scored once while they are remembered."""

    MOST = 300_000

    def __init__(self, model: dict[str, dict[str, float]], pieces: frozenset[str]) -> None:
        self.languages = sorted(model)
        self.number, self.longest = numbered(pieces), longest_of(pieces)
        self.probability = np.zeros((len(self.number) + 2, len(model)))
        for k, lang in enumerate(self.languages):
            own = model[lang]
            self.probability[:-1, k] = own[""]
            for p, x in own.items():
                if p in self.number:
                    self.probability[self.number[p], k] = x
        self.place: dict[str, int] = {}
        self.logs = np.empty((0, len(model)))

    def totals(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The sum over each text's words."""
        if len(self.place) > self.MOST:
            self.place, self.logs = {}, self.logs[:0]
        new = list(set().union(*texts).difference(self.place))
        if new:
            logs = np.empty((len(new), len(self.languages)))
            for own in _by_length(new):
                sums = Lattice([new[k] for k in own], self.number, self.longest).forward(self.probability)[-1]
                logs[own] = np.log(np.maximum(sums, 1e-300))
            self.place.update(zip(new, range(len(self.logs), len(self.logs) + len(new))))
            self.logs = np.concatenate([self.logs, logs])
        get = self.place.__getitem__
        return [self.logs[np.fromiter(map(get, words), dtype=np.int64, count=len(words))].sum(axis=0) for words in texts]


def sample_rows(docs: DataFrame, usable: Column, most: int) -> DataFrame:
    """(lang, text) of the rows of at most `most` ids of known language, those of the smallest hashes: every language has its equal share, or all its ids where they are fewer."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    # ids first: the chosen ones are a bounded broadcast; each task passes on `most` ids of a language at most
    ids = rows.select(F.col("lang").alias("of"), F.col("doc_id").alias("id"), F.xxhash64("doc_id").alias("h")).distinct()
    turn = F.row_number().over(Window.partitionBy("of").orderBy("h", "id"))
    chosen = ids.withColumn("turn", turn).where(F.col("turn") <= most).orderBy("turn", "h", "of", "id").limit(most).select("of", "id")
    return rows.join(F.broadcast(chosen), (F.col("doc_id") == F.col("id")) & (F.col("lang") == F.col("of")), "left_semi").select("lang", whole_text().alias("text"))


def fit(docs: DataFrame, usable: Column, vocabulary_path: str, sample: int = SAMPLE, rounds: int = ROUNDS) -> dict[str, dict[str, float]]:
    """Piece probabilities by language; the empty piece stands for all that a language did not show."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                found[lang].update(words_of(text.as_py()))
        for lang, words in found.items():
            yield pa.record_batch([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(words.values(), pa.int64())], names=["lang", "word", "n"])

    counted = sample_rows(docs, usable, sample).mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = written(counted, "language-words")
    model: dict[str, dict[str, float]] = {}

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered(vocabulary(vocabulary_path))
        names, longest = [""] + list(number), longest_of(number)
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs, words, n = np.array(b.column("lang").to_pylist(), dtype=object), b.column("word").to_pylist(), b.column("n").to_numpy()
            for lang in set(langs):
                own = np.flatnonzero(langs == lang)
                probability = np.full(len(names) + 1, 1e-4)
                if lang in model:
                    probability[:] = model[lang][""]
                    for p, x in model[lang].items():
                        if p:
                            probability[number[p]] = x
                probability[-1] = 0
                mine = sums.setdefault(lang, np.zeros(len(names) + 1))
                chosen = [words[k] for k in own]
                for part in _by_length(chosen):
                    mine += Lattice([chosen[k] for k in part], number, longest).expected(probability, n[own[part]])
        for lang, mine in sums.items():
            found = np.flatnonzero(mine[:-1] > 0)
            yield pa.record_batch([pa.array([lang] * len(found), pa.string()), pa.array([names[k] for k in found], pa.string()), pa.array(mine[found], pa.float64())], names=["lang", "piece", "x"])

    for _ in range(rounds):
        rows = counted.mapInArrow(expect, "lang string, piece string, x double").groupBy("lang", "piece").agg(F.sum("x").alias("x"))
        # no more rows than languages times pieces (and single letters)
        by: dict[str, dict[str, float]] = defaultdict(dict)
        for lang, piece, x in rows.where("x > 0.01").collect():
            by[lang][piece] = x
        model = {}
        for lang, own in by.items():
            total = sum(own.values()) + 1
            # pieces not seen, and letters that are none, have a small share each
            model[lang] = {p: x / total for p, x in own.items() if p} | {"": 0.1 / total}
    return model


def predict(docs: DataFrame, model: dict[str, dict[str, float]], vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row; score: the probability of the language, all being equally likely before."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model, vocabulary(vocabulary_path)) if model else None
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                langs, scores = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
                texts = [words_of(t.as_py() or "") for t in part.column("text")]
                for k, sums in enumerate(scorer.totals(texts)) if scorer else ():
                    if texts[k]:
                        best = int(sums.argmax())
                        langs[k] = scorer.languages[best]
                        scores[k] = float(1 / np.exp(np.maximum(-700.0, sums - sums[best])).sum())
                yield pa.record_batch([part.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(run, "doc_id long, lang_pred string, score double")
