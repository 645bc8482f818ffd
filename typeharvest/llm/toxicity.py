"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols by a lexicon transducer (insult, threat, target, negation, reported speech, other). Target, threat,
negation and reported-speech transducers are composed over the symbols of each clause; what they put out is an event
(a plain, aimed, negated or reported insult or threat) with the weight of its word. A logistic model over a document's
event sums gives the score, so a negated or reported word counts as labels say such clauses count.

The word weights and the logistic model are fitted on at most SAMPLE labelled rows, those with the smallest hashed ids;
the model is fitted on one half with words of the other, and the words it then reads come from both. A word or stem counts as an insult only if it
follows many different words: words of one much-copied toxic text do not. Scoring is a map over all rows without a shuffle.

Null or empty text: the score of a text without events. A label other than 0 and 1, or of a null id: no label; an id with
several labels is toxic if any is. No labels: every score is 0. Null and repeated ids: each row is scored. Other columns
are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, whole_text, written

#: Most labelled rows that the fit reads, and most entries of the lexicon.
SAMPLE, LEXICON = 32_000, 4_000
THRESHOLD = 0.3
#: Least toxic documents that hold a word of the lexicon, least different words before it, and prefix lengths of stems.
LEAST_DOCS, LEAST_CONTEXTS, STEMS = 3, 3, (4, 5, 6)
#: How many times likelier a word must be in toxic documents.
LEAST_RATIO = 20

# Function words of the grammar in English, German, French and Spanish.
TARGETS = "you your yours yourself u ur they them he she du dich dir dein deine ihr euch sie tu toi te ton ta vous votre eres usted ustedes ti tu vosotros".split()
NEGATIONS = "not no never none nobody isn aren wasn don doesn didn won nicht kein keine keinen nie niemals ne pas jamais aucun nunca jamas ningún tampoco".split()
REPORTS = "said says say told tells called calls wrote writes quoted claimed reported sagte sagt schrieb nannte dit disait écrit appelle dijo dice escribió llamó".split()
THREATS = "kill hurt destroy murder shoot stab burn beat töten umbringen verletzen schlagen tuer frapper détruire matar golpear destruir herir".split()

_CLAUSES = re.compile(r"[.!?;:\n]+")
_WORDS = re.compile(r"[^\W\d_]+")
EVENTS = ("I", "J", "H", "i", "j", "h", "r")


class Fst:
    """A deterministic transducer: (state, symbol) to (state, output); a symbol without an arc goes through and leads to `rest`."""

    def __init__(self, arcs: dict[tuple[int, str], tuple[int, str]], rest: dict[int, int]) -> None:
        self.arcs, self.rest = arcs, rest

    def step(self, state: int, symbol: str) -> tuple[int, str]:
        return self.arcs.get((state, symbol)) or (self.rest[state], symbol)


def compose(machines: list[Fst], symbols: str) -> dict[tuple[tuple[int, ...], str], tuple[tuple[int, ...], str]]:
    """The product of transducers, each reading what the one before puts out; start: all states 0."""
    start = (0,) * len(machines)
    table, open_ = {}, [start]
    seen = {start}
    while open_:
        states = open_.pop()
        for symbol in symbols:
            out, to = symbol, []
            for machine, state in zip(machines, states):
                state, out = machine.step(state, out)
                to.append(state)
            table[states, symbol] = tuple(to), out
            if tuple(to) not in seen:
                seen.add(tuple(to))
                open_.append(tuple(to))
    return table


def _within(opener: str, changes: dict[str, str], reach: int) -> Fst:
    """After `opener`, symbols within `reach` words change."""
    states = range(reach + 1)
    arcs = {(s, opener): (reach, opener) for s in states} | {(s, a): (s - 1, b) for s in states if s for a, b in changes.items()}
    return Fst(arcs, {s: max(0, s - 1) for s in states})


#: Insults near a target are aimed (J); threats need a target (H); negation reaches four words; reported speech the rest of the clause.
_AIM = _within("T", {"I": "J", "V": "H"}, 4)
_NEGATE = _within("N", {"I": "i", "J": "j", "H": "h"}, 4)
_REPORT = Fst({(0, "R"): (1, "R")} | {(1, s): (1, "r") for s in "IJHijh"}, {0: 0, 1: 1})
GRAMMAR = compose([_AIM, _NEGATE, _REPORT], "IVTNRw")
_START = (0, 0, 0)


class Lexer(dict):
    """Symbol and weight of each word, filled as words come; words of the learned lexicon and stems are insults."""

    MOST = 300_000

    def __init__(self, weights: dict[str, float]) -> None:
        super().__init__()
        self.weights = weights
        self.fixed = {w: (s, 1.0) for s, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("V", THREATS)) for w in words}

    def __missing__(self, word: str) -> tuple[str, float]:
        if word in self.fixed:
            found = self.fixed[word]
        else:
            own = [self.weights[k] for k in features(word) if k in self.weights]
            found = ("I", max(own)) if own else ("w", 0.0)
        if len(self) > self.MOST:
            self.clear()
        self[word] = found
        return found


def features(word: str) -> list[str]:
    """A word as a whole and its stems."""
    return [f"={word}", *(word[:n] for n in STEMS if len(word) > n)]


def events(text: str, lexer: Lexer) -> list[float]:
    """Weight sums by kind of event, then the largest weight and the share of clauses with an event."""
    sums = dict.fromkeys(EVENTS, 0.0)
    top, hit, clauses = 0.0, 0, 0
    lower = text.lower()
    if all(lexer[w][0] not in "IV" for w in set(_WORDS.findall(lower))):
        return [0.0] * (len(EVENTS) + 2)
    for clause in _CLAUSES.split(lower):
        words = _WORDS.findall(clause)
        if not words:
            continue
        clauses += 1
        symbols = [lexer[w] for w in words]
        if all(s not in "IV" for s, _ in symbols):
            continue
        state, found = _START, False
        for symbol, weight in symbols:
            state, out = GRAMMAR[state, symbol]
            if out in sums:
                sums[out] += weight
                top, found = max(top, weight * (out in "IJH")), True
        hit += found
    return [*(math.log1p(x) for x in sums.values()), top, hit / max(1, clauses)]


def sample_labels(labels: DataFrame, usable: Column, most: int) -> DataFrame:
    """(label_id, toxic) of at most `most` labelled rows, by the smallest hashed ids."""
    rows = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & usable).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.orderBy(F.xxhash64("label_id"), "label_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE, lexicon: int = LEXICON) -> tuple[dict[str, float], list[float]]:
    """Word weights and the logistic model (centre and scale in the weights); usable: which rows of labels may be read."""
    ship(docs.sparkSession)
    # at most `sample` rows of two numbers: a bounded broadcast
    chosen = F.broadcast(sample_labels(labels, usable, sample))
    own = docs.select("doc_id", whole_text().alias("text")).join(chosen, F.col("doc_id") == F.col("label_id")).withColumn("half", F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(2)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[int]] = {}
        for b in batches:
            for text, toxic in zip(b.column("text"), b.column("toxic").to_pylist()):
                words = _WORDS.findall(text.as_py().lower())
                before = dict(zip(words[1:], words)) | {w: "" for w in words[:1]}
                mine: dict[str, int] = {}
                for w, p in before.items():
                    bit = 1 << (sum(map(ord, p)) * 2654435761 % 2**32 >> 26)
                    for k in features(w):
                        mine[k] = mine.get(k, 0) | bit
                for k, bits in mine.items():
                    row = found.get(k)
                    if row is None:
                        row = found[k] = [0, 0, 0]
                    row[1 - toxic] += 1
                    if toxic:
                        row[2] |= bits
        keys = [k for k, r in found.items()]
        signed = [r[2] - (1 << 64) * (r[2] >> 63) for r in found.values()]
        for at in range(0, len(keys), 50_000):
            yield pa.record_batch([pa.array(keys[at : at + 50_000], pa.string()), *(pa.array([r[i] for r in list(found.values())[at : at + 50_000]], pa.int64()) for i in (0, 1)), pa.array(signed[at : at + 50_000], pa.int64())], names=["feature", "toxic", "clean", "contexts"])

    n = {r.half: r for r in own.groupBy("half").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean")).collect()}
    if len(n) < 2 or not n[0].toxic or not n[0].clean:
        return {}, []
    parts = [own.where(f"half = {h}").select("text", "toxic").mapInArrow(count, "feature string, toxic long, clean long, contexts long").withColumn("half", F.lit(h)) for h in (0, 1)]
    counts = parts[0].unionByName(parts[1]).groupBy("feature").agg(
        *(F.sum(F.when(F.col("half") <= h, F.col(c))).alias(f"{c}{h}") for h in (0, 1) for c in ("toxic", "clean")),
        *(F.bit_count(F.bit_or(F.when(F.col("half") <= h, F.col("contexts")))).alias(f"contexts{h}") for h in (0, 1)))
    counts = written(counts.where(F.col("toxic1") >= LEAST_DOCS), "toxicity-words")

    def learned(h: int) -> dict[str, float]:
        """Weights by the halves up to h."""
        n_toxic, n_clean = (sum(getattr(n[k], c) for k in range(h + 1)) for c in ("toxic", "clean"))
        a, b, c = F.col(f"toxic{h}"), F.col(f"clean{h}"), F.col(f"contexts{h}")
        weight = F.log((a + 0.1) / n_toxic) - F.log((b + 0.1) / n_clean)
        usual = (a >= LEAST_DOCS) & (c >= LEAST_CONTEXTS) & (2 * c >= F.least(a, F.lit(24))) & (a * n_clean > LEAST_RATIO * b * n_toxic)
        return {r.feature: float(r.w) for r in counts.where(usual).select("feature", weight.alias("w"), a.alias("a")).orderBy(F.desc(F.col("w") * F.log1p("a")), "feature").limit(lexicon).collect()}

    weights = learned(0)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(weights)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([events(t.as_py(), lexer) for t in b.column("text")], pa.list_(pa.float64())), b.column("toxic")], names=["id", "x", "toxic"])

    # one row of a few numbers for each id of the sample, however often the id is repeated
    seen = own.where("half = 1").select(F.col("doc_id").cast("long"), "text", "toxic").mapInArrow(measure, "id long, x array<double>, toxic int")
    seen = seen.groupBy("id", "toxic").agg(F.min("x").alias("x")).orderBy("id", "toxic").toArrow()
    x, y = np.array(seen.column("x").to_pylist(), dtype=float).reshape(seen.num_rows, -1), np.array(seen.column("toxic").to_pylist(), dtype=float)
    # the model knows how far to trust words of texts that it was not fitted on; the words may then come from both halves
    return learned(1), logistic(x, y)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> list[float]:
    """Intercept and coefficients of a ridge logistic regression, by Newton's method."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(x.shape[1])
    penalty = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def chance(text: str, lexer: Lexer, model: list[float]) -> float:
    """The model's probability that a text is toxic."""
    if not model:
        return 0.0
    z = model[0] + sum(map(float.__mul__, model[1:], events(text, lexer)))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def score(docs: DataFrame, weights: dict[str, float], model: list[float], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row of docs, and its score (0 to 1) as `score`; `keep` may not hold that name."""
    ship(docs.sparkSession)
    kept = docs.select(*keep).schema
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(weights)
        for b in batches:
            scores = [chance(t.as_py(), lexer, model) for t in b.column("_text")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(scores, pa.float64())], names=[*names, "score"])

    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", score double"
    return docs.select(*keep, whole_text().alias("_text")).mapInArrow(run, out)


def clean(docs: DataFrame, labels: DataFrame, usable: Column, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs (doc_id, text, ...) whose score is below the threshold, as they are."""
    weights, model = fit(docs, labels, usable, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexer = Lexer(weights)
        for b in batches:
            yield b.filter(pa.array([chance(t.as_py() or "", lexer, model) < threshold for t in b.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, score) of each row, by a model fitted on the usable rows of labels."""
    weights, model = fit(docs, labels, usable, sample)
    return score(docs, weights, model)


def explain(text: str, weights: dict[str, float]) -> list[tuple[str, str]]:
    """(clause, events) of each matched clause of one text."""
    lexer, found = Lexer(weights), []
    for clause in _CLAUSES.split(text.lower()):
        state, outs = _START, []
        for w in chain(_WORDS.findall(clause)):
            state, out = GRAMMAR[state, lexer[w][0]]
            outs += [out] * (out in EVENTS)
        if outs:
            found.append((clause.strip(), "".join(outs)))
    return found
