import math
import random

import pytest
from pyspark.sql import functions as F

from typeharvest.llm import language, queries, toxicity

PIECES = frozenset(["▁", "▁th", "th", "e", "he", "t", "h", "▁the", "er", "r"])


def segmentations(word):
    if not word:
        yield []
    for k in range(1, len(word) + 1):
        if word[:k] in PIECES or k == 1:
            for rest in segmentations(word[k:]):
                yield [word[:k], *rest]


def test_forward_sums_all_segmentations():
    model = {"a": {"th": 0.2, "e": 0.1, "▁": 0.3, "▁the": 0.05, "": 0.01}, "b": {"he": 0.3, "": 0.002}}
    scorer = language.Scorer(model, PIECES)
    for word in ("the", "there", "xyz", "t"):
        logs = scorer.totals([language.words_of(word)])[0]
        for k, lang in enumerate(scorer.languages):
            p = sum(math.prod(model[lang].get(x, model[lang][""]) for x in s) for s in segmentations(f"▁{word}"))
            assert logs[k] == pytest.approx(math.log(p))


def test_pieces_of_any_length():
    path = queries.public_tokenizers.path("piece_bpe_32k.model")
    pieces = language.vocabulary(path)
    long = max(pieces, key=lambda p: (len(p), p))
    assert len(long) == language.longest_of(pieces) == 16 and len(pieces) > 23_000
    word = long.removeprefix("▁")
    scorer = language.Scorer({"a": {long: 0.5, "": 1e-9}, "b": {"": 1e-9}}, pieces)

    def total(text, own):  # over all segmentations, by the first piece
        sums = [0.0] * len(text) + [1.0]
        for i in range(len(text) - 1, -1, -1):
            sums[i] = sum(own.get(text[i:j], own[""]) * sums[j] for j in range(i + 1, len(text) + 1) if text[i:j] in pieces or j == i + 1)
        return sums[0]

    for text in (word, f"un{word}en"):
        logs = scorer.totals([language.words_of(text)])[0]
        assert logs == pytest.approx([math.log(total(f"▁{text}", own)) for own in ({long: 0.5, "": 1e-9}, {"": 1e-9})])
        assert long[0] != "▁" or text != word or logs[0] > logs[1] + 10


def test_each_language_has_its_share(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "CAST(id AS string) AS text", "CASE WHEN id < 3 THEN 'aa' WHEN id < 300 THEN 'bb' ELSE 'cc' END AS lang")
    got = {r.lang: r["count"] for r in language.sample_rows(docs.unionByName(docs), F.lit(True), 100).groupBy("lang").count().collect()}
    assert got["aa"] == 6 and sum(got.values()) == 200 and abs(got["bb"] - got["cc"]) <= 2


def test_expected_counts_match_enumeration():
    number = language.numbered(PIECES)
    probability = language.np.full(len(PIECES) + 2, 0.05)
    probability[number["the"] if "the" in number else number["th"]] = 0.4
    probability[-1] = 0
    counts = language.Lattice(["▁the"], number, 4).expected(probability, language.np.array([3.0]))
    total, want = 0.0, dict.fromkeys(range(len(counts)), 0.0)
    for s in segmentations("▁the"):
        ids = [number.get(x, 0) for x in s]
        p = math.prod(probability[i] for i in ids)
        total += p
        for i in ids:
            want[i] += 3 * p
    assert counts.tolist() == pytest.approx([want[i] / total for i in range(len(counts))])


def test_language_of_odd_rows(spark, frame):
    assert language.words_of("a" * 60 + " É1b") == ["▁" + "a" * 24, "a" * 24, "a" * 12, "▁é", "▁b"]
    assert language.words_of("b" * 24 + " " + "c" * 25) == ["▁" + "b" * 24, "▁" + "c" * 24, "c"]
    pieces = queries.public_tokenizers.path("piece_bpe_32k.model")
    model = {"x": {"a": 0.5, "": 1e-4}, "y": {"b": 0.5, "": 1e-4}}
    rows = [(1, "aaa"), (1, "bbb"), (None, "bb"), (2, None), (3, ""), (4, "12 !"), (5, "a" * 100_000), (6, "zzz")]
    got = [(r.doc_id, r.lang_pred, r.score > 0) for r in language.predict(frame(rows), model, pieces).collect()]
    assert got == [(1, "x", True), (1, "y", True), (None, "y", True), (2, "und", False), (3, "und", False), (4, "und", False), (5, "x", True), (6, "x", True)]
    none = frame([(1, "text")]).withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(none, F.lit(True), pieces) == {}
    assert language.predict(none, {}, pieces).first().lang_pred == "und"
    assert language.predict(frame([]), model, pieces).collect() == []


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    rows = queries.op9_language_id(spark, sf).join(lang, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_grammar():
    lexer = toxicity.Lexer({"=fool": 2.0, "brut": 1.5})
    kinds = lambda text: "".join(k for k, x in zip(toxicity.EVENTS, toxicity.events(text, lexer)) if x)
    assert kinds("a fool") == "I" and kinds("you fool") == "J" and kinds("you are a brutish one") == "J"
    assert kinds("not a fool") == "i" and kinds("you are not a fool") == "j"
    assert kinds("i said fool") == "r" and kinds("i will kill you") == "" and kinds("you i kill") == "H"
    assert kinds("nothing here. no. a fool") == "I" and kinds("") == "" and kinds("kill time") == ""


def test_toxicity_of_odd_rows(spark, frame):
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 1), (2, 0, None), (1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, "x"), (1, "x"), (None, None), (3, ""), (4, "word " * 100_000)]
    got = toxicity.toxicity(frame(rows), labels, F.lit(True)).collect()
    assert len(got) == 5 and all(r.score == 0 for r in got)
    assert len(toxicity.clean(frame(rows), labels, F.lit(True)).collect()) == 5
    assert toxicity.toxicity(frame([]), labels, F.lit(True)).collect() == []


def test_toxicity_of_an_id_in_many_rows(spark, frame):
    rows = [(i, f"the word w{i % 7} is here") for i in range(60)] + [(i, f"you are a grobian w{i % 7}") for i in range(60, 120)]
    labels = spark.createDataFrame([(i, 1, int(i >= 60)) for i in range(120)], "doc_id long, quality int, toxic int")
    hot = [rows[60]] * 3000
    _, once = toxicity.fit(frame(rows), labels, F.lit(True))
    _, often = toxicity.fit(frame(rows + hot), labels, F.lit(True))
    assert len(once) == len(often) > 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").where("toxic IS NOT NULL")
    held = [(r.score, r.toxic) for r in queries.op3_toxicity(spark, sf).join(labels, "doc_id").where("held_out").collect()]
    toxic, clean = ([s for s, t in held if t == k] for k in (1, 0))
    area = sum((a > b) + (a == b) / 2 for a in toxic for b in clean) / (len(toxic) * len(clean))
    assert len(toxic) >= 100 and area >= 0.95


def test_toxicity_learns(spark, frame):
    rnd = random.Random(1)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    rows, marks = [], []
    for i in range(600):
        text = [rnd.choice(words) for _ in range(30)]
        if i % 5 == 0:
            for _ in range(2):
                text.insert(rnd.randrange(30), rnd.choice(["grobian", "grobianisch", "lout"]))
        rows.append((i, " ".join(text)))
        marks.append((i, 1, int(i % 5 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    scored = toxicity.toxicity(frame(rows), labels, F.col("doc_id") % 3 != 0).where("doc_id % 3 = 0").collect()
    assert sum((r.score >= toxicity.THRESHOLD) == (r.doc_id % 5 == 0) for r in scored) >= 0.97 * len(scored)


def test_sample_of_a_table_with_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "ein haus", "de", 5, 7), (2, "a house", "en", 6, 8), (3, "x", None, 1, 1)], "doc_id long, text string, lang string, id int, h int")
    assert sorted(map(tuple, language.sample_rows(docs, F.col("id") > 0, 10).collect())) == [("de", "ein haus"), ("en", "a house")]
