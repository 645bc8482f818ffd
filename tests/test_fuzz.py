"""No text may end a job: random token sequences go through every operator over texts."""

import random

from typeharvest.operators import analysis, extract, lowerbounds

TOKENS = [
    "A", "B", "T", "S", "where", "{", "}", "(", ")", "[", "]", ",", "<:", ">:", "::", "...", "1", '"s"', "'c'", ":", "$", ".", "=", "->", "+",
    "@m", "#", "\n", "end", "f", "struct", "function", "do", "#=", "=#", ";", "`", '"', "'",
]
KNOWN_BAD = ["where", "where T", "A{where}", "A{where T}", "(where T)"]


def texts(seed, n):
    rnd = random.Random(seed)
    return KNOWN_BAD + ["", " "] + [rnd.choice(("", " ")).join(rnd.choice(TOKENS) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_annotations_and_declarations(spark):
    rows = texts(1, 1500)
    df = spark.createDataFrame([(t,) for t in rows], "TypeAnnotation string").repartition(4)
    got = {r.TypeAnnotation: r for r in analysis.analyze_annotations(df).collect()}
    assert len(got) == len(set(rows))
    assert all(got[t].Error and got[t].Warning and got[t].TypeVarsSummary is None for t in KNOWN_BAD)
    decls = spark.createDataFrame([(t, s) for t, s in zip(rows, reversed(rows))], "TypeDeclaration string, Supertype string").repartition(4)
    assert len(analysis.analyze_declarations(decls).collect()) == len(rows)


def test_files(spark):
    rows = texts(2, 600)
    files = spark.createDataFrame([("P", f"f{i}", t) for i, t in enumerate(rows)], "Package string, File string, text string").repartition(4)
    assert len(lowerbounds.file_census(files).collect()) == len(rows)
    out = extract.extract(files)
    assert len(out.file_log.collect()) == len(rows)
    out.annotations.collect(), out.declarations.collect(), out.errors.collect()
