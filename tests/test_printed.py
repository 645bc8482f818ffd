"""Printed fields: golden lines, round trips, records that are none, numbers of lines in files read in blocks."""

import glob
import random

import pytest
from pyspark.sql import functions as F

from typeharvest.functions import printed
from typeharvest.sources import readers, schemas, writers

# Texts and how the printer shows them
GOLDEN = {
    "Vector{T} where T": "Vector{T} where T", 'Val{"a"}': 'Val{\\"a\\"}', "Q{$x}": "Q{\\$x}", "a\\b": "a\\\\b", "\\n": "\\\\n",
    "one\ntwo\r\tx": "one\\ntwo\\r\\tx", "\a\b\v\f\x1b": "\\a\\b\\v\\f\\e", "\x00": "\\0", "\x007": "\\x007", "\x008": "\\08",
    "\x01\x1f\x7f": "\\x01\\x1f\\x7f", "ähre ∈ 日本 𝒳": "ähre ∈ 日本 𝒳", "\u200b": "\\u200b", "\u200ba": "\\u200ba", "\x85": "\\u85",
    "\x85b": "\\u0085b", "\U000e0001": "\\Ue0001", "\U000e0001f": "\\U000e0001f", "": "", "\u2028.": "\\u2028.",
}


def shown(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(printed.escaped(F.col("t"))).collect()]


def test_golden(spark):
    assert dict(zip(GOLDEN, shown(spark, GOLDEN))) == GOLDEN


def test_round_trip_of_any_text(spark):
    rng = random.Random(3)
    alphabet = list('\\"$,{}\' \n\t\r\x00\x01\x02\x1f7aFgxuU0') + ["ä", "日", "\u200b", "\x85", "𝒳", "\U000e0001", "\ufeff"]
    rows = [tuple("".join(rng.choices(alphabet, k=rng.randint(0, 12))) for _ in range(3)) for _ in range(600)]
    rows += [("$" * 50_000, "\\" * 50_001, '"\n' * 30_000), ("", "", ""), ('","', '\\","', ",")]
    df = spark.createDataFrame(rows, "a string, b string, c string").withColumn("line", printed.line([F.col(c) for c in "abc"]))
    fields, wrong = printed.parsed(F.col("line"), 3)
    for r in df.select("a", "b", "c", "line", fields.alias("f"), wrong.alias("w")).collect():
        assert r.w is None and tuple(r.f) == (r.a, r.b, r.c)
        assert not set(map(chr, range(32))) & set(r.line)


WRONG = [
    ('"a","b"', "fields"), ('"a","b","c","d","e"', "fields"), ("a,b,c,d", "quotes"), ('"a","b","c","d', "quotes"), ('"a" ,"b","c","d"', "quotes"),
    ('"a","b","c"d","e"', "quotes"), ('"a","b","c","d\\q"', "escape"), ('"a","b","c","\\xff"', "escape"), ('"a","b","c","\\ud800"', "escape"),
    ('"a","b","c","\\U110000"', "escape"), ('"a","b","c","x\ty"', "control"), ('x"a","b","c","d"', "quotes"), ('"a","b","c","d\\"', "quotes"), ("junk", "quotes"),
]


def test_lines_that_are_no_records(spark, tmp_path):
    good = '"src/a.jl","f","mtsig","Tuple{\\$x}"'
    folder = tmp_path / "A.jl"
    folder.mkdir()
    body = "\n".join(x for pair in zip([good] * len(WRONG), [w for w, _ in WRONG]) for x in pair)
    (folder / "type-annotations.csv").write_text("File,Function,Kind,TypeAnnotation\n" + body + "\n")
    (tmp_path / "B.jl").mkdir()
    (tmp_path / "B.jl" / "type-annotations.csv").write_text("File,Function,Kind,TypeAnnotation\n")
    rows = readers.type_annotations(spark, str(tmp_path)).collect()
    assert [tuple(r) for r in rows] == [("A.jl", "src/a.jl", "f", "mtsig", "Tuple{$x}")] * len(WRONG)
    errors = readers.stored_errors(spark, str(tmp_path), schemas.TYPE_ANNOTATIONS, "type-annotations.csv").collect()
    assert sorted((r.record, r.kind, r.value) for r in errors) == [(2 * i + 2, kind, w) for i, (w, kind) in enumerate(WRONG)]
    assert {r.Package for r in errors} == {"A.jl"} and all(r.file.endswith("/A.jl/type-annotations.csv") for r in errors)


def test_written_files_are_the_printers_bytes(spark, tmp_path):
    rows = [("A.jl", "src/a.jl", 9, 0, "g", "mtsig", 'Tuple{Val{"x"}}'), ("A.jl", "src/a.jl", 2, 1, "f", "retty", "Q{\n  $T}"),
            ("A.jl", "src/a.jl", 2, 0, "f", "mtsig", "Tuple{}"), ("B=b/é", "src/b.jl", 0, 0, "\\", "mtsig", "")]
    df = spark.createDataFrame(rows, "Package string, File string, Pos long, Ord int, Function string, Kind string, TypeAnnotation string")
    writers.write_annotations(df, str(tmp_path / "out"))
    (path,) = glob.glob(str(tmp_path / "out/Package=A.jl/*.csv"))
    assert open(path, "rb").read().decode() == (
        'File,Function,Kind,TypeAnnotation\n"src/a.jl","f","mtsig","Tuple{}"\n"src/a.jl","f","retty","Q{\\n  \\$T}"\n'
        '"src/a.jl","g","mtsig","Tuple{Val{\\"x\\"}}"\n')
    back = readers.stored_table(spark, str(tmp_path / "out"), schemas.TYPE_ANNOTATIONS, "*.csv")
    assert sorted(map(tuple, back.collect())) == sorted((r[0], r[1], *r[4:]) for r in rows)
    assert readers.stored_errors(spark, str(tmp_path / "out"), schemas.TYPE_ANNOTATIONS, "*.csv").count() == 0


@pytest.mark.parametrize("block", ["128m", "300"])
def test_numbers_and_first_packages_of_lists_in_blocks(spark, tmp_path, block):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    lists = {"a.txt": 200, "b.txt": 7, "c.txt": 0}
    for name, n in lists.items():
        text = "".join("\n" if i % 10 == 4 else f"{name[0]}{i},u{i},0.{i}\n" for i in range(n))
        (tmp_path / name).write_text(text)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", block)
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        rows = readers.package_list(spark, str(tmp_path)).collect()
        assert [(r.name, r.uuid, r.version, r.line) for r in rows] == [
            (f"{f[0]}{i}", f"u{i}", f"0.{i}", i) for f, n in lists.items() for i in range(n) if i % 10 != 4]
        for first in (1, 5, 181, 1000):
            assert readers.package_list(spark, str(tmp_path), first).collect() == rows[:first]
        assert block != "300" or readers.text_lines(spark, str(tmp_path)).select("block").distinct().count() > 5
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
