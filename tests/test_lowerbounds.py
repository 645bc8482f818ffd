from pyspark.sql import functions as F

from typeharvest.functions import lexical
from typeharvest.operators import lowerbounds as L


def _files(spark, texts, package="P"):
    return spark.createDataFrame(
        [(package, f"src/f{i}.jl", t) for i, t in enumerate(texts)],
        "Package string, File string, text string")


def _bounds(spark, texts):
    rows = L.file_census(_files(spark, texts)).collect()
    by = {r.File: r for r in rows}
    return [by[f"src/f{i}.jl"] for i in range(len(texts))]


def test_text_counts(spark):
    cases = [("", 0, 0), (":", 0, 0), ("<", 0, 0), (">:", 0, 1), ("<:<", 1, 0), ("{>:}", 0, 1), (" >::", 0, 1),
             ("where Int<:T<:Number", 2, 0), ("<: T>:Int Nothing<:S<:Number", 3, 1),
             ("< : T>:Int >:>: S>:Number </:", 0, 4)]
    df = _files(spark, [c[0] for c in cases])
    got = {r.File: (r["sub"], r["sup"]) for r in L.text_counts(df).collect()}
    assert [got[f"src/f{i}.jl"] for i in range(len(cases))] == [c[1:] for c in cases]
    one = df.select(*lexical.pattern_counts("text", {"n": "Number"})).agg(F.sum("n")).first()[0]
    assert one == 3


def test_bounds_per_file(spark):
    cases = [
        ("keep(m::Matrix{<:Gray}) = m", []),
        ("size2(q::Q) where Q = 1", []),
        ("drop(m::Matrix{>:Gray}) = m", ["Gray"]),
        ("zip2(t::Table{>:Char, Row, >:Gray}) = t", ["Char", "Gray"]),
        ("head(b::B) where B>:Gray", ["Gray"]),
        ("put(b::B) where {Real<:K<:Number, B>:Gray} = b", ["Gray", "Real"]),
        ("new(b::B) where K<:Number where Gray<:B = b", []),
        ("mix(a::P, b::Q) where P>:Gray where Q>:Gray = a", ["Gray", "Gray"]),
        ("long(a::P) where P>:Bool where {Gray<:R<:Real, M<:Real} where Gray<:L<:P = a", ["Bool", "Gray", "Gray"]),
        ("odd(a::P) where Real>:P>:Gray = a", []),
        ("add(x::T) where {T>:Gray, S<:Real} = x\nconst LIMIT = 9\nmul(p::Q) where Gray<:Q<:Real = p\nlist(v::Vector{>:Char}) = v\n",
         ["Char", "Gray", "Gray"]),
        ("peek(x::T) where T>:Real = x\nshow(peek(3))\npoke(x::T) where T>:Gray = x\n", ["Gray", "Real"]),
        (">:", []),
        ("# a where T>:Int\nnote = \"T>:Int\" # >:Q\n#= A>:B =# get(x) where T>:Pair{ Gray,B } = 1", ["Pair{Gray, B}"]),
        ("List{>:Ref{>:Gray}}", ["Gray", "Ref{>:Gray}"]),
        ("if T >: Gray\n  x\nelseif a && S >: kind(b) || c\n y\nend", ["Gray", "kind(b)"]),
        ("s = \"$(a(b(\"k # z\")))\"; h(x::Vector{>:Gray}) = 1", ["Gray"]),
        ("#= a #= b =# x T>:Q =#\ngood(x::Ref{>:Gray}) = 1", ["Gray"]),
        ("t = \"$(T >: Gray)\"", ["Gray"]),
    ]
    for (text, want), row in zip(cases, _bounds(spark, [c[0] for c in cases])):
        got = sorted(v for e in row.lbsFreq or [] for v in [e.value] * e.freq)
        assert (text, got) == (text, want)
        if row["sub"] + row["sup"] == 0:
            assert row.status == "vacuous" and row.lbs is None
        else:
            assert row.status == "ok"
            assert row.lbs == len(want) and row.lbsUnique == len(set(want))


def test_file_status(spark):
    rows = _bounds(spark, ["", "<", "f(x::T) wher T>:Int = 0", "f(x::{T>:Int} = 0", None, "x <: \"abc"])
    assert [r.status for r in rows] == ["vacuous", "vacuous", "error", "error", "error", "error"]
    assert [r["sup"] for r in rows[:3]] == [0, 0, 1]
    assert all(r.lbs is None for r in rows)


def test_package_census_and_report(spark):
    files = spark.createDataFrame([
        ("Real.jl", "src/two.jl",
         "put(b::B, k::K) where {B>:Symbol, Int<:K<:Real} where M>:Bool = b\n\n\n"
         "take(q::Queue{>:Text}, r::Ring{>:B}) where B<:Real = q\n"),
        ("Real.jl", "src/use.jl", "peek(x::T) where T>:Any = x\npoke(x::T) where T>:Int = x\n"),
        ("Real.jl", "src/empty.jl", ""),
    ], "Package string, File string, text string")
    packages = spark.createDataFrame(
        [("Real.jl", True), ("Empty.jl", True), ("Bad.jl", False)], "Package string, hasSrc boolean")
    census = L.file_census(files)
    got = {r.Package: tuple(r)[1:] for r in L.package_census(packages, census).collect()}
    assert got == {"Real.jl": (True, 3, 0, 2, 7, 6), "Empty.jl": (True, 0, 0, 0, 0, 0),
                   "Bad.jl": (False, 0, 0, 0, 0, 0)}
    rolled = {(r.level, r.File): (r.lbs, r.lbsUnique) for r in L.roll_up(L.exploded(census)).collect()}
    assert rolled[("corpus", None)] == (7, 6) and rolled[("package", None)] == (7, 6)
    assert rolled[("file", "src/two.jl")] == (5, 5) and rolled[("file", "src/use.jl")] == (2, 2)
    lines = [r.line for r in L.report_rows(packages, census).collect()]
    assert lines[:3] == ["Failed packages (no src folder): 1", "Bad.jl", "Good packages: 2"]
    lines = lines[3:]
    assert lines[0].startswith("Real.jl: { unique/lbs: 6/7,\n  Int      => 2, Any      => 1")
    assert lines[0].endswith("Non vacuous files: 2/3")
    assert lines[1].startswith("* src/two.jl => (<: 3, >: 4)\n{ unique/lbs: 5/5,")
    assert lines[3] == "Interesting packages: 1\nLower bounds: 7\nUnique lower bounds: 6"
    assert lines[4] == "Int      => 2"


def test_multiset_union_adds(spark):
    a = spark.createDataFrame([(1, 1), (2, 2), (3, 1)], "value int, freq bigint")
    b = spark.createDataFrame([(5, 1), (1, 1)], "value int, freq bigint")
    got = {r.value: r.freq for r in L.multiset_sum(a.unionByName(b), []).collect()}
    assert got == {1: 2, 2: 2, 3: 1, 5: 1}
