import os

from pyspark.sql import functions as F

from typeharvest.functions.predicates import DEFAULT_REGISTRY
from typeharvest.operators import analysis, logs, summary
from typeharvest.plans import jobs
from typeharvest.sources import readers


def _write(root, rel, text):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_folders_end_to_end(spark, tmp_path):
    root, dest = str(tmp_path / "pkgs"), str(tmp_path / "out")
    _write(root, "A.jl/src/a.jl", "f(x::Vector{T}, s::\"q\") where T = 1\nstruct S{T<:Int} <: Q{T}\n  v :: Ref{<:T}\nend\n")
    _write(root, "A.jl/test/t.jl", "g(x::Ref{Pair{T, T} where T}) = x\nh(y::Vector{>:Int}) = 1\n")
    _write(root, "A.jl/src/e.jl", "")
    _write(root, "A.jl/src/notes.md", "f(x::Int) = 2")
    _write(root, "B.jl/src/b.jl", "broken(x::Int = 1\n")
    _write(root, "C.jl/README.md", "no code")
    _write(root, "top.jl", "z::Int = 1")
    os.makedirs(os.path.join(root, "D.jl"))
    log = jobs.extract_job(spark, root, dest)
    assert {(r.Package, r.File): r.status for r in log.collect()} == {
        ("A.jl", "src/a.jl"): "succ", ("A.jl", "test/t.jl"): "succ", ("A.jl", "src/e.jl"): "succ", ("B.jl", "src/b.jl"): "fail"}
    counted = readers.code_files(spark, root, src_only=True)
    assert {r.File: r.text == "" for r in counted.collect()} == {
        "src/a.jl": False, "src/e.jl": True, "src/b.jl": False}
    csv = readers.stored_table(spark, f"{dest}/type-annotations", readers.schemas.TYPE_ANNOTATIONS, "*.csv")
    stored = spark.read.parquet(f"{dest}/annotations")
    cols = ["Package", "File", "Function", "Kind", "TypeAnnotation"]
    want = sorted(tuple(r) for r in stored.select(*cols).collect())
    assert sorted(tuple(r) for r in csv.select(*cols).collect()) == want and len(want) == 4
    decls = spark.read.parquet(f"{dest}/declarations")
    packages = readers.package_dirs(spark, root).select("Package")
    totals, decl_totals = jobs.analyze_job(spark, stored, decls, dest, packages=packages)
    assert tuple(spark.read.parquet(f"{dest}/good-bad-packages").first()) == (1, 3)
    assert {r.Package for r in spark.read.parquet(f"{dest}/bad-packages").collect()} == {"B.jl", "C.jl", "D.jl"}
    flags = spark.read.parquet(f"{dest}/package-flags-type-annotations").first()
    assert (flags.Package, flags.pkgwarn, flags.pkgintr) == ("A.jl", False, True)
    got = {r.statistic: r.total for r in totals.collect()}
    assert got["total"] == 4 and got["HasWhere"] == 4 and got["Error"] == 0 and got["ExistInInv"] == 1
    assert {r.statistic: r.total for r in decl_totals.collect()}["VarCnt"] == 1
    table = spark.read.option("header", "true").csv(f"{dest}/non-imp-use-site-type-annotations")
    assert [r.TypeAnnotation for r in table.collect()] == ["Tuple{Ref{Pair{T, T} where T}}"]
    shown = {r.variable: r for r in spark.read.option("header", "true").csv(
        f"{dest}/summary-non-imp-use-site-type-annotations").collect()}
    assert (shown["HasWhere"]["min"], shown["VarCnt"]["max"], shown["ExistInInv"]["sum"]) == ("true", "1", "1")
    report = [r.line for r in jobs.census_job(spark, root, dest).collect()]
    assert report[:4] == ["Failed packages (no src folder): 2", "C.jl", "D.jl", "Good packages: 2"]
    # only the bound below src/ counts, and there is none
    assert report[4:] == ["Interesting packages: 0\nLower bounds: 0\nUnique lower bounds: 0"]
    dirs = {r.Package: r.hasSrc for r in readers.package_dirs(spark, root).collect()}
    assert dirs == {"A.jl": True, "B.jl": True, "C.jl": False, "D.jl": False}


def test_census_job_counts_empty_files(spark, tmp_path):
    root = str(tmp_path / "a dir+/a/pkgs")  # a name that needs encoding, and that occurs twice
    _write(root, "P.jl/src/one.jl", "f(x::Vector{>:Int}) = 1 # >: Bool\ng(x::Ref{>:Int}, s=\"$(T >: Q)\") = 2\n")
    _write(root, "P.jl/src/two.jl", "#= #= =# h(x::Ref{>:Int}) =#\nk(x::Ref{T}) where T >: Bool = 1\n")
    _write(root, "P.jl/src/three.jl", "")
    report = [r.line for r in jobs.census_job(spark, root, str(tmp_path / "out")).collect()]
    assert report[:2] == ["All packages processed successfully", "Good packages: 1"]
    assert report[2].startswith("P.jl: { unique/lbs: 3/4,") and report[2].endswith("Non vacuous files: 2/3")
    assert report[5] == "Interesting packages: 1\nLower bounds: 4\nUnique lower bounds: 3"
    census = {r.File: r for r in spark.read.parquet(str(tmp_path / "out/census")).collect()}
    assert {f: (r.status, r.lbs) for f, r in census.items()} == {"src/one.jl": ("ok", 3), "src/two.jl": ("ok", 1), "src/three.jl": ("vacuous", None)}


def test_paths_below_roots(spark):
    cases = [
        ("s3a://bkt/pkgs", "s3a://bkt/pkgs/A.jl/src/a.jl"), ("hdfs://nn:8020/pkgs/", "hdfs://nn:8020/pkgs/A.jl/src/a.jl"),
        ("file:/data/a", "file:///data/a/A.jl/src/a.jl"), ("file:///data/a", "file:/data/a/A.jl/src/a.jl"), ("file:/a/x/a", "file:/a/x/a/A.jl/src/a.jl"),
    ]
    for root, path in cases:
        row = spark.createDataFrame([(path,)], "p string").select(readers._under(root, F.col("p")).alias("r")).first()
        assert row.r == "A.jl/src/a.jl", root
    assert readers.qualified(spark, "rel/dir").startswith("file:/") and readers.qualified(spark, "rel/dir").endswith("/rel/dir")


def test_logs_and_lists(spark, tmp_path):
    (tmp_path / "log.txt").write_text(
        "JLSUBTYPELOG: Tuple{T} where T\nnoise\nx JLSUBTYPELOG: a JLSUBTYPELOG: Int\nJLSUBTYPELOG: Int\nJLSUBTYPELOG: Int\n")
    lines = readers.log_lines(spark, str(tmp_path / "log.txt"))
    assert [r.value for r in logs.sorted_distinct(logs.marked(lines)).collect()] == ["Int", "Tuple{T} where T"]
    assert sorted(r.value for r in logs.marked(lines, anywhere=True).collect()) == ["Int"] * 3 + ["Tuple{T} where T"]
    mined = jobs.log_job(spark, str(tmp_path / "log.txt"), str(tmp_path / "mined"))
    assert analysis.analyze_annotations(mined).agg(F.sum("VarCnt")).first()[0] == 1
    (tmp_path / "list.txt").write_text("A,u1,0.1\nB,u2,0.2\nC,u3,0.3\n")
    got = readers.package_list(spark, str(tmp_path / "list.txt"), 2).collect()
    assert [(r.name, r.version) for r in got] == [("A", "0.1"), ("B", "0.2")]


def test_summary_golden(spark):
    texts = [
        "Array{Tuple{T, Array{T, N} where N, Bool} where T}",
        "Tuple{Vararg{Union{T, Set{T}, Vector{T}} where T <: Variable}, Any}",
        "Dict{K, Union{AbstractArray{<:Number}, AbstractArray{Union{Missing, T}} where T <: Number, DataFrame}}",
        "(Tuple{Vararg{Pair{NTuple{N, K}, T} where N}} where T) where K",
        "Tuple{Vararg{Pair{NTuple{N, K}, <:Any} where N}} where K",
        "Tuple{Type{Union{Quantity{T, D, U}, Level{L, S, Quantity{T, D, U}} where {L, S}} where {T, U}}} where D",
    ]
    df = spark.createDataFrame([(t,) for t in texts], "TypeAnnotation string")
    analyzed = analysis.analyze_annotations(df).persist()
    got = {r.variable: tuple(r)[2:] for r in summary.summarize_columns(analyzed, summary.ANNOTATION_COLUMNS).collect()}
    assert got["VarCnt"] == (16 / 6, 1.0, 2.5, 5.0, 0, 16.0)
    assert got["VarsUsedOnce"] == (0.5, 0.0, 0.5, 1.0, 0, 3.0)
    assert got["RestrictedScope"] == (1 / 3, 0.0, 0.0, 1.0, 0, 2.0)
    assert {k: got[k][5] for k in ("Error", "HasWhere", "ImprUseSiteVariance", "ExistInInv", "ClosedLowerBound")} == {
        "Error": 0, "HasWhere": 6, "ImprUseSiteVariance": 0, "ExistInInv": 6, "ClosedLowerBound": 6}
    empty = summary.summarize_columns(analyzed.filter("false"), summary.ANNOTATION_COLUMNS).collect()
    assert len(empty) == len(DEFAULT_REGISTRY.columns) + 2
    assert all(tuple(r)[2:] == (0.0, 0.0, 0.0, 0.0, 0, 0.0) for r in empty)
    tables = summary.annotation_tables(analyzed)
    assert tables["exist-in-inv-type-annotations"].count() == 6
    assert tables["non-triv-consist-bnds-type-annotations"].count() == 0
    analyzed.unpersist()


def test_package_flags(spark):
    df = spark.createDataFrame([("A", "Int"), ("A", "Foo{"), ("B", "Pair{T, T} where T"), ("C", "Int")],
                               "Package string, TypeAnnotation string")
    analyzed = analysis.analyze_annotations(df)
    named = {r.Package: (r.pkgwarn, r.pkgusesite, r.pkgintr) for r in summary.annotation_package_flags(analyzed).collect()}
    assert named == {"A": (True, True, True), "B": (False, True, False), "C": (False, False, False)}
    compat = {r.Package: r.pkgintr for r in summary.annotation_package_flags(analyzed, "compat").collect()}
    assert compat == {"A": True, "B": True, "C": True}
    listed = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "Package string")
    assert tuple(summary.good_and_bad(listed, analyzed).first()) == (3, 1)
    assert [r.Package for r in readers.bad_packages(listed, analyzed).collect()] == ["D"]
