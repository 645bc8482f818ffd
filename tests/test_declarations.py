from typeharvest.operators import declarations
from typeharvest.operators.analysis import analyze_declarations
from pyspark.sql import functions as F


def _split(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "TypeDeclaration string")
    return {r.TypeDeclaration: (r._name, r._params, r._vars)
            for r in declarations.split_declaration(df).collect()}


def test_split_declaration(spark):
    got = _split(spark, ["Bar", "Zoo{T}", "Foo{Int<:X<:Number, Y<:Vector{X}}", "A{T>:Vector}", "Foo{"])
    assert got["Bar"] == ("Bar", [], [])
    assert got["Zoo{T}"] == ("Zoo", ["T"], ["T"])
    assert got["Foo{Int<:X<:Number, Y<:Vector{X}}"] == (
        "Foo", ["Int <: X <: Number", "Y <: Vector{X}"], ["X", "Y"])
    assert got["A{T>:Vector}"] == ("A", ["T >: Vector"], ["T"])
    assert got["Foo{"][1] is None


def test_wrap_in_where(spark):
    df = spark.createDataFrame(
        [("Int", []), ("Ref{X}", ["X>:Missing"]), ("Foo{X, Y}", ["X", "Y<:Ref{X}"])],
        "t string, v array<string>")
    got = [r[0] for r in df.select(declarations.wrap_in_where(F.col("t"), F.col("v"))).collect()]
    assert got == ["Int", "Ref{X} where X>:Missing", "(Foo{X, Y} where Y<:Ref{X}) where X"]


def test_analysis(spark):
    muon_super = ("AbstractAlignedMapping{T, K, Union{AbstractArray{<:Number}, "
                  "AbstractArray{Union{Missing, T}} where T <: Number, AbstractDataFrame}}")
    tree = ("Tree{String <: A <: String, Vector{Int64} <: B <: Vector{Int64}, "
            "Vector{Vector{Int64}} <: C <: Vector{Vector{Int64}}, D <: Vector{Float64}}")
    df = spark.createDataFrame(
        [("Foo{T<:Number, S<:Vector{T}}", "Bar{T, T}"), ("Bar", "Foo"), ("Ref{X}", "AbsRef"),
         ("AlignedMapping{T <: Tuple, K, R}", muon_super), (tree, "Any"), ("Foo{", "Any")],
        "TypeDeclaration string, Supertype string")
    got = {r.TypeDeclaration: r for r in analyze_declarations(df).collect()}
    r = got["Foo{T<:Number, S<:Vector{T}}"]
    assert (r.ProcessedTypeDecl, r.VarCnt, r.ProcessedSuper) == (
        "(Foo{T, S} where S <: Vector{T}) where T <: Number", 2, "(Bar{T, T} where S) where T")
    assert (r.TyDeclUseSiteVariance, r.SuperUseSiteVariance) == (False, False)
    assert (got["Bar"].ProcessedTypeDecl, got["Bar"].VarCnt, got["Bar"].ProcessedSuper) == ("Bar", 0, "Foo")
    assert got["Ref{X}"].ProcessedSuper == "AbsRef where X"
    m = got["AlignedMapping{T <: Tuple, K, R}"]
    assert (m.Error, m.Warning, m.VarCnt) == (False, False, 3)
    assert m.ProcessedTypeDecl == "((AlignedMapping{T, K, R} where R) where K) where T <: Tuple"
    assert (m.TyDeclUseSiteVariance, m.SuperUseSiteVariance, m.TyDeclImpUseSiteVariance,
            m.SuperImpUseSiteVariance, m.TrivConsistBounds) == (True, False, True, False, True)
    t = got[tree]
    assert (t.VarCnt, t.ProcessedSuper, t.TrivConsistBounds) == (
        4, "(((Any where D) where C) where B) where A", False)
    bad = got["Foo{"]
    assert bad.Error and bad.Warning and bad.VarCnt is None and bad.TrivConsistBounds is None
