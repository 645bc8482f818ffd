"""The steps of a summary that are left out where they change nothing."""

from pyspark.sql import functions as F

from typeharvest.functions import lexical
from typeharvest.operators import typevars


def _bounds(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "TypeAnnotation string")
    return {r.TypeAnnotation: [(v.name, v.lb, v.ub) for v in r.TypeVarsSummary] for r in typevars.summarize(df).collect()}


def test_bounds_of_one_token_and_of_more(spark):
    assert _bounds(spark, [
        "Q{T} where T<:A", "Q{T} where A<:T<:M.B", "Q{T} where T<:Q{A}", "Q{<:A}", "Q{>:Q{<:A}}", "Q{T} where T<:(Q{S} where S)", "Q{T} where T<:1",
    ]) == {
        "Q{T} where T<:A": [("T", "Union{}", "A")],
        "Q{T} where A<:T<:M.B": [("T", "A", "M.B")],
        "Q{T} where T<:Q{A}": [("T", "Union{}", "Q{A}")],
        "Q{<:A}": [("#2", "Union{}", "A")],
        "Q{>:Q{<:A}}": [("#5", "Union{}", "A"), ("#2", "Q{#5} where #5 <: A", "Any")],
        "Q{T} where T<:(Q{S} where S)": [("S", "Union{}", "Any"), ("T", "Union{}", "Q{S} where S")],
        "Q{T} where T<:1": [("T", "Union{}", "1")],
    }


def test_one_name_as_a_bound_needs_no_pieces(spark):
    # pieces are made of the bounds that are left in _bb; a path entry carries no interval's own lists
    df = spark.createDataFrame([("Q{T} where T<:A",), ("Q{T} where A<:T<:M.B",), ("Q{<:A}",), ("Q{T} where T<:Q{A}",)], "text string")
    df = df.withColumn("_src", lexical.snippet_tokens(df.text))
    for name, sql in [*lexical.bracket_steps("_src", "_t"), *typevars._sources()]:
        df = df.withColumn(name, F.expr(sql))
        if name == "_q":
            break
    got = {r.text: (len(r._bb), "".join(q.s for q in r._q or ())) for r in df.select("text", "_bb", "_q").collect()}
    assert got == {"Q{T} where T<:A": (0, ""), "Q{T} where A<:T<:M.B": (0, ""), "Q{<:A}": (0, ""), "Q{T} where T<:Q{A}": (1, "Q{A}")}
    entry = df.schema["_o0"].dataType.elementType["path"].dataType.elementType
    assert "array" not in entry.simpleString()
