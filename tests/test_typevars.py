import re

import pytest
from pyspark.sql import functions as F

from golden import FLAG_COLUMNS, FLAGS
from typeharvest.functions import lexical
from typeharvest.functions.predicates import Predicate, PredicateRegistry
from typeharvest.operators.analysis import analyze_annotations
from typeharvest.operators.typevars import summarize


def _frame(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "TypeAnnotation string").repartition(2)


def _summaries(spark, texts, **kw):
    rows = summarize(_frame(spark, texts), **kw).collect()
    return {r.TypeAnnotation: r for r in rows}


def _vars(row):
    return [(v.name, v.lb, v.ub, v.occurrs, v.context) for v in row.TypeVarsSummary]


@pytest.mark.parametrize("dedupe", [False, True])
def test_golden_flags(spark, dedupe):
    df = _frame(spark, [t for t, _ in FLAGS] * 2)
    got = analyze_annotations(df, dedupe=dedupe).collect()
    assert len(got) == 2 * len(FLAGS)
    want = dict(FLAGS)
    for row in got:
        flags = "".join(str(int(row[c])) for c in FLAG_COLUMNS)
        assert (row.TypeAnnotation, flags) == (row.TypeAnnotation, want[row.TypeAnnotation])
        assert row.HasWhere == (row.VarCnt > 0) and not row.Error and not row.Warning
        assert not row.UseSiteVariance or row.ImprUseSiteVariance


def test_exact_stacks(spark):
    a = "Tuple{T, Pair{T, S} where S>:T} where T<:Number"
    b = "Pair{X, T} where X<:Number where Int<:T<:(Foo{Y} where Y>:Int)"
    got = _summaries(spark, ["Int", "T where T", a, b])
    assert _vars(got["Int"]) == []
    assert _vars(got["T where T"]) == [("T", "Union{}", "Any", [[]], [])]
    assert _vars(got[a]) == [
        ("S", "T", "Any", [["Invar"]], ["Where", "Tuple"]),
        ("T", "Union{}", "Number",
         [["Tuple"], ["Tuple", "LoBnd"], ["Tuple", "Where", "Invar"]], []),
    ]
    assert _vars(got[b]) == [
        ("Y", "Int", "Any", [["Invar"]], ["UpBnd"]),
        ("X", "Union{}", "Number", [["Invar"]], ["Where"]),
        ("T", "Int", "Foo{Y} where Y >: Int", [["Where", "Invar"]], []),
    ]


def _anon(text):
    return re.sub(r"#\d+", "#", text)


def test_unrolled_text(spark):
    cases = {
        "Tuple{Ref{>:T}} where T": "Tuple{Ref{#} where # >: T} where T",
        "Dict{<:A, >:Pair{<:B,Q}}":
            "(Dict{#, #} where # <: A) where # >: (Pair{#, Q} where # <: B)",
        "Tuple{Vararg{Pair{NTuple{N, K}, <:Any} where N}} where K":
            "Tuple{Vararg{(Pair{NTuple{N, K}, #} where # <: Any) where N}} where K",
        "Tuple{Type{Union{Q{T, D, U}, L{L, S, Q{T, D, U}} where {L, S}} where {T, U}}} where D":
            "Tuple{Type{(Union{Q{T, D, U}, (L{L, S, Q{T, D, U}} where L) where S} where T) where U}} where D",
        "Tuple{A,B} where A<:Int where B": "(Tuple{A, B} where A <: Int) where B",
        "Dict{K,Vector{Int}}": "Dict{K, Vector{Int}}",
    }
    got = _summaries(spark, list(cases))
    for text, want in cases.items():
        assert _anon(got[text].UnrolledTypeAnnotation) == want


def test_receivers_calls_and_warnings(spark):
    got = _summaries(spark, [
        "A{T{X}, typeof(T), N+1} where {T, N}", "Tuple{$x, T} where T", "Foo{(a, b)}",
        "Foo{:sym}", "Foo{\"s\", 1}", "A.B{T.x} where T", "@m(T) where T",
    ])
    t = {v.name: v for v in got["A{T{X}, typeof(T), N+1} where {T, N}"].TypeVarsSummary}
    assert t["T"].occurrs == [["Invar"], ["Invar", "Call"]]
    assert t["N"].occurrs == [["Where", "Invar", "Call"]]
    assert got["Tuple{$x, T} where T"].Warning and not got["Tuple{$x, T} where T"].Error
    assert got["Foo{(a, b)}"].Warning and got["Foo{:sym}"].Warning
    assert not got["Foo{\"s\", 1}"].Warning
    assert got["A.B{T.x} where T"].TypeVarsSummary[0].occurrs == []
    assert got["@m(T) where T"].TypeVarsSummary[0].occurrs == [["MCall"]]


def test_variable_receiver_labels_its_arguments(spark):
    text = "T{S} where {S, T}"
    v = {x.name: x for x in _summaries(spark, [text])[text].TypeVarsSummary}
    assert v["T"].occurrs == [["Where"]]
    assert v["S"].occurrs == [["Var"]]


def test_unreadable_texts_are_null_and_flagged(spark):
    bad = ["Foo{", "Foo}", "Ref{T<:Int}", "", "a b", "{A, B}", "x::Int", "Foo{A,,B}",
           "T where", "T where {}", "T where A.B", "T where S<:Q<:U>:V", "Foo[1]", "[1]"]
    rows = analyze_annotations(_frame(spark, [*bad, None])).collect()
    assert len(rows) == len(bad) + 1
    for r in rows:
        assert r.Error and r.Warning and r.TypeVarsSummary is None, r
        assert r.VarCnt is None and r.UseSiteVariance is None


def test_sharp_retry(spark):
    got = _summaries(spark, ["##ANON#1", "#T where T"])
    assert got["##ANON#1"].UnrolledTypeAnnotation == "XXANONX1"
    assert not got["##ANON#1"].Error


def test_registry_extension(spark):
    registry = PredicateRegistry().register(
        Predicate("AnyUnused", lambda tv: F.exists(tv, lambda v: F.size(v["occurrs"]) == 0)))
    df = _frame(spark, ["Int where T", "Ref{T} where T"])
    got = {r.TypeAnnotation: r.AnyUnused for r in analyze_annotations(df, registry).collect()}
    assert got == {"Int where T": True, "Ref{T} where T": False}
    assert registry.columns[-1] == "AnyUnused"


def test_repeated_texts_are_summarised_on_their_rows(spark):
    """No summary is shuffled, copied for salts or joined back; a text of very many rows is dealt over keys."""
    texts = ["A{T} where T", "Int", "B{<:C}", "bad{", None] * 3 + ["Hot{T, T} where T"] * 20
    plain = sorted(summarize(_frame(spark, texts)).collect(), key=repr)
    for hot in (3, 100_000):
        df = summarize(_frame(spark, texts), dedupe=True, hot=hot)
        assert sorted(df.collect(), key=repr) == plain
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_unread_text_is_not_worked_out(spark):
    """Who reads flags only does not pay for the unrolled text."""
    for dedupe in (False, True):
        df = analyze_annotations(_frame(spark, ["A{T} where T"]), dedupe=dedupe)
        plan = df.select("Error", "Warning", "VarCnt", "TrivConsistBounds")._jdf.queryExecution().optimizedPlan().toString()
        assert "AS _err" in plan and "AS _un#" not in plan and "AS _r0#" not in plan


def test_bracket_steps_agree(spark):
    texts = ["", "A", "f(a, [b], {c{d}})", "(", ")", "(]", "a)}", "{{}", "@m{x} where {A.B<:'c', var\"x\"}", "[(1.5, \"s\")]{}()"]
    df = spark.createDataFrame([(t,) for t in texts], "x string").withColumn("tok", lexical.snippet_tokens(F.col("x")))
    df = df.withColumn("old", F.expr(lexical.bracketed("tok")))
    for name, sql in lexical.bracket_steps("tok", "new"):
        df = df.withColumn(name, F.expr(sql))
    for r in df.collect():
        assert r.new == (None if r.old.bad else r.old.out), r.x
