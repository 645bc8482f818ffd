"""Who reads flags pays for what flags are worked out from, once for each distinct text."""

import re

from typeharvest.operators import summary
from typeharvest.operators.analysis import analyze_annotations

TEXTS = [
    "Bag{W} where W>:Queue{V} where V<:A", "Heap{K, Bag{K} where L<:A} where K", "Queue{Bag{<:A}}", "Queue{Union{Bag{K}, A} where K}",
    "Queue{Heap{K, K} where K<:Pair{A, B}}", "Tuple{Bag{J}, Heap{I, J}} where {I, J<:A}", "Heap{$A, K} where K", "Bag{K} where", "bad{", "Int", None,
]


def _frame(spark):
    return spark.createDataFrame([(f"P{i % 3}", t) for i, t in enumerate(TEXTS * 4)], "Package string, TypeAnnotation string").repartition(3)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_package_flags_work_out_no_bounds(spark):
    flags = summary.annotation_package_flags(analyze_annotations(_frame(spark), dedupe=True))
    made = set(re.findall(r"AS (_\w+)#", _plan(flags)))
    assert "_sc" in made and not made & {"_bb", "_q0", "_q", "_tv", "_t", "_un"}
    bounds = analyze_annotations(_frame(spark), dedupe=True).select("TrivConsistBounds")
    assert {"_sc", "_q0", "_q"} <= set(re.findall(r"AS (_\w+)#", _plan(bounds)))


def test_flags_are_handed_on_instead_of_summaries(spark):
    plan = _plan(summary.annotation_package_flags(analyze_annotations(_frame(spark), dedupe=True)))
    handed = [line for line in plan.split("\n") if "Window [" in line and "Error" in line]
    assert len(handed) == 1 and "UseSiteVariance" in handed[0] and "TypeVarsSummary" not in handed[0]


def test_steps_hold_no_expression_that_throws_to_return(spark):
    # In and ArrayPosition are interpreted inside of lambdas, and leave their loop by an exception
    plan = _plan(analyze_annotations(_frame(spark), dedupe=True).select("Warning", "RestrictedScope", "ImprUseSiteVariance", "ClosedLowerBound"))
    assert "AS _sc#" in plan and " IN (" not in plan and "array_position" not in plan


def test_flags_of_each_text_are_those_of_its_rows(spark):
    columns = ["Package", "TypeAnnotation", "Error", "Warning", "VarCnt", "UseSiteVariance", "ImprUseSiteVariance", "ExistInInv",
               "RestrictedScope", "ClosedLowerBound", "TrivConsistBounds"]
    once = analyze_annotations(_frame(spark), dedupe=True).select(*columns)
    rows = analyze_annotations(_frame(spark)).select(*columns)
    assert sorted(once.collect(), key=repr) == sorted(rows.collect(), key=repr)


def test_a_column_named_like_a_predicate_is_replaced_in_place(spark):
    df = spark.createDataFrame([("x", "A{T} where T"), ("y", "Int")], "VarCnt string, TypeAnnotation string")
    for dedupe in (False, True):
        got = analyze_annotations(df, dedupe=dedupe)
        assert got.columns[:2] == ["VarCnt", "TypeAnnotation"] and got.columns.count("VarCnt") == 1
        assert sorted((r.TypeAnnotation, r.VarCnt) for r in got.collect()) == [("A{T} where T", 1), ("Int", 0)]


def test_variables_of_one_place_come_by_their_bounds(spark):
    # of the same name and the same way down, one in the head and one in the argument
    df = spark.createDataFrame([("(Tuple{A where S>:Z}){T where S>:B}",)], "TypeAnnotation string")
    for dedupe in (False, True):
        [row] = analyze_annotations(df, dedupe=dedupe).collect()
        assert [(v.name, v.lb, v.context) for v in row.TypeVarsSummary] == [("S", "B", ["Invar"]), ("S", "Z", ["Tuple"])]
