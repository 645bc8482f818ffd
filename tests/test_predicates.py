"""A registered predicate that fails costs its own column, in its own rows."""

import pytest
from pyspark.sql import functions as F

from typeharvest.functions.predicates import DEFAULT_REGISTRY, Predicate, PredicateRegistry
from typeharvest.operators import analysis, summary
from typeharvest.plans import jobs

TEXTS = ["Int", "Vector{T} where T", "Pair{T, S} where S where T", "Ref{T} where Int<:T<:Vector{Int}", "Foo{", "Ref{Ref{T} where T} where T"]


def frame(spark):
    return spark.createDataFrame([("P", f"f{i}", "f", "mtsig", t) for i, t in enumerate(TEXTS)],
                                 "Package string, File string, Function string, Kind string, TypeAnnotation string")


def second_lb(tv):
    return F.element_at(tv, 2)["lb"] == "Union{}"  # an error where there is no second variable


def registry():
    return (PredicateRegistry().register(Predicate("SecondOpen", second_lb, True, "second-open"))
            .register(Predicate("Always", lambda tv: F.raise_error(F.lit("no")).cast("boolean"), True, "always"))
            .register(Predicate("Divided", lambda tv: 6 / (F.size(tv) - 1) > 0))
            .register(Predicate("OneVariable", lambda tv: F.size(tv) == 1)))


@pytest.mark.parametrize("dedupe", [False, True])
def test_errors_become_nulls_of_one_column(spark, dedupe):
    plain = analysis.analyze_annotations(frame(spark), dedupe=dedupe)
    got = analysis.analyze_annotations(frame(spark), registry(), dedupe=dedupe)
    rows = {r.TypeAnnotation: r for r in got.collect()}
    own = {r.TypeAnnotation: r for r in plain.collect()}
    assert all(rows[t][c] == own[t][c] for t in TEXTS for c in plain.columns)
    assert [rows[t].SecondOpen for t in TEXTS] == [None, None, True, None, None, True]
    assert [rows[t].Always for t in TEXTS] == [None] * 6
    assert [rows[t].Divided for t in TEXTS] == [False, None, True, None, None, True]
    assert [rows[t].OneVariable for t in TEXTS] == [False, True, False, True, None, False]


def test_expressions_that_cannot_be_built_or_resolved(spark):
    bad = (PredicateRegistry().register(Predicate("Unbuilt", lambda tv: tv.nothing_such(1)))
           .register(Predicate("Unbuilt2", lambda tv: 1 // 0))
           .register(Predicate("Unresolved", lambda tv: F.col("no_such_column") > 1))
           .register(Predicate("Fine", lambda tv: F.size(tv) > 1)))
    with pytest.warns(UserWarning, match="null throughout"):
        rows = analysis.analyze_annotations(frame(spark), bad).collect()
    assert all(r.Unbuilt is None and r.Unbuilt2 is None and r.Unresolved is None for r in rows)
    assert sum(bool(r.Fine) for r in rows) == 2


def test_summaries_tables_and_the_job_go_on(spark, tmp_path):
    found = analysis.analyze_annotations(frame(spark), registry())
    stats = {r.variable: r for r in summary.summarize_columns(found, ["SecondOpen", "Always", "OneVariable"]).collect()}
    assert (stats["SecondOpen"].nmissing, stats["SecondOpen"].sum) == (4, 2.0)
    assert (stats["Always"].nmissing, stats["Always"].sum) == (6, 0.0) and stats["OneVariable"].nmissing == 1
    tables = summary.annotation_tables(found, registry())
    assert tables["second-open-type-annotations"].count() == 2 and tables["always-type-annotations"].count() == 0
    decls = spark.createDataFrame([("P", "f", "S", "tdstrc", "S{T}", "Any")],
                                  "Package string, File string, Name string, Kind string, TypeDeclaration string, Supertype string")
    totals, _ = jobs.analyze_job(spark, frame(spark), decls, str(tmp_path / "out"), registry())
    got = {r.statistic: r.total for r in totals.collect()}
    assert got["total"] == 6 and got["SecondOpen"] == 2 and got["Always"] == 0 and got["OneVariable"] == 2


def test_built_in_predicates_stay_plain(spark):
    plan = analysis.analyze_annotations(frame(spark))._jdf.queryExecution().optimizedPlan().toString()
    assert "tryeval" not in plan.lower() and DEFAULT_REGISTRY.columns[0] == "VarCnt"
