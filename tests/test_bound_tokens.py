"""Lower bounds of one token are printed as they are, others in the printed spacing."""

from typeharvest.operators import lowerbounds


def _files(spark, texts):
    return spark.createDataFrame([("P", f"f{i}", t) for i, t in enumerate(texts)], "Package string, File string, text string")


def test_values_of_bounds(spark):
    texts = ["f(x::Q{>:A})=1\n", "f(x::Q{>:M.B})=1\n", 'f(x::Q{>:"a  b"})=1\n', "f(x::Q{>:1})=1\n", "f(x::Q{>:Union{A,B}})=1\n", "f(x::Q{>:A+B})=1\n"]
    bounds, _ = lowerbounds.lower_bounds(_files(spark, texts))
    assert {r.File: r.value for r in bounds.collect()} == {
        "f0": "A", "f1": "M.B", "f2": '"a  b"', "f3": "1", "f4": "Union{A, B}", "f5": "A + B"}


def test_one_token_takes_no_brackets(spark):
    plan = lowerbounds.lower_bounds(_files(spark, ["x"]))[0]._jdf.queryExecution().optimizedPlan().toString()
    step = next(line for line in plan.splitlines() if "aggregate(_tok" in line)
    assert "CASE WHEN NOT (size(_tok" in step
