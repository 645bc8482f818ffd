"""Column summaries, filtered tables, package flags and corpus totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from typeharvest.functions.predicates import DEFAULT_REGISTRY, PredicateRegistry

ANNOTATION_COLUMNS = ["Error", "Warning", *DEFAULT_REGISTRY.columns]
DECLARATION_COLUMNS = [
    "Error", "Warning", "VarCnt", "TyDeclUseSiteVariance", "SuperUseSiteVariance",
    "TyDeclImpUseSiteVariance", "SuperImpUseSiteVariance", "TrivConsistBounds",
]


def summarize_columns(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """mean, min, median, max, nmissing and sum of each column, as rows.

    One row per key and variable; without keys an empty input gives zeros.
    Aggregated as counts per distinct value first: the columns are flags and
    small integers, so what a hot key sends to one task is a handful of rows,
    and the exact median is read off those counts.
    """
    keys = keys or []
    cells = F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
        for i, c in enumerate(columns)])
    unpivoted = df.select(*keys, F.explode(cells).alias("c")).select(*keys, "c.ord", "c.variable", "c.value")
    counted = unpivoted.groupBy(*keys, "ord", "variable", "value").agg(F.count("*").alias("n"))
    seen = F.col("value").isNotNull()
    out = counted.groupBy(*keys, "ord", "variable").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum(F.when(seen, F.col("n")))).alias("mean"),
        F.min("value").alias("min"),
        F.expr("percentile(value, 0.5, n)").alias("median"),
        F.max("value").alias("max"),
        F.coalesce(F.sum(F.when(~seen, F.col("n"))), F.lit(0)).alias("nmissing"),
        F.coalesce(F.sum(F.col("value") * F.col("n")), F.lit(0.0)).alias("sum"),
    )
    if not keys:
        names = df.sparkSession.range(1).select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("ord"), F.lit(c).alias("variable")) for i, c in enumerate(columns)])).alias("v")
        ).select("v.ord", "v.variable")
        zero = {"mean": 0.0, "min": 0.0, "median": 0.0, "max": 0.0, "sum": 0.0, "nmissing": 0}
        empty = F.col("n0").isNull()
        out = names.join(out.withColumn("n0", F.lit(1)), ["ord", "variable"], "left").select(
            "ord", "variable", *[F.when(empty, F.lit(v)).otherwise(F.col(c)).alias(c) for c, v in zero.items()])
    return out.select(*keys, "ord", "variable", "mean", "min", "median", "max",
                      F.col("nmissing").cast("bigint").alias("nmissing"), "sum")


# ---------------------------------------------------------------------------
# Filtered tables: a null never passes
# ---------------------------------------------------------------------------
def interesting() -> Column:
    return F.col("ImprUseSiteVariance").isNotNull() & (
        ~F.col("ImprUseSiteVariance") | ~F.col("RestrictedScope") | ~F.col("ClosedLowerBound")
        | F.col("ExistInInv") | ~F.col("TrivConsistBounds"))


def annotation_tables(analyzed: DataFrame, registry: PredicateRegistry = DEFAULT_REGISTRY) -> dict[str, DataFrame]:
    """The interesting rows and one table per predicate that declares one."""
    tables = {"interesting": analyzed.filter(interesting())}
    for p in registry.predicates:
        if p.table is not None:
            tables[p.table] = analyzed.filter(F.col(p.column) == F.lit(p.keep))
    return {f"{name}-type-annotations": df for name, df in tables.items()}


def declaration_tables(analyzed: DataFrame) -> dict[str, DataFrame]:
    c = F.col
    return {
        "non-use-site-type-declarations": analyzed.filter(
            ~c("TyDeclUseSiteVariance") | ~c("SuperUseSiteVariance") | ~c("TrivConsistBounds")),
        "non-imp-use-site-type-declarations": analyzed.filter(
            ~c("TyDeclImpUseSiteVariance") | ~c("SuperImpUseSiteVariance")),
        "non-triv-consist-bnds-type-declarations": analyzed.filter(~c("TrivConsistBounds")),
    }


# ---------------------------------------------------------------------------
# Packages and corpus
# ---------------------------------------------------------------------------
def _below_total(columns: list[str]) -> Column:
    """Some column's sum is below the number of rows: a false or a null."""
    test = F.lit(False)
    for name in columns:
        test = test | (F.coalesce(F.sum(F.col(name).cast("int")), F.lit(0)) < F.count("*"))
    return test


def annotation_package_flags(analyzed: DataFrame, mode: str = "named") -> DataFrame:
    """Package, total, pkgwarn, pkgusesite, pkgintr.

    ``named`` tests the columns the flag is about; ``compat`` tests summary rows
    7 to 9 by position, which today are ImprUseSiteVariance, ExistInInv and
    RestrictedScope, so nearly every package with rows qualifies.
    """
    by_mode = {
        "named": ["ImprUseSiteVariance", "RestrictedScope", "ClosedLowerBound"],
        "compat": [ANNOTATION_COLUMNS[i] for i in (6, 7, 8)],
    }
    return analyzed.groupBy("Package").agg(
        F.count("*").alias("total"),
        F.bool_or(F.col("Error") | F.col("Warning")).alias("pkgwarn"),
        _below_total(["UseSiteVariance"]).alias("pkgusesite"),
        _below_total(by_mode[mode]).alias("pkgintr"))


def declaration_package_flags(analyzed: DataFrame) -> DataFrame:
    return analyzed.groupBy("Package").agg(
        F.count("*").alias("total"),
        F.bool_or(F.col("Error") | F.col("Warning")).alias("pkgwarn"),
        _below_total(["TyDeclUseSiteVariance", "SuperUseSiteVariance"]).alias("pkgusesite"))


def good_and_bad(packages: DataFrame, tables: DataFrame) -> DataFrame:
    """(goodPkg, badPkg): listed packages with and without a table file."""
    present = tables.select("Package").distinct().withColumn("good", F.lit(True))
    joined = packages.select("Package").distinct().join(present, "Package", "left")
    return joined.agg(F.count_if(F.col("good")).alias("goodPkg"), F.count_if(F.col("good").isNull()).alias("badPkg"))


def corpus_totals(analyzed: DataFrame, columns: list[str]) -> DataFrame:
    """One row (statistic, total) per column plus ``total``; nulls count zero."""
    sums = analyzed.agg(F.count("*").alias("total"), *[
        F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).cast("bigint").alias(c) for c in columns])
    return sums.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("statistic"), F.col(c).alias("total")) for c in ["total", *columns]])).alias("s")
    ).select("s.statistic", "s.total")


def as_display(summary: DataFrame, boolean: list[str]) -> DataFrame:
    """min and max as text: true/false for flags, whole numbers otherwise."""

    def shown(name: str) -> Column:
        flag = F.when(F.col(name) == 1, "true").when(F.col(name) == 0, "false")
        return F.when(F.col("variable").isin(*boolean), flag).otherwise(F.col(name).cast("bigint").cast("string"))

    return summary.withColumns({"min": shown("min"), "max": shown("max"), "sum": F.col("sum").cast("bigint")})
