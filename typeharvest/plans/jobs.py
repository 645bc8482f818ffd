"""The jobs end to end. Each writes its expensive table once and reads it back,
so the tables and summaries after it neither recompute nor depend on executors
staying alive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from typeharvest.functions.predicates import DEFAULT_REGISTRY, PredicateRegistry
from typeharvest.operators import analysis, extract, logs, lowerbounds, summary
from typeharvest.session import tune
from typeharvest.sources import readers, writers


def extract_job(spark: SparkSession, packages: str, dest: str) -> DataFrame:
    """Package folders to annotation and declaration tables; returns the file log."""
    tune(spark)
    extract.marked(readers.code_files(spark, packages)).write.mode("overwrite").parquet(f"{dest}/marks")
    out = extract.tables(spark.read.parquet(f"{dest}/marks"))
    writers.source_ordered(out.annotations).write.mode("overwrite").parquet(f"{dest}/annotations")
    writers.source_ordered(out.declarations).write.mode("overwrite").parquet(f"{dest}/declarations")
    out.errors.write.mode("overwrite").parquet(f"{dest}/extract_errors")
    out.file_log.write.mode("overwrite").parquet(f"{dest}/file_log")
    writers.write_annotations(spark.read.parquet(f"{dest}/annotations"), f"{dest}/type-annotations")
    writers.write_declarations(spark.read.parquet(f"{dest}/declarations"), f"{dest}/type-declarations")
    return spark.read.parquet(f"{dest}/file_log")


def analyze_job(
    spark: SparkSession, annotations: DataFrame, declarations: DataFrame, dest: str,
    registry: PredicateRegistry = DEFAULT_REGISTRY, dedupe: bool = True, packages: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Analyzed tables, package summaries and flags, filtered tables; returns
    corpus totals. ``packages`` (Package): the list that good and bad packages
    are told from."""
    tune(spark)
    analysis.analyze_annotations(annotations, registry, dedupe=dedupe).write.mode("overwrite").parquet(
        f"{dest}/analyzed-annotations")
    analysis.analyze_declarations(declarations).write.mode("overwrite").parquet(f"{dest}/analyzed-declarations")
    anns = spark.read.parquet(f"{dest}/analyzed-annotations")
    decls = spark.read.parquet(f"{dest}/analyzed-declarations")
    columns = ["Error", "Warning", *registry.columns]
    writers.write_analyzed(anns, f"{dest}/analyzed-type-annotations")
    writers.write_analyzed(decls, f"{dest}/analyzed-type-declarations")
    writers.write_summaries(summary.summarize_columns(anns, columns, ["Package"]), f"{dest}/summary-type-annotations")
    writers.write_summaries(
        summary.summarize_columns(decls, summary.DECLARATION_COLUMNS, ["Package"]), f"{dest}/summary-type-declarations")
    flags = {"annotations": summary.annotation_package_flags(anns), "declarations": summary.declaration_package_flags(decls)}
    for name, df in flags.items():
        df.write.mode("overwrite").parquet(f"{dest}/package-flags-type-{name}")
    if packages is not None:
        summary.good_and_bad(packages, anns).write.mode("overwrite").parquet(f"{dest}/good-bad-packages")
        readers.bad_packages(packages, anns).write.mode("overwrite").parquet(f"{dest}/bad-packages")
    ann_tables = summary.annotation_tables(anns, registry)
    decl_tables = summary.declaration_tables(decls)
    writers.write_tables(ann_tables | decl_tables, dest)
    for name, df, cols in (
        ("non-imp-use-site-type-annotations", ann_tables["non-imp-use-site-type-annotations"], columns),
        ("non-use-site-type-declarations", decl_tables["non-use-site-type-declarations"], summary.DECLARATION_COLUMNS),
    ):
        flags = [c for c in cols if c != "VarCnt"]
        writers.write_summaries(
            summary.as_display(summary.summarize_columns(df, cols), flags).orderBy("ord").drop("ord"),
            f"{dest}/summary-{name}")
    return summary.corpus_totals(anns, columns), summary.corpus_totals(decls, summary.DECLARATION_COLUMNS)


def census_job(spark: SparkSession, packages: str, dest: str) -> DataFrame:
    """Lower-bound census of <package>/src; returns the ranked report rows."""
    tune(spark)
    files = readers.code_files(spark, packages, src_only=True)
    lowerbounds.file_census(files).write.mode("overwrite").parquet(f"{dest}/census")
    report = lowerbounds.report_rows(readers.package_dirs(spark, packages), spark.read.parquet(f"{dest}/census"))
    writers.write_report(report, f"{dest}/report")
    return report


def log_job(spark: SparkSession, path: str, dest: str) -> DataFrame:
    """Run logs to distinct annotations, which ``analyze_annotations`` takes."""
    found = logs.logged_annotations(readers.log_lines(spark, path))
    found.write.mode("overwrite").parquet(dest)
    return spark.read.parquet(dest)
