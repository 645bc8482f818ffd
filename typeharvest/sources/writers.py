"""Sinks: partitioned CSV for exchange, Parquet as the canonical copy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeharvest.functions import printed
from typeharvest.sources import folders, readers, schemas

#: most files of one package's table
FILES_OF_PACKAGE = 16
ORDER = ["Package", "File", "Pos", "Ord"]


def _by_package(df: DataFrame) -> DataFrame:
    """A package is a few files, whatever the number of tasks."""
    spread = F.pmod(F.xxhash64("File"), F.lit(FILES_OF_PACKAGE)) if "File" in df.columns else F.lit(0)
    return source_ordered(df.repartition("Package", spread))


def _csv(df: DataFrame, path: str, partition: bool = True) -> None:
    if partition:
        df = _by_package(df)
    writer = df.write.mode("overwrite").option("header", "true").option("quote", '"').option("escape", "\\")
    writer = writer.option("emptyValue", "").option("nullValue", "")
    (writer.partitionBy("Package") if partition else writer).csv(path)


def _printed(df: DataFrame, path: str, columns: list[str]) -> None:
    """Lines of printed fields under a plain header. The lines are whole: the
    CSV writer adds the header and nothing else."""
    line = printed.line([F.col(c) for c in columns]).alias(",".join(columns))
    writer = _by_package(df).select("Package", line).write.mode("overwrite")
    writer.option("header", "true").option("quote", "").option("sep", "\x01").partitionBy("Package").csv(path)


def source_ordered(df: DataFrame) -> DataFrame:
    """Rows of a file stay together and in source order; a large package is
    written by several tasks instead of one."""
    return df.sortWithinPartitions(*[c for c in ORDER if c in df.columns])


def write_annotations(annotations: DataFrame, path: str) -> None:
    """<path>/Package=<name>/*.csv, every field printed, without Pos and Ord."""
    _printed(annotations, path, schemas.TYPE_ANNOTATIONS.names)


def write_declarations(declarations: DataFrame, path: str) -> None:
    _printed(declarations, path, schemas.TYPE_DECLARATIONS.names)


def write_analyzed(analyzed: DataFrame, path: str) -> None:
    """Per-package CSV without the nested summary, which CSV cannot hold."""
    _csv(analyzed.drop("TypeVarsSummary"), path)


def write_summaries(summary: DataFrame, path: str) -> None:
    _csv(summary, path, partition="Package" in summary.columns)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One folder per filtered table; Package stays a column."""
    for name, df in tables.items():
        _csv(df.drop("TypeVarsSummary"), f"{path}/{name}", partition=False)


def write_report(rows: DataFrame, path: str) -> None:
    """Report lines in order, as text parts whose names sort in report order."""
    rows.select("line").write.mode("overwrite").text(path)


def write_folders(rows: DataFrame, path: str, levels: list[str], value: str = "value") -> None:
    """<path>/<level>=<its value>/.../: a folder for each combination of levels, with the rows' values as lines.

    The names need no escape. Tasks make the folders and files themselves: Spark's
    own writer moves each file once more and, on a local store without native code,
    starts a process for each. It still writes where tasks cannot open the store.
    """
    spark = rows.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(root)
    below = readers.qualified(spark, path)
    if not folders.reachable(spark, below):
        rows.select(*levels, value).repartition(levels[0]).write.mode("append").partitionBy(*levels).text(path)
        return
    names = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in levels]
    lines = rows.groupBy(F.concat_ws("/", *names, F.lit("part.txt")).alias("rel"), value).agg(F.count("*").alias("n"))
    text = F.array_join(F.sort_array(F.collect_list(F.struct(value, F.repeat(F.concat(F.col(value), F.lit("\n")), F.col("n").cast("int")).alias("t"))))["t"], "")
    folders.write_texts(lines.groupBy("rel").agg(text.alias("text")), below).write.format("noop").mode("overwrite").save()
