"""Text files as numbered lines, however large.

A file is read in blocks by many tasks. A block's rows get rising ids; the
number of a line is the lines of the blocks before its own, plus its place
there. Only the blocks of a file are ever put in order, never its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLACE = ["file", "block", "id"]


def text_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, block, id, value): every line, in the order of block and id within its file."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"), "value")


def numbered(lines: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """``wanted`` (rows of ``lines``; all by default) with ``line``, from 0 in each file."""
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = (lines if wanted is None else wanted).join(blocks, ["file", "block"])
    return found.withColumn("line", F.col("_before") + F.col("id") - F.col("_first")).drop("_first", "_n", "_before")
