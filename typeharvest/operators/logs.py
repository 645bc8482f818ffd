"""Log mining: marker filter, strip, distinct, sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: marker of a useful log line
MARKER = "JLSUBTYPELOG: "


def marked(lines: DataFrame, column: str = "value", marker: str = MARKER, anywhere: bool = False) -> DataFrame:
    """Lines with the marker, without it.

    By default the marker must start the line. ``anywhere`` takes it at any
    place and drops everything up to its last occurrence.
    """
    text: Column = F.col(column)
    if not anywhere:
        return lines.filter(text.startswith(marker)).select(
            F.substring(text, F.lit(len(marker) + 1), F.length(text)).alias(column))
    return lines.filter(text.contains(marker)).select(F.substring_index(text, marker, -1).alias(column))


def distinct_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct lines; copies are dropped map-side before the shuffle."""
    return lines.select(column).distinct()


def sorted_distinct(lines: DataFrame, column: str = "value") -> DataFrame:
    return distinct_lines(lines, column).orderBy(column)


def logged_annotations(lines: DataFrame, column: str = "value", anywhere: bool = True) -> DataFrame:
    """Distinct logged annotations as an annotation table of one column."""
    return distinct_lines(marked(lines, column, anywhere=anywhere), column).withColumnRenamed(
        column, "TypeAnnotation")
