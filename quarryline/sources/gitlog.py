"""Commit logs as text lines: a ``COMMIT:`` header, then the files it touched."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_log(lines: DataFrame, *, part: str, order: list[str]) -> DataFrame:
    """(part, header, path) from ``lines(part, .., line)``: each file line with the last header before it.

    ``part`` cuts the log where a header begins (a file of a partitioned log, say), so that carrying headers forward needs no global order.
    """
    w = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    header = F.when(F.startswith("line", F.lit("COMMIT:")), F.substring("line", 8, 1 << 30))
    carried = lines.select(part, "line", F.last(header, ignorenulls=True).over(w).alias("header"))
    return carried.where(~F.startswith("line", F.lit("COMMIT:"))).select(part, "header", F.col("line").alias("path"))
