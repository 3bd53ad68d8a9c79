"""Joins of points with ranges of any width, as equi-joins on bins.

A range's bins are as wide as the largest power of two that is no longer than the range, so that it touches three of them at most, whatever its width.  A point is in one
bin for each width that occurs: some 40 at most.  No inequality is left to a nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def _width(start: Column, end: Column) -> Column:
    """The exponent of a range's bins."""
    return F.floor(F.log2((end - start + 1).cast("double")) + 1e-12).cast("int")


def _bin(at: Column, width: Column) -> Column:
    return F.call_function("shiftright", at.cast("long"), width)  # rounds down, below 0 as well


def binned(ranges: DataFrame) -> DataFrame:
    """ranges(..., start, end) with a row for each (width, bin) that they touch; a range that ends before it starts has none."""
    w = ranges.where(c("start") <= c("end")).withColumn("width", _width(c("start"), c("end")))
    return w.withColumn("bin", F.explode(F.sequence(_bin(c("start"), c("width")), _bin(c("end"), c("width")))))


def probes(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """points(key, at, ...) with a row for each width of a range of their key."""
    widths = ranges.where(c("start") <= c("end")).select("key", _width(c("start"), c("end")).alias("width")).distinct()
    return points.join(widths, "key").withColumn("bin", _bin(c("at"), c("width")))


def touched(ranges: DataFrame, points: DataFrame) -> DataFrame:
    """The ``ranges(key, start, end, id)`` that hold a point of ``points(key, at)`` of their key, both ends included; every row once.

    A bin's least and greatest point say all: a range covers the bins within it, the end of its first and the beginning of its last one.  So however many points
    there are, a range meets three rows.
    """
    ends = probes(points.select("key", "at"), ranges).groupBy("key", "width", "bin").agg(F.min("at").alias("least"), F.max("at").alias("most"))
    met = binned(ranges).join(ends, ["key", "width", "bin"])
    first, last = c("bin") == _bin(c("start"), c("width")), c("bin") == _bin(c("end"), c("width"))
    inside = F.when(first & last, True).when(first, c("most") >= c("start")).when(last, c("least") <= c("end")).otherwise(True)
    return met.where(inside).select("key", "start", "end", "id").distinct()


def enclosing(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(key, at, start, end, id): for each distinct point(key, at) the first of ``ranges(key, start, end, id)`` that holds it, by start, then end, then id.

    Of the ranges that cover a bin whole, and of those that begin in it, the first alone can matter; only ranges that end within a bin are met one by one.
    """
    first = F.struct("start", "end", "id")
    b = binned(ranges).withColumn("ends_here", (c("bin") == _bin(c("end"), c("width"))) & (c("bin") != _bin(c("start"), c("width"))))
    begins = c("bin") == _bin(c("start"), c("width"))
    aligned = begins & (c("bin") == _bin(c("end"), c("width")))
    open_ = b.where(~c("ends_here")).groupBy("key", "width", "bin").agg(
        F.min(F.when(~begins | aligned, first)).alias("whole"), F.min(F.when(begins & ~aligned, first)).alias("begun")
    )
    p = probes(points.select("key", "at").distinct(), ranges)
    over = p.join(open_, ["key", "width", "bin"]).select("key", "at", F.least("whole", F.when(c("begun.start") <= c("at"), c("begun"))).alias("first"))
    closing = b.where("ends_here").select("key", "width", "bin", first.alias("first")).distinct()
    ended = p.join(closing, ["key", "width", "bin"]).where(c("at") <= c("first.end")).select("key", "at", "first")
    best = over.where("first is not null").unionByName(ended).groupBy("key", "at").agg(F.min("first").alias("first"))
    return best.select("key", "at", "first.*")
