"""Line-structured text in relational form: heading spans and code fences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def section_ends(headings: DataFrame) -> DataFrame:
    """headings (doc, pos, level) -> with end: the next heading of the same or a higher level in the document, or null.

    For each level l, the next heading of level <= l is a windowed minimum; levels are few, so no self-join is needed.
    """
    levels = [1, 2, 3]
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    out = headings
    for x in levels:
        out = out.withColumn(f"_n{x}", F.min(F.when(F.col("level") <= x, F.col("pos"))).over(w))
    end = F.coalesce(*[F.when(F.col("level") == x, F.col(f"_n{x}")) for x in levels])
    return out.select("doc", "pos", "level", end.alias("end"))


def fence_parity(lines: DataFrame) -> DataFrame:
    """lines (doc, line_no, line) -> with inside: whether an odd number of fences is at or before the line."""
    fence = F.col("line").rlike(r"^\s*```").cast("int")
    w = Window.partitionBy("doc").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("inside", F.sum(fence).over(w) % 2 == 1)
