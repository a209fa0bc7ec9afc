"""Counts and status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def graph_stats(**tables: DataFrame) -> DataFrame:
    """One row with the row count of each table."""
    parts = [df.agg(F.count(F.lit(1)).alias(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.crossJoin(b), parts)


def pending_files(files: DataFrame, status: str = "pending") -> DataFrame:
    return files.filter(F.col("summary_status") == status)


def pending_embeddings(rows: DataFrame, need_summary: bool) -> DataFrame:
    """Rows with a finished summary and no finished embedding; for nodes the summary must be there."""
    out = rows.filter((F.col("summary_status") == "done") & (F.col("embedding_status") != "done"))
    return out.filter(F.col("summary").isNotNull()) if need_summary else out
