"""Point lookups and ordered lists over a snapshot's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators import lexical


def by(df: DataFrame, column: str, value) -> DataFrame:
    """Rows with that value; the filter reaches the scan."""
    return df.filter(F.col(column) == value)


def files(t: DataFrame) -> DataFrame:
    return t.orderBy("file_id")


def edges(t: DataFrame) -> DataFrame:
    return t.orderBy("source", "target", "kind")


def resources(t: DataFrame, kind: str | None = None) -> DataFrame:
    return (t if kind is None else t.filter(F.col("type") == kind)).orderBy("resource_id")


def nodes_of_file(t: DataFrame, file_id: int) -> DataFrame:
    return by(t, "file_id", file_id).orderBy("start_line", "node_id")


def links_of(t: DataFrame, column: str, value: int) -> DataFrame:
    """Resource edges of a resource or a file, the most confident first."""
    return by(t, column, value).orderBy(F.desc("confidence"), "edge_id")


def nodes_by_text(nodes: DataFrame, query: str, limit: int) -> DataFrame:
    """Nodes whose name or summary holds a token of the query, best first."""
    found = lexical.search(nodes.select(F.col("node_id").alias("id"), "name", "summary"), query, limit)
    return found.join(nodes, found["id"] == nodes["node_id"]).orderBy("rank").drop("id")
