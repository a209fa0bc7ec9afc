"""Evaluation sets: a JSON list of cases, or an object with `queries`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ITEM = "array<struct<query:string,expected_nodes:array<string>,expected_files:array<string>>>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query, expected, expected_files); ValueError for a case without a query. Entries that aren't strings are dropped."""
    raw = spark.read.text(path, wholetext=True)
    loose = "array<struct<query:string,expected_nodes:array<variant>,expected_files:array<variant>>>"
    listed = F.coalesce(F.from_json("value", f"struct<queries:{loose}>")["queries"], F.from_json("value", loose))
    rows = raw.select(F.posexplode(listed).alias("query_id", "c"))
    text = lambda c: F.transform(F.filter(F.coalesce(c, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.try_variant_get(v, "$", "string"))
    out = rows.select(F.col("query_id").cast("long").alias("query_id"), F.col("c.query").alias("query"), text(F.col("c.expected_nodes")).alias("expected"), text(F.col("c.expected_files")).alias("expected_files"))
    if not out.filter("query IS NULL OR trim(query) = ''").isEmpty():
        raise ValueError("every case needs a query")
    return out
