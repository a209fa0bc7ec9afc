"""Resource files as rows of chunks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.functions.chunk import requirement_chunks, schema_chunks

SCHEMA = "type string, source_path string, name string, content string, summary string, hash string"


def chunks(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Chunks of the files at path; kind is `prd` (requirements) or `db` (table definitions). Unknown formats raise."""
    return chunk_rows(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content"), kind)


def chunk_rows(files: DataFrame, kind: str) -> DataFrame:
    """files (path, content binary)."""
    read = {"prd": requirement_chunks, "db": schema_chunks}[kind]

    def run(batches):
        for pdf in batches:
            rows = [(kind, p, c.name, c.content, c.summary) for p, data in zip(pdf["path"], pdf["content"]) for c in read(p, bytes(data))]
            yield pd.DataFrame(rows, columns=["type", "source_path", "name", "content", "summary"]).assign(hash="")

    return files.select("path", "content").mapInPandas(run, SCHEMA).withColumn("hash", F.sha2("content", 256))
