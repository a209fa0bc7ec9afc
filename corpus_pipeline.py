"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, packing. Counted as part of lodegraph.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.llm import decontaminate, language_id, line_dedup, near_join, packing
from lodegraph.llm.common import shared_path, table
from lodegraph.runtime import ship

#: A document goes if its language is unknown or no language reaches this mean probability.
MIN_SCORE = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the network knows."""
    ship(spark)
    out = language_id.with_language(docs, language_id.train(docs))
    return out.filter((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= MIN_SCORE)).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one line of each class of near copies; documents stay."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near copies, found by SimHash and MinHash: a Jaccard similarity of five-word shingles of 0.8 or more."""
    ship(spark)
    return near_join.keep_one(docs, size=5, threshold=0.8).select(*docs.columns)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of any benchmark item."""
    out = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), min_items=1)
    return out.filter(~F.col("contaminated")).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences."""
    ship(spark)
    return packing.packed(packing.token_counts(docs))


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("packing", packing_stage),
]

#: SQL can't express the network or the packing; tests/llm compares stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
