"""Links between resources and files, graded by similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import clamp01
from lodegraph.operators.knn import similarity_topk

STRONG, WEAK = 0.85, 0.70


def grade(similarity: Column, strong: float = STRONG, weak: float = WEAK) -> tuple[Column, Column]:
    """(link_type, confidence); null below the weak threshold. Both thresholds are inclusive."""
    kind = F.when(similarity >= strong, "strong").when(similarity >= weak, "weak")
    confidence = F.when(similarity >= strong, clamp01(similarity)).when(similarity >= weak, clamp01(similarity * 0.8))
    return kind, confidence


def link(resources: DataFrame, file_vectors: DataFrame, top_k: int, kind: str = "describes", strong: float = STRONG, weak: float = WEAK) -> DataFrame:
    """resources (qid, embedding), file_vectors (id, embedding) -> resource_id, file_id, kind, similarity, confidence, link_type."""
    top = similarity_topk(resources, file_vectors, top_k)
    t, c = grade(F.col("similarity"), strong, weak)
    out = top.select(F.col("qid").alias("resource_id"), F.col("id").alias("file_id"), F.lit(kind).alias("kind"), "similarity", c.alias("confidence"), t.alias("link_type"))
    return out.filter(F.col("link_type").isNotNull())


def link_within(resources: DataFrame, file_vectors: DataFrame, file_ids: DataFrame, top_k: int, **options) -> DataFrame:
    """The same over some files only."""
    return link(resources, file_vectors.join(file_ids.select("id").distinct(), "id", "left_semi"), top_k, **options)


def link_counts(links: DataFrame) -> DataFrame:
    return links.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum((F.col("link_type") == k).cast("long")), F.lit(0)).alias(k) for k in ("strong", "weak")])
