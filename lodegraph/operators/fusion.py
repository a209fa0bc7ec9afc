"""Reciprocal rank fusion of a dense and a lexical channel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RRF_K = 60


def ranks(ids: DataFrame) -> DataFrame:
    """(id, rank) with the best rank of each id."""
    return ids.groupBy("id").agg(F.min("rank").alias("rank"))


def rrf(dense: DataFrame, lexical: DataFrame, k: int = RRF_K, dense_weight: float = 1.0, lexical_weight: float = 1.0, limit: int | None = None) -> DataFrame:
    """Two channels (id, rank), ranks from 0 -> id, rrf_score, channel, by falling score, then id."""
    d, x = ranks(dense).withColumnRenamed("rank", "dr"), ranks(lexical).withColumnRenamed("rank", "lr")
    both = d.join(x, "id", "full_outer")
    part = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(k) + F.col(r)), F.lit(0.0))
    channel = F.when(F.col("lr").isNull(), "dense").when(F.col("dr").isNull(), "fts5").otherwise("dense+fts5")
    out = both.select("id", (part(dense_weight, "dr") + part(lexical_weight, "lr")).alias("rrf_score"), channel.alias("channel"))
    out = out.orderBy(F.desc("rrf_score"), "id")
    return out if limit is None else out.limit(max(limit, 0))
