"""Retrieval quality: recall, reciprocal rank, means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import norm_name


def case_metrics(cases: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """cases (query_id, expected array<string>, elapsed_ms), hits (query_id, rank from 0, name).

    Recall counts different expected names within the first k hits; the first hit's rank is from 1, over all hits. A case
    that expects nothing has null metrics and empty true.
    """
    want = cases.select("query_id", F.explode(F.array_distinct(F.transform("expected", lambda x: norm_name(x)))).alias("name"))
    size = want.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    met = want.join(hits.select("query_id", "rank", norm_name(F.col("name")).alias("name")), ["query_id", "name"])
    met = met.groupBy("query_id").agg(F.countDistinct(F.when(F.col("rank") < k, F.col("name"))).alias("found"), (F.min("rank") + 1).cast("int").alias("first_hit_rank"))
    out = cases.join(size, "query_id", "left").join(met, "query_id", "left")
    valid = F.col("n").isNotNull()
    return out.select(
        "query_id",
        F.when(valid, F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"),
        F.when(valid, F.coalesce(F.lit(1.0) / F.col("first_hit_rank"), F.lit(0.0))).alias("reciprocal_rank"),
        "first_hit_rank",
        "elapsed_ms",
        (~valid).alias("empty"),
    )


def report(metrics: DataFrame) -> DataFrame:
    """Means over the cases that expect something; mean time over all."""
    zero = F.lit(0.0)
    return metrics.agg(
        F.count(F.lit(1)).alias("total"),
        F.count("recall").alias("valid"),
        F.coalesce(F.avg("recall"), zero).alias("mean_recall"),
        F.coalesce(F.avg("reciprocal_rank"), zero).alias("mrr"),
        F.coalesce(F.avg("elapsed_ms"), zero).alias("avg_query_ms"),
    )


def render_report(report_row, rows) -> str:
    """Text table of a report and its cases (both collected)."""
    shown = lambda v: "n/a" if v is None else f"{v:.4f}"
    lines = [f"cases: {report_row['total']} ({report_row['valid']} valid)", f"recall: {shown(report_row['mean_recall'])}", f"MRR: {shown(report_row['mrr'])}", f"average time: {report_row['avg_query_ms']:.1f} ms"]
    for r in rows:
        rank = "n/a" if r["empty"] else r["first_hit_rank"] or "miss"
        lines.append(f"{r['query_id']}\trecall {shown(r['recall'])}\trank {rank}\t{r['elapsed_ms']:.1f} ms")
    return "\n".join(lines)
