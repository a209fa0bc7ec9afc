"""Incremental updates driven by a stream of snapshots. An extension: the batch operators do the work."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.plans import build
from lodegraph.plans.store import Store


def watch(spark: SparkSession, source: str, store: Store, checkpoint: str):
    """Start a query that applies files (file_path, language, source_code) arriving as Parquet below source.

    Each micro-batch is joined to the store's snapshot by path and applied as an incremental build; a batch that runs
    again after a failure gives the same tables, since a build depends on nothing but the files.
    """
    stream = spark.readStream.schema("file_path string, language string, source_code string").parquet(source)

    def apply(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates(["file_path"]).withColumn("hash", F.sha2("source_code", 256))
        if not store.exists():
            store.write(**build.full(new))
            return
        old = store.tables()
        modules = old["nodes"].filter("kind = 'module'").select("file_id", "source_code")
        kept = old["files"].join(modules, "file_id").select("file_path", "language", "source_code", "hash").join(new.select("file_path"), "file_path", "left_anti")
        store.write(**build.incremental(old, kept.unionByName(new.select(*kept.columns)))[1])

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """events (ts, event_type, value), batch or stream -> counts and sums a window and type."""
    rows = events.withWatermark("ts", lateness) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
