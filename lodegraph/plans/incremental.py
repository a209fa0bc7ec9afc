"""Snapshot diffs and the mutations that follow from them. Every function maps DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.runtime import checkpoint


def diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two snapshots (file_path, hash) -> (change, path): added, modified, deleted."""
    o, n = old.select("file_path", F.col("hash").alias("oh")), new.select("file_path", F.col("hash").alias("nh"))
    both = o.join(n, "file_path", "full_outer")
    change = F.when(F.col("oh").isNull(), "added").when(F.col("nh").isNull(), "deleted").when(F.col("oh") != F.col("nh"), "modified")
    return both.select(change.alias("change"), F.col("file_path").alias("path"), "oh", "nh").filter("change IS NOT NULL")


def with_renames(changes: DataFrame) -> DataFrame:
    """(change, path, from_path): a deleted and an added path with one hash that is unique on both sides are one rename."""
    one = lambda kind, col, path: changes.filter(F.col("change") == kind).groupBy(F.col(col).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("path").alias(path)).filter("n = 1").drop("n")
    pairs = one("deleted", "oh", "from_path").join(one("added", "nh", "to_path"), "h").select("from_path", "to_path")
    rest = changes.join(pairs.select(F.col("from_path").alias("path"), F.lit("deleted").alias("change")), ["path", "change"], "left_anti")
    rest = rest.join(pairs.select(F.col("to_path").alias("path"), F.lit("added").alias("change")), ["path", "change"], "left_anti")
    renamed = pairs.select(F.lit("renamed").alias("change"), F.col("to_path").alias("path"), "from_path")
    return rest.select("change", "path", F.lit(None).cast("string").alias("from_path")).unionByName(renamed)


def change_plan(changes: DataFrame) -> DataFrame:
    """(action, path): rebuild (added or modified), delete, rename."""
    action = F.when(F.col("change").isin("added", "modified"), "rebuild").when(F.col("change") == "deleted", "delete").otherwise("rename")
    return changes.select(action.alias("action"), "path").distinct()


def cascade_delete(paths: DataFrame, files: DataFrame, nodes: DataFrame, edges: DataFrame, **by_file_or_node: DataFrame) -> dict[str, DataFrame]:
    """Take files out, with their nodes, the edges at either end, and rows of further tables by their file_id or node_id."""
    gone = files.join(paths.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("file_id")
    gone_nodes = nodes.join(gone, "file_id", "left_semi").select("node_id")
    out = {
        "files": files.join(gone, "file_id", "left_anti"),
        "nodes": nodes.join(gone, "file_id", "left_anti"),
        "edges": edges.join(gone_nodes.select(F.col("node_id").alias("source")), "source", "left_anti").join(gone_nodes.select(F.col("node_id").alias("target")), "target", "left_anti"),
    }
    for name, df in by_file_or_node.items():
        key, ids = ("file_id", gone) if "file_id" in df.columns else ("node_id", gone_nodes)
        out[name] = df.join(ids, key, "left_anti")
    return out


def rename(files: DataFrame, renames: DataFrame) -> DataFrame:
    """files with the paths of renames (from_path, path); ids and all else stay."""
    r = renames.select(F.col("from_path").alias("file_path"), F.col("path").alias("_to"))
    return files.join(r, "file_path", "left").withColumn("file_path", F.coalesce("_to", "file_path")).drop("_to").select(*files.columns)


def upsert_files(files: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming (file_path, language, hash). Known paths keep their id, status and summary; new ones are pending, with ids above all others in path order."""
    new = incoming.select("file_path", F.col("language").alias("_l"), F.col("hash").alias("_h"))
    both = files.join(new, "file_path", "full_outer")
    known = both.filter("file_id IS NOT NULL")
    known = known.withColumn("language", F.coalesce("_l", "language")).withColumn("hash", F.coalesce("_h", "hash")).select(*files.columns)
    added = both.filter("file_id IS NULL").select("file_path", F.col("_l").alias("language"), F.col("_h").alias("hash"))
    top = files.agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("top"))
    added = assign_ids(added, "file_id", "file_path").crossJoin(F.broadcast(top)).withColumn("file_id", F.col("file_id") + F.col("top")).drop("top")
    fill = {"summary_status": F.lit("pending"), "embedding_status": F.lit("pending")}
    cols = [F.col(c) if c in added.columns else fill.get(c, F.lit(None)).cast(files.schema[c].dataType).alias(c) for c in files.columns]
    return known.unionByName(added.select(*cols))


def assign_ids(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Dense ids from 1 in the order of the columns: a range exchange, a count a partition, then a number within it."""
    from pyspark.sql import Window

    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id())
    # counts and rows must see the same partitions; run twice, the exchange has other bounds (they are sampled) and sizes
    parts = checkpoint(parts)
    counts = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_m"))  # one row a partition
    base = counts.select("_p", "_m", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return parts.join(base, "_p").withColumn(name, F.col("_b") + F.col("_i") - F.col("_m") + 1).drop("_p", "_i", "_m", "_b")


def upsert_links(links: DataFrame, incoming: DataFrame) -> DataFrame:
    """Resource edges by (resource_id, file_id, kind); incoming ones win."""
    key = ["resource_id", "file_id", "kind"]
    return links.join(incoming.select(*key).distinct(), key, "left_anti").unionByName(incoming.dropDuplicates(key), allowMissingColumns=True)


def insert_edges(edges: DataFrame, incoming: DataFrame) -> DataFrame:
    """The incoming edges (source, target, kind) that are new, each once."""
    key = ["source", "target", "kind"]
    return incoming.select(*key).distinct().join(edges.select(*key), key, "left_anti")


def unchanged(old_nodes: DataFrame, new_nodes: DataFrame) -> DataFrame:
    """Nodes (file_path, name, source_code[, summary, summary_status]) -> the new nodes with `same`: source equal to that of the old one with the name."""
    o = old_nodes.groupBy("file_path", "name").agg(F.first("source_code").alias("_old"))
    return new_nodes.join(o, ["file_path", "name"], "left").withColumn("same", F.coalesce(F.col("_old") == F.col("source_code"), F.lit(False))).drop("_old")


def unchanged_ratio(old_nodes: DataFrame, new_nodes: DataFrame, keep: float = 0.5) -> DataFrame:
    """(file_path, ratio, keeps): share of a file's new nodes that are unchanged, and whether their summaries are kept."""
    out = unchanged(old_nodes, new_nodes).groupBy("file_path").agg(F.avg(F.col("same").cast("double")).alias("ratio"))
    return out.withColumn("keeps", F.col("ratio") >= keep)


def restore_summaries(old_nodes: DataFrame, new_nodes: DataFrame, keep: float = 0.5) -> DataFrame:
    """New nodes with summary and statuses: unchanged nodes of files over the ratio keep a finished summary, all others are pending."""
    ratio = unchanged_ratio(old_nodes, new_nodes, keep).select("file_path", "keeps")
    done = old_nodes.filter("summary_status = 'done'").groupBy("file_path", "name").agg(F.first("summary").alias("_s"))
    out = unchanged(old_nodes, new_nodes.drop("summary", "summary_status", "embedding_status")).join(ratio, "file_path", "left").join(done, ["file_path", "name"], "left")
    held = F.col("same") & F.col("keeps") & F.col("_s").isNotNull()
    return out.withColumn("summary", F.when(held, F.col("_s"))).withColumn("summary_status", F.when(held, "done").otherwise("pending")).withColumn("embedding_status", F.lit("pending")).drop("same", "keeps", "_s")


def slice_edges(edges: DataFrame, nodes: DataFrame, broadcast_keys: int = 1_000_000) -> DataFrame:
    """The different edges with an end in nodes (key). Up to broadcast_keys keys go to every task, so that only edges found are exchanged; beyond, two semi joins."""
    n = nodes.select("key").distinct()
    if n.limit(broadcast_keys + 1).count() <= broadcast_keys:
        ends = lambda c, flag: F.broadcast(n.select(F.col("key").alias(c), F.lit(True).alias(flag)))
        found = edges.join(ends("source_key", "_s"), "source_key", "left").join(ends("target_key", "_t"), "target_key", "left").filter("_s OR _t")
        return found.select(*edges.columns).distinct()
    a = edges.join(n.withColumnRenamed("key", "source_key"), "source_key", "left_semi")
    b = edges.join(n.withColumnRenamed("key", "target_key"), "target_key", "left_semi")
    return a.select(*edges.columns).unionByName(b.select(*edges.columns)).distinct()


def set_status(rows: DataFrame, updates: DataFrame, key: str, *columns: str) -> DataFrame:
    """rows with the columns of updates (key, columns...) where they are not null."""
    u = updates.select(F.col(key), *[F.col(c).alias(f"_{c}") for c in columns])
    out = rows.join(u, key, "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out.select(*rows.columns)
