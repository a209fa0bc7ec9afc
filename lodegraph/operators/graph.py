"""Bounded traversal and the lookups around a node. nodes (node_id, file_id, name, kind, ...), edges (source, target, kind)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_HOPS = 5
DIRECTIONS = ("callees", "callers", "both")


def steps(edges: DataFrame, direction: str, kinds: list[str] | None = None) -> DataFrame:
    """(src, dst): edges in the direction of travel; for both, a path may turn at each hop. An edge may come twice."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction must be one of {DIRECTIONS}")
    e = edges.filter(F.col("kind").isin(kinds)) if kinds else edges
    out = e.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    back = out.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return {"callees": out, "callers": back, "both": out.union(back)}[direction]


def reach(edges: DataFrame, seeds: DataFrame, direction: str = "callees", max_hops: int = 2, kinds: list[str] | None = None) -> DataFrame:
    """seeds (node_id) -> (seed, node_id, depth), the least depth within max_hops; all seeds in one plan, a join a hop."""
    if not 0 <= max_hops <= MAX_HOPS:
        raise ValueError(f"hops must be from 0 to {MAX_HOPS}")
    step = steps(edges, direction, kinds)
    level = seeds.select(F.col("node_id").alias("seed"), "node_id").distinct()
    out = level.withColumn("depth", F.lit(0))
    for depth in range(1, max_hops + 1):
        # repeated edges and turns back end in the distinct of a level, which is small beside the edges
        level = level.join(step, level["node_id"] == step["src"]).select("seed", F.col("dst").alias("node_id")).distinct()
        if depth < max_hops:
            level = level.join(out.select("seed", "node_id"), ["seed", "node_id"], "left_anti")
        out = out.union(level.withColumn("depth", F.lit(depth)))
    return out.groupBy("seed", "node_id").agg(F.min("depth").alias("depth"))


def traverse(nodes: DataFrame, edges: DataFrame, start: int, direction: str = "callees", max_hops: int = 2, kinds: list[str] | None = None, include_start: bool = False) -> DataFrame:
    """(node_id, depth), without ids that no node has; an unknown start gives none."""
    seeds = nodes.sparkSession.createDataFrame([(start,)], "node_id long")
    found = reach(edges, seeds, direction, max_hops, kinds)
    found = found if include_start else found.filter(F.col("node_id") != start)
    return found.join(nodes.select("node_id"), "node_id", "left_semi").select("node_id", "depth").orderBy("depth", "node_id")


def expand(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, direction: str = "both", max_hops: int = 2) -> DataFrame:
    """(node_id, depth, is_seed, seeds): least depth over all seeds, and the sorted seeds that reach the node."""
    found = reach(edges, seeds, direction, max_hops).join(nodes.select("node_id"), "node_id", "left_semi")
    out = found.groupBy("node_id").agg(F.min("depth").alias("depth"), F.max(F.col("seed") == F.col("node_id")).alias("is_seed"), F.sort_array(F.collect_set("seed")).alias("seeds"))
    return out.orderBy("depth", "node_id")


def briefs(nodes: DataFrame, files: DataFrame) -> DataFrame:
    return nodes.join(files.select("file_id", "file_path"), "file_id", "left").select("node_id", "name", "kind", "file_path")


def by_name(nodes: DataFrame, files: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """Nodes of that name, in files of that path or path ending."""
    found = briefs(nodes.filter(F.col("name") == name), files)
    return found if file is None else found.filter((F.col("file_path") == file) | F.col("file_path").endswith(file))


def neighbours(nodes: DataFrame, files: DataFrame, edges: DataFrame, node: DataFrame, callers: bool) -> DataFrame:
    """Briefs of the callers or callees of the nodes in node (node_id), over `calls` edges."""
    here, there = ("target", "source") if callers else ("source", "target")
    ids = edges.filter("kind = 'calls'").join(node.select(F.col("node_id").alias(here)), here, "left_semi").select(F.col(there).alias("node_id")).distinct()
    return briefs(nodes.join(ids, "node_id", "left_semi"), files)


def node_detail(nodes: DataFrame, files: DataFrame, edges: DataFrame, name: str, file: str | None = None) -> DataFrame:
    """One row: the first match, its callers and callees, how many match and whether that is ambiguous."""
    found = by_name(nodes, files, name, file)
    first = found.orderBy("node_id").limit(1)
    listed = lambda df: F.sort_array(F.collect_list("node_id"))
    one = lambda df, alias: df.agg(listed(df).alias(alias))
    out = first.crossJoin(one(found, "candidates")).crossJoin(one(neighbours(nodes, files, edges, first, True), "callers")).crossJoin(one(neighbours(nodes, files, edges, first, False), "callees"))
    return out.withColumn("ambiguous", F.size("candidates") > 1)


def file_info(nodes: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """The nodes of the file with exactly that path, by start line."""
    return files.filter(F.col("file_path") == path).select("file_id", "file_path").join(nodes, "file_id").select("file_path", "node_id", "name", "kind", "start_line", "is_exported").orderBy("start_line", "node_id")


def related(nodes: DataFrame, edges: DataFrame, name: str, direction: str = "both") -> DataFrame:
    """Two hops around every node of that name, without those nodes: node_id, depth, seeds."""
    seeds = nodes.filter(F.col("name") == name).select("node_id")
    return expand(nodes, edges, seeds, direction, 2).filter(~F.col("is_seed")).drop("is_seed")


def incident(edges: DataFrame, node: Column, outgoing: bool, kind: str | None = None) -> DataFrame:
    out = edges.filter(F.col("source" if outgoing else "target") == node)
    return out if kind is None else out.filter(F.col("kind") == kind)
