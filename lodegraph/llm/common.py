"""Shared helpers: inputs, shared storage, connected components."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegraph.runtime import checkpoint, checkpoint_root

__all__ = ["checkpoint", "components", "fewer", "is_small", "shared_path", "stored", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def fewer(df: DataFrame, size: int) -> DataFrame:
    """df in tasks of at least `size` bytes where it has more than one a core: each task that writes a shuffle opens up to 200 files."""
    n = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.coalesce(min(max(df.sparkSession.sparkContext.defaultParallelism, -(-n // size)), 1 << 30))


def stored(df: DataFrame) -> DataFrame:
    """Cut the lineage as a checkpoint does, by Parquet files: a checkpoint's rows are Java objects, which cost many times as much to read."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return fewer(df.sparkSession.read.schema(df.schema).parquet(path), 1 << 23)


def is_small(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows: the check before a broadcast."""
    return df.limit(rows + 1).count() <= rows


def unused(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: edges up to which the driver finds their components (16 bytes each): rounds over so few cost more in shuffle files than in rows
FEW_EDGES = 200_000


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different nodes of the edges, and the smallest node of each one's component."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while (root[u] != root[v]).any():
        np.minimum.at(root, np.maximum(root[u], root[v]), np.minimum(root[u], root[v]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, max_rounds: int = 60, few: int = FEW_EDGES) -> DataFrame:
    """Distributed union-find: (node, root) for every node of the undirected edges (a, b); on the driver for up to `few` edges of longs.

    Alternates a large-star step (every node hands its larger neighbours its smallest one) and a small-star step
    (smaller neighbours meet at the smallest) until no edge changes; every round is two aggregations over the
    edges, with no group of neighbours collected. Roots are the smallest node of their component. A node with very many
    neighbours is one key of a round's joins, which have exchanges of their own, so that its rows can be split.
    """
    e = edges.select("a", "b").filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpoint(e)
    if dict(e.dtypes) == {"u": "bigint", "v": "bigint"} and is_small(e, few):
        some = e.toArrow()
        node, root = roots(some["u"].to_numpy(), some["v"].to_numpy())
        return e.sparkSession.createDataFrame(pa.table({"node": node, "root": root}))
    before = None

    def beside(rows: DataFrame, low: DataFrame) -> DataFrame:
        return rows.withColumn("k", F.hash("u")).join(low.withColumn("k", F.hash("u")), ["k", "u"]).drop("k")

    for _ in range(max_rounds):
        # large star
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = beside(both, low).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = beside(big, low).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = checkpoint(small.filter("u <> v").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
