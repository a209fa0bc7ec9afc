"""Hybrid retrieval: coarse-to-fine vector search, lexical search, fusion, expansion, and the answer's assembly."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegraph.functions.text import contains_folded, tokenize
from lodegraph.operators.fusion import RRF_K, rrf
from lodegraph.operators.graph import expand
from lodegraph.operators.knn import knn, knn_within
from lodegraph.operators.lexical import ranked, search


@dataclass(frozen=True)
class Options:
    file_top_k: int = 10
    node_top_k: int = 10
    resource_top_k: int = 3
    fallback: float = 0.75
    hops: int = 2
    rrf_k: int = RRF_K
    dense_weight: float = 1.0
    lexical_weight: float = 1.0
    limit: int = 10


def dense_channel(file_vectors: DataFrame, node_vectors: DataFrame, query: list[float], o: Options) -> tuple[DataFrame, DataFrame]:
    """(hits, info): node hits (id, distance, similarity, rank) of the nearest files, or of all nodes where those are weak; info is one row (max_similarity, fallback).

    node_vectors has (id, file_id, embedding). The fallback's hits equal the nearest of all nodes, since no hit within
    files beats those; both lists have node_top_k rows at most, and the plan takes one by a one-row condition.
    """
    files = knn(file_vectors, query, o.file_top_k).select(F.col("id").alias("file_id"))
    ids = node_vectors.join(files, "file_id", "left_semi").select("id")
    vectors = node_vectors.select("id", "embedding")
    within, everywhere = knn_within(vectors, ids, query, o.node_top_k), knn(vectors, query, o.node_top_k)
    info = within.agg(F.max("similarity").alias("max_similarity")).withColumn("fallback", F.coalesce(F.col("max_similarity") < o.fallback, F.lit(True)))
    both = within.withColumn("wide", F.lit(False)).union(everywhere.withColumn("wide", F.lit(True)))
    hits = both.crossJoin(F.broadcast(info)).filter(F.col("wide") == F.col("fallback")).select("id", "distance", "similarity")
    return ranked(hits, o.node_top_k, "distance", "id"), info


def search_hybrid(file_vectors: DataFrame, node_vectors: DataFrame, docs: DataFrame, query: list[float] | None, text: str, o: Options = Options()) -> DataFrame:
    """id, rrf_score, channel, similarity, fallback. Without a query vector: the lexical channel alone, fallback true."""
    lexical = search(docs, text, o.node_top_k).select("id", "rank")
    if query is None:
        none = docs.sparkSession.createDataFrame([], "id long, rank int")
        out = rrf(none, lexical, o.rrf_k, o.dense_weight, o.lexical_weight, o.limit)
        return out.withColumn("similarity", F.lit(None).cast("double")).withColumn("fallback", F.lit(True))
    dense, info = dense_channel(file_vectors, node_vectors, query, o)
    out = rrf(dense.select("id", "rank"), lexical, o.rrf_k, o.dense_weight, o.lexical_weight, o.limit)
    out = out.join(dense.select("id", "similarity"), "id", "left").crossJoin(F.broadcast(info.select("fallback")))
    return out.orderBy(F.desc("rrf_score"), "id")


def search_resources(resources: DataFrame, vectors: DataFrame | None, query: list[float] | None, text: str, top_k: int) -> DataFrame:
    """resources (id, name, summary) -> id, similarity, channel: nearest vectors first, then substring hits; each id once."""
    parts = []
    if vectors is not None and query is not None:
        parts.append(knn(vectors, query, top_k).select("id", "similarity", F.lit("dense").alias("channel"), F.lit(0).alias("tier"), F.col("distance").alias("o")))
    words = list(dict.fromkeys(tokenize(text)))
    if words:
        hit = F.lit(False)
        for t in words:
            hit = hit | contains_folded(F.col("name"), t) | contains_folded(F.col("summary"), t)
        parts.append(resources.filter(hit).select("id").orderBy("id").limit(max(top_k, 0)).select("id", F.lit(None).cast("double").alias("similarity"), F.lit("like").alias("channel"), F.lit(1).alias("tier"), F.col("id").cast("double").alias("o")))
    if not parts or top_k <= 0:
        return resources.sparkSession.createDataFrame([], "id long, similarity double, channel string")
    rows = parts[0] if len(parts) == 1 else parts[0].union(parts[1])
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("tier"))).filter("r = 1")
    return rows.orderBy("tier", "o", "id").limit(top_k).select("id", "similarity", "channel")


def enrich(hits: DataFrame, nodes: DataFrame, files: DataFrame) -> DataFrame:
    """hits (id, ...) with name, kind and file_path; a missing node is named #id, of kind unknown."""
    n = nodes.select(F.col("node_id").alias("id"), "name", "kind", "file_id")
    out = hits.join(n, "id", "left").join(files.select("file_id", "file_path"), "file_id", "left")
    return out.withColumn("name", F.coalesce("name", F.concat(F.lit("#"), F.col("id").cast("string")))).withColumn("kind", F.coalesce("kind", F.lit("unknown")))


def attach_resources(file_ids: DataFrame, resource_edges: DataFrame) -> DataFrame:
    """file_ids (file_id, file_pos) -> the best link of each (resource_id, kind): most confident, then first file, then edge."""
    e = resource_edges.join(file_ids, "file_id")
    w = Window.partitionBy("resource_id", "kind").orderBy(F.desc("confidence"), "file_pos", "edge_id")
    out = e.withColumn("r", F.row_number().over(w)).filter("r = 1")
    return out.select("resource_id", "kind", "confidence", "link_type", "file_id").orderBy(F.desc("confidence"), "resource_id", "kind")


def direct_resources(found: DataFrame, attached: DataFrame) -> DataFrame:
    """Resources found on their own that no file brought in: kind and link `direct`, confidence their similarity or 0.5."""
    rest = found.join(attached.select(F.col("resource_id").alias("id")).distinct(), "id", "left_anti")
    return rest.select(F.col("id").alias("resource_id"), F.lit("direct").alias("kind"), F.coalesce("similarity", F.lit(0.5)).alias("confidence"), F.lit("direct").alias("link_type"), F.lit(None).cast("long").alias("file_id"))


def explore(nodes, files, edges, hits: DataFrame, hops: int = 2) -> DataFrame:
    """hits (id, rrf_score, channel) and their neighbours within hops: role, id, name, kind, file_path, depth, rrf_score, channel."""
    around = expand(nodes, edges, hits.select(F.col("id").alias("node_id")), "both", hops).filter("NOT is_seed")
    around = around.select(F.col("node_id").alias("id"), "depth", F.lit(None).cast("double").alias("rrf_score"), F.lit(None).cast("string").alias("channel"), F.lit("neighbour").alias("role"))
    top = hits.select("id", F.lit(0).alias("depth"), "rrf_score", "channel", F.lit("hit").alias("role"))
    return enrich(top.union(around), nodes, files).select("role", "id", "name", "kind", "file_path", "depth", "rrf_score", "channel")
