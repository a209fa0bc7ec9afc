"""Resources: reading, embedding and linking them to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.operators.link import link, link_within
from lodegraph.plans.embed import Embed, embed_rows
from lodegraph.plans.incremental import assign_ids, upsert_links

KINDS = {"prd": "describes", "db": "reads"}


def replace_source(resources: DataFrame, vectors: DataFrame, edges: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(resources, vectors, edges, added) with the rows of the chunks' sources replaced; vectors and edges of what went go, too."""
    sources = chunks.select("source_path").distinct()
    gone = resources.join(sources, "source_path", "left_semi").select("resource_id")
    top = resources.agg(F.coalesce(F.max("resource_id"), F.lit(0)).alias("top"))
    added = assign_ids(chunks.withColumn("_h", F.xxhash64("name", "content")), "resource_id", "source_path", "_h").drop("_h").crossJoin(F.broadcast(top)).withColumn("resource_id", F.col("resource_id") + F.col("top")).drop("top")
    kept = resources.join(gone, "resource_id", "left_anti")
    return kept.unionByName(added.select(*resources.columns)), vectors.join(gone.withColumnRenamed("resource_id", "id"), "id", "left_anti"), edges.join(gone, "resource_id", "left_anti"), added


def mount(tables: dict[str, DataFrame], chunks: DataFrame, embed: Embed | None, top_k: int = 10, strong: float = 0.85, weak: float = 0.70) -> dict[str, DataFrame]:
    """tables with the chunks as resources; with an embedder also their vectors and links. chunks are of one type."""
    resources, vectors, edges, added = replace_source(tables["resources"], tables["resource_vectors"], tables["resource_edges"], chunks)
    out = tables | {"resources": resources, "resource_vectors": vectors, "resource_edges": edges}
    if embed is None:
        return out
    new = embed_rows(added.select(F.col("resource_id").alias("id"), F.col("summary").alias("text")), embed, "embedding").filter("status = 'done'").select("id", "embedding")
    typed = added.select(F.col("resource_id").alias("qid"), "type")
    links = None
    for kind, edge in KINDS.items():
        some = new.withColumnRenamed("id", "qid").join(typed.filter(F.col("type") == kind).select("qid"), "qid", "left_semi")
        found = link(some, tables["file_vectors"], top_k, edge, strong, weak)
        links = found if links is None else links.unionByName(found)
    return out | {"resource_vectors": vectors.unionByName(new), "resource_edges": upsert_links(edges, links)}


def relink_all(tables: dict[str, DataFrame], files: DataFrame, **options) -> DataFrame:
    """relink for every type of resource, by its kind of link."""
    for kind, edge in KINDS.items():
        of = tables["resources"].filter(F.col("type") == kind).select(F.col("resource_id").alias("id"))
        mine = tables["resource_edges"].filter(F.col("kind") == edge)
        found = relink(tables | {"resource_edges": mine, "resource_vectors": tables["resource_vectors"].join(of, "id", "left_semi")}, files, edge, **options)
        tables = tables | {"resource_edges": tables["resource_edges"].filter(F.col("kind") != edge).unionByName(found, allowMissingColumns=True)}
    return tables["resource_edges"]


def relink(tables: dict[str, DataFrame], files: DataFrame, kind: str = "describes", top_k: int = 10, **thresholds) -> DataFrame:
    """Resource edges after the files (id) changed: theirs are dropped and found anew among them, from stored vectors."""
    rest = tables["resource_edges"].join(files.select(F.col("id").alias("file_id")), "file_id", "left_anti")
    found = link_within(tables["resource_vectors"].withColumnRenamed("id", "qid"), tables["file_vectors"], files, top_k, kind=kind, **thresholds)
    return upsert_links(rest, found)
