"""Turning names and temporary ids into node ids, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.text import dir_of


def resolve_edges(edges: DataFrame, batch: DataFrame, stored: DataFrame) -> DataFrame:
    """edges (source_key, target_key, kind), keys (key, node_id) -> the edges with source and target ids, null where unknown.

    Keys of the batch come before those stored; the first id wins where a key repeats.
    """
    first = batch.withColumn("t", F.lit(0)).unionByName(stored.withColumn("t", F.lit(1))).groupBy("key").agg(F.min(F.struct("t", "node_id"))["node_id"].alias("node_id"))
    s = first.select(F.col("key").alias("source_key"), F.col("node_id").alias("source"))
    t = first.select(F.col("key").alias("target_key"), F.col("node_id").alias("target"))
    return edges.join(s, "source_key", "left").join(t, "target_key", "left")


def resolution_counts(resolved: DataFrame) -> DataFrame:
    """(resolved, unresolved): different edges with both ends known, and edges that miss one."""
    known = resolved.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target", "kind").distinct()
    return known.agg(F.count(F.lit(1)).alias("resolved")).crossJoin(resolved.agg(F.coalesce(F.sum((F.col("source").isNull() | F.col("target").isNull()).cast("long")), F.lit(0)).alias("unresolved")))


def resolve_symbols(calls: DataFrame, symbols: DataFrame, bindings: DataFrame | None = None) -> DataFrame:
    """calls (call_id, file_path, name), symbols (node_id, file_path, name, ...), bindings (file_path, local, node_id).

    The target is the first of: the symbol in the same file, an import binding, the symbol of the first file of the same
    directory, a symbol whose name no other has (then weak is true). Calls without target are dropped.
    """
    own = symbols.groupBy("file_path", "name").agg(F.min("node_id").alias("t1"))
    near = symbols.withColumn("dir", dir_of(F.col("file_path"))).groupBy("dir", "name").agg(F.min(F.struct("file_path", "node_id"))["node_id"].alias("t3"))
    only = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("t4")).filter("n = 1").drop("n")
    out = calls.withColumn("dir", dir_of(F.col("file_path"))).join(own, ["file_path", "name"], "left")
    if bindings is None:
        out = out.withColumn("t2", F.lit(None).cast("long"))
    else:
        bound = bindings.groupBy("file_path", F.col("local").alias("name")).agg(F.min("node_id").alias("t2"))
        out = out.join(bound, ["file_path", "name"], "left")
    out = out.join(near, ["dir", "name"], "left").join(only, "name", "left")
    out = out.withColumn("target", F.coalesce("t1", "t2", "t3", "t4"))
    weak = F.coalesce("t1", "t2", "t3").isNull()
    return out.filter("target IS NOT NULL").select("call_id", "file_path", "name", "target", weak.alias("weak"))


#: Endings tried for a relative import, in order
EXTENSIONS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs")


def import_candidates(path: str, specifier: str) -> list[str]:
    """Paths that a relative specifier in the file may mean, in order of trial; none for a bare one."""
    from lodegraph.functions.text import normalize_path

    if not specifier.startswith("."):
        return []
    base = normalize_path(f"{path.rpartition('/')[0]}/{specifier}".lstrip("/"))
    script = next((x for x in EXTENSIONS[4:] if base.endswith(x)), "")
    stem = base.removesuffix(script)
    tried = [base, *(base + x for x in EXTENSIONS)]
    if script:  # written with the ending of what the compiler makes
        tried += [stem + x for x in EXTENSIONS]
    return [*tried, *(f"{stem}/index{x}" for x in EXTENSIONS)]


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (import_id, candidates array<string>) , files (file_path) -> import_id, file_path: the first candidate that exists."""
    tried = imports.select("import_id", F.posexplode("candidates").alias("pos", "file_path"))
    return tried.join(files.select("file_path").distinct(), "file_path").groupBy("import_id").agg(F.min_by("file_path", "pos").alias("file_path"))


def bind_imports(bindings: DataFrame, symbols: DataFrame) -> DataFrame:
    """bindings (import_id, file_path: the imported file, imported, local, kind), symbols (node_id, file_path, name, ordinal) -> import_id, local, node_id.

    A named import is the file's symbol of the imported name. A default, namespace or require import is the symbol with
    the local name, else the file's first symbol.
    """
    named = symbols.groupBy("file_path", F.col("name").alias("wanted")).agg(F.min("node_id").alias("match"))
    first = symbols.groupBy("file_path").agg(F.min_by("node_id", "ordinal").alias("first"))
    wanted = F.when(F.col("kind") == "named", F.col("imported")).otherwise(F.col("local"))
    out = bindings.withColumn("wanted", wanted).join(named, ["file_path", "wanted"], "left").join(first, "file_path", "left")
    node = F.coalesce("match", F.when(F.col("kind") != "named", F.col("first")))
    return out.select("import_id", "local", node.alias("node_id")).filter("node_id IS NOT NULL")


def resolve_heritage(heritage: DataFrame, symbols: DataFrame) -> DataFrame:
    """heritage (source, kind, name) -> source, target, kind where exactly one symbol has the name."""
    only = symbols.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("node_id").alias("target")).filter("n = 1")
    return heritage.join(only, "name").select("source", "target", "kind")
