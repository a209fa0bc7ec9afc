"""From source files to graph tables, in full and by changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.functions.summarize import file_summaries, node_summary
from lodegraph.operators import resolve
from lodegraph.parse.frames import facts, parse
from lodegraph.plans.incremental import assign_ids, diff, rename, restore_summaries, upsert_files, with_renames
from lodegraph.runtime import checkpoint


def graph(files: DataFrame, parsed: DataFrame, old: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """files (file_path, language, source_code, hash) and their facts -> files, nodes and edges.

    A file has a module node named by its path, and a node for the first symbol of each name. Ids follow path and symbol
    order; beside old files and nodes, those that go on (by path, and name in it) keep their ids and new ones come after
    all others. Edges are all resolved anew over the facts given, so edges to and from files that didn't change are right, too.
    """
    ok = files.join(parsed.select("file_path"), "file_path", "left_semi").select("file_path", "language", "hash", "source_code")
    symbols = facts(parsed, "symbols")
    if old is None:
        f = assign_ids(ok.drop("source_code"), "file_id", "file_path")
    else:
        f = upsert_files(old["files"], ok.drop("source_code")).join(ok.select("file_path"), "file_path", "left_semi")
    f = checkpoint(f)
    first = symbols.groupBy("file_path", "name").agg(F.min_by(F.struct("kind", "signature", "start_line", "end_line", "is_exported", "source_code", "extends_name", "implements_names", "ordinal"), "ordinal").alias("s")).select("file_path", "name", "s.*")
    module = ok.select("file_path", F.col("file_path").alias("name"), F.lit("module").alias("kind"), F.lit("").alias("signature"), F.lit(1).alias("start_line"), F.size(F.split("source_code", "\n")).alias("end_line"), F.lit(False).alias("is_exported"), "source_code", F.lit(None).cast("string").alias("extends_name"), F.array().cast("array<string>").alias("implements_names"), F.lit(-1).alias("ordinal"))
    n = module.unionByName(first)
    if old is None:
        n = assign_ids(n, "node_id", "file_path", "ordinal")
    else:
        named = F.when(F.col("kind") == "module", F.col("file_path")).otherwise(F.col("name"))
        known = old["nodes"].join(old["files"].select("file_id", "file_path"), "file_id").select("file_path", named.alias("name"), "node_id")
        n = checkpoint(n.join(known, ["file_path", "name"], "left"))
        top = old["nodes"].agg(F.coalesce(F.max("node_id"), F.lit(0)).alias("top"))
        new = assign_ids(n.filter("node_id IS NULL").drop("node_id"), "node_id", "file_path", "ordinal").crossJoin(F.broadcast(top))
        n = n.filter("node_id IS NOT NULL").unionByName(new.withColumn("node_id", F.col("node_id") + F.col("top")).drop("top"))
    n = checkpoint(n.join(f.select("file_path", "file_id"), "file_path"))
    return {"files": f, "nodes": n, "edges": edges(parsed, n)}


def edges(parsed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target, kind, weak), each once, without those whose ends aren't known."""
    modules = nodes.filter("ordinal = -1").select("file_path", F.col("node_id").alias("module"))
    symbols = nodes.filter("ordinal >= 0").select("file_path", "name", "node_id", "ordinal", "is_exported", "extends_name", "implements_names")
    imports = facts(parsed, "imports").withColumn("import_id", F.xxhash64("file_path", "module_specifier", "line", "kind"))
    # imports: a relative specifier's file, then its bindings

    @F.pandas_udf("array<string>")
    def candidates(path: pd.Series, specifier: pd.Series) -> pd.Series:
        return pd.Series([resolve.import_candidates(p, s) for p, s in zip(path, specifier)], dtype=object)

    found = resolve.resolve_imports(imports.select("import_id", candidates("file_path", "module_specifier").alias("candidates")), modules).withColumnRenamed("file_path", "target_path")
    linked = imports.join(found, "import_id")
    each = linked.select("import_id", "file_path", "target_path", "kind", F.explode("bindings").alias("b")).select("import_id", F.col("file_path").alias("from"), F.col("target_path").alias("file_path"), F.col("b.imported").alias("imported"), F.col("b.local").alias("local"), "kind")
    bound = resolve.bind_imports(each, symbols).join(each.select("import_id", F.col("from").alias("file_path")).distinct(), "import_id").select("file_path", "local", "node_id")
    # an edge for each binding; an import of a file for its effects alone has none
    out = bound.join(modules, "file_path").select(F.col("module").alias("source"), F.col("node_id").alias("target"), F.lit("imports").alias("kind"), F.lit(False).alias("weak"))
    # calls and references: by name, in four steps; outside any symbol they belong to the module
    for kind in ("calls", "refs"):
        use = facts(parsed, kind).withColumn("call_id", F.xxhash64("file_path", "name", "line", F.coalesce("owner", F.lit(""))))
        hit = resolve.resolve_symbols(use.select("call_id", "file_path", "name").distinct(), symbols, bound)
        hit = hit.join(use.select("call_id", "owner").distinct(), "call_id").join(modules, "file_path")
        own = symbols.select("file_path", F.col("name").alias("owner"), F.col("node_id").alias("owner_id"))
        hit = hit.join(own, ["file_path", "owner"], "left")
        out = out.union(hit.select(F.coalesce("owner_id", "module").alias("source"), "target", F.lit(kind), "weak"))
    exported = symbols.filter("is_exported")
    parents = exported.filter("extends_name IS NOT NULL").select(F.col("node_id").alias("source"), F.lit("extends").alias("kind"), F.col("extends_name").alias("name"))
    parents = parents.union(exported.select(F.col("node_id").alias("source"), F.lit("implements").alias("kind"), F.explode("implements_names").alias("name")))
    out = out.union(resolve.resolve_heritage(parents, symbols).select("source", "target", "kind", F.lit(False)))
    return out.groupBy("source", "target", "kind").agg(F.min("weak").alias("weak"))


def summarize(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Heuristic summaries where none is done."""
    files, nodes = tables["files"], tables["nodes"]
    text = file_summaries(files, nodes).withColumnRenamed("file_summary", "_s")
    files = files.join(text, "file_id", "left").withColumn("file_summary", F.col("_s")).drop("_s").withColumn("summary_status", F.lit("done")).withColumn("summary_model", F.lit("heuristic"))
    held = F.col("summary") if "summary" in nodes.columns else F.lit(None).cast("string")
    nodes = nodes.withColumn("summary", F.coalesce(held, node_summary(F.col("name"), F.col("signature")))).withColumn("summary_status", F.lit("done")).withColumn("summary_model", F.lit("heuristic"))
    return tables | {"files": files, "nodes": nodes}


def full(files: DataFrame) -> dict[str, DataFrame]:
    parsed = checkpoint(parse(files))  # its facts are read many times
    return summarize(graph(files, parsed)) | {"facts": parsed}


def incremental(old: dict[str, DataFrame], files: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(changes, tables): the graph that a full build gives, but for ids: what goes on keeps its id.

    Only files that changed, or whose facts aren't stored, are parsed. Finished summaries of unchanged nodes are kept, and
    links of resources to files that went go.
    """
    changes = checkpoint(with_renames(diff(old["files"], files)))
    renames = changes.filter("change = 'renamed'").select("from_path", "path")
    here = old["facts"].join(files.select("file_path"), "file_path", "left_semi")
    kept = here.join(changes.select(F.col("path").alias("file_path")), "file_path", "left_anti")
    fresh = files.join(kept.select("file_path"), "file_path", "left_anti")
    parsed = checkpoint(kept.unionByName(parse(fresh)))
    now = old | {"files": rename(old["files"], renames)}
    new = graph(files, parsed, now)
    before = now["nodes"].join(now["files"].select("file_id", "file_path"), "file_id").select("file_path", "name", "source_code", "summary", "summary_status")
    tables = summarize(new | {"nodes": restore_summaries(before, new["nodes"])})
    links = old["resource_edges"].join(new["files"].select("file_id"), "file_id", "left_semi")
    return changes, tables | {"facts": parsed, "resource_edges": links}
