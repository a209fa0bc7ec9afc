"""The read-only tools over a store: arguments are checked, results are plain data."""

from __future__ import annotations

from lodegraph.operators import graph, retrieval, summary
from lodegraph.plans.embed import Embed
from lodegraph.plans.store import Store
from pyspark.sql import functions as F

QUERY_CHARS, TOP_K = 2000, 50


def text(value, name: str) -> str:
    if not isinstance(value, str) or not value.strip():
        raise ValueError(f"{name} must be a text that isn't blank")
    if len(value) > QUERY_CHARS:
        raise ValueError(f"{name} must have at most {QUERY_CHARS} characters")
    return value


def whole(value, name: str, least: int, most: int, default: int) -> int:
    value = default if value is None else value
    if not isinstance(value, int) or isinstance(value, bool) or not least <= value <= most:
        raise ValueError(f"{name} must be a whole number from {least} to {most}")
    return value


class Service:
    def __init__(self, store: Store, embed: Embed | None = None):
        self.store, self.embed, self.t = store, embed, store.tables()
        self.tools = {"explore": self.explore, "node": self.node, "file": self.file, "related": self.related}

    def call(self, tool: str, args: dict) -> dict:
        """A tool's result; errors become a message instead of ending the service."""
        try:
            if tool not in self.tools:
                raise ValueError(f"no tool {tool}")
            return {"result": self.tools[tool](args)}
        except ValueError as e:
            return {"error": str(e)}

    def dense(self) -> bool:
        return self.embed is not None and not self.t["node_vectors"].isEmpty()

    def hits(self, query: str, limit: int):
        n = self.t["nodes"]
        docs = n.select(F.col("node_id").alias("id"), "name", "summary")
        vector = self.embed([query])[0] if self.dense() else None
        vectors = self.t["node_vectors"].join(n.select(F.col("node_id").alias("id"), "file_id"), "id") if vector else None
        return retrieval.search_hybrid(self.t["file_vectors"], vectors, docs, vector, query, retrieval.Options(limit=limit)), vector

    def explore(self, args: dict, direct: bool = True) -> dict:
        query, top_k, hops = text(args.get("query"), "query"), whole(args.get("topK"), "topK", 1, TOP_K, 5), whole(args.get("hops"), "hops", 0, 5, 2)
        hits, vector = self.hits(query, top_k)
        found = retrieval.explore(self.t["nodes"], self.t["files"], self.t["edges"], hits, hops)
        rows = [r.asDict() for r in found.orderBy("role", "depth", F.desc("rrf_score"), "id").collect()]
        files = self.t["nodes"].join(found.select(F.col("id").alias("node_id")), "node_id", "left_semi").select("file_id").distinct().withColumn("file_pos", F.col("file_id"))
        resources = retrieval.attach_resources(files, self.t["resource_edges"])
        if direct:
            alone = retrieval.search_resources(self.t["resources"].select(F.col("resource_id").alias("id"), "name", "summary"), self.t["resource_vectors"] if vector else None, vector, query, 3)
            resources = resources.unionByName(retrieval.direct_resources(alone, resources))
        return {"mode": "dense+fts5" if vector else "fts5-only", "rows": rows, "resources": [r.asDict() for r in resources.collect()]}

    def node(self, args: dict) -> dict:
        file = args.get("file")
        rows = graph.node_detail(self.t["nodes"], self.t["files"], self.t["edges"], text(args.get("name"), "name"), text(file, "file") if file is not None else None).collect()
        return rows[0].asDict() if rows else {}

    def file(self, args: dict) -> list[dict]:
        return [r.asDict() for r in graph.file_info(self.t["nodes"], self.t["files"], text(args.get("path"), "path")).collect()]

    def related(self, args: dict) -> list[dict]:
        direction = args.get("direction") or "both"
        return [r.asDict() for r in graph.related(self.t["nodes"], self.t["edges"], text(args.get("name"), "name"), direction).collect()]

    def instructions(self) -> str:
        s = summary.graph_stats(files=self.t["files"], nodes=self.t["nodes"], edges=self.t["edges"], resources=self.t["resources"]).first()
        if not s["nodes"]:
            return "The graph is empty; run build first."
        return f"The graph has {s['files']} files, {s['nodes']} nodes, {s['edges']} edges and {s['resources']} resources. Start with explore; node, file and related give details."


def render(result: dict) -> str:
    """Text of an explore result."""
    where = lambda r: f"{r['file_path'] or '?'}"
    lines = [f"mode: {result['mode']}"]
    lines += [f"{r['rrf_score']:.5f} {r['kind']} {r['name']} ({where(r)})" for r in result["rows"] if r["role"] == "hit"]
    lines += [f"  +{r['depth']} {r['kind']} {r['name']} ({where(r)})" for r in result["rows"] if r["role"] != "hit"]
    return "\n".join(lines + [f"resource {r['resource_id']} {r['kind']} {r['confidence']:.2f}" for r in result["resources"]])
