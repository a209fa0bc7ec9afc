"""Command line: build, rebuild, status, query, eval, mount, serve, config."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodegraph.operators import evaluate, summary
from lodegraph.plans import build, mount
from lodegraph.plans.embed import embed_rows, hashed
from lodegraph.plans.store import Store
from lodegraph.runtime import ship
from lodegraph.service import Service, render
from lodegraph.sources import config, evalset, repository, resources


def vectors(tables, embed):
    """File and node vectors of finished summaries."""
    files = tables["files"].select(F.col("file_id").alias("id"), F.coalesce("file_summary", "file_path").alias("text"))
    nodes = tables["nodes"].filter("summary IS NOT NULL").select(F.col("node_id").alias("id"), F.concat_ws("\n", "name", "summary").alias("text"))
    take = lambda rows: embed_rows(rows, embed, "hashed").filter("status = 'done'").select("id", "embedding")
    return {"file_vectors": take(files), "node_vectors": take(nodes)}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="lodegraph")
    p.add_argument("--store", default=".lodegraph/store")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "rebuild"):
        c = sub.add_parser(name)
        c.add_argument("root")
        c.add_argument("--dry-run", action="store_true")
        c.add_argument("--incremental", action="store_true")
    sub.add_parser("status")
    sub.add_parser("serve")
    c = sub.add_parser("query")
    c.add_argument("question")
    c.add_argument("--top-k", type=int, default=10)
    c.add_argument("--json", action="store_true")
    c = sub.add_parser("eval")
    c.add_argument("--test-set", required=True)
    c.add_argument("--top-k", type=int, default=10)
    c = sub.add_parser("mount")
    c.add_argument("type", choices=sorted(mount.KINDS))
    c.add_argument("file")
    c.add_argument("--top-k", type=int, default=10)
    c = sub.add_parser("config")
    c.add_argument("action", choices=["get", "set", "list", "path"])
    c.add_argument("key", nargs="?")
    c.add_argument("value", nargs="?")
    a = p.parse_args(argv)
    if a.command == "config":
        return settings(a)
    spark = spark or SparkSession.builder.appName("lodegraph").getOrCreate()
    ship(spark)
    store, embed = Store(spark, a.store), hashed()
    if a.command in ("build", "rebuild"):
        files = repository.scan(spark, a.root, exclude=config.DEFAULTS["project"]["exclude"])
        partial = a.command == "build" and store.exists()
        changes, tables = build.incremental(store.tables(), files) if partial else (None, build.full(files))
        if a.dry_run:
            for name in ("nodes", "edges"):
                print({r["kind"]: r["n"] for r in summary.count_by(tables[name], "kind").orderBy("kind").collect()})
            return 0
        if a.command == "rebuild":
            store.reset()
        store.write(**tables)
        version = store.write(**vectors(store.tables(), embed))
        if partial:
            t = store.tables()
            changed = t["files"].join(changes.select(F.col("path").alias("file_path")), "file_path", "left_semi").select(F.col("file_id").alias("id"))
            version = store.write(resource_edges=mount.relink_all(t, changed))
        print(f"version {version}")
    elif a.command == "status":
        t = store.tables()
        print(json.dumps(summary.graph_stats(**t).first().asDict()))
        print(json.dumps({r["summary_status"]: r["n"] for r in summary.count_by(t["files"], "summary_status").collect()}))
    elif a.command == "query":
        out = Service(store, embed).explore({"query": a.question, "topK": a.top_k}, direct=False)
        print(json.dumps(out, default=str) if a.json else render(out))
    elif a.command == "eval":
        print(run_eval(store, embed, evalset.read(spark, a.test_set), a.top_k))
    elif a.command == "mount":
        t = store.tables()
        store.write(**{k: v for k, v in mount.mount(t, resources.chunks(spark, a.file, a.type), embed, a.top_k).items() if k.startswith("resource")})
    elif a.command == "serve":
        service = Service(store, embed)
        for line in sys.stdin:
            request = json.loads(line)
            print(json.dumps({"id": request.get("id")} | service.call(request.get("tool"), request.get("args") or {}), default=str), flush=True)
    return 0


def run_eval(store: Store, embed, cases, top_k: int) -> str:
    """Each case is searched and timed on its own; the metrics are computed together."""
    service, spark, hits, times = Service(store, embed), store.spark, [], []
    names = service.t["nodes"].select(F.col("node_id").alias("id"), "name")
    for c in cases.select("query_id", "query").collect():
        began = time.perf_counter()
        found = service.hits(c["query"], top_k)[0].join(names, "id", "left").orderBy(F.desc("rrf_score"), "id").collect()
        times.append((c["query_id"], (time.perf_counter() - began) * 1000))
        hits += [(c["query_id"], i, h["name"]) for i, h in enumerate(found)]
    timed = cases.join(spark.createDataFrame(times, "query_id long, elapsed_ms double"), "query_id")
    metrics = evaluate.case_metrics(timed, spark.createDataFrame(hits, "query_id long, rank int, name string"), top_k)
    return evaluate.render_report(evaluate.report(metrics).first(), metrics.orderBy("query_id").collect())


def settings(a) -> int:
    path = ".lodegraph/config.json"
    if a.action == "path":
        print(path)
    elif a.action == "set":
        try:
            value = json.loads(a.value)
        except json.JSONDecodeError:
            value = a.value
        if config.secret_keys(config.merge({}, {a.key.rpartition(".")[2]: value})):
            raise SystemExit("credentials go into the environment, not into the project's settings")
        config.put(path, a.key, value)
    else:
        loaded = config.load(path)
        for part in ("llm", "embedding"):
            loaded[part] = loaded[part] | {"apiKey": config.mask(loaded[part]["apiKey"])}
        print(json.dumps(config.get(loaded, a.key) if a.action == "get" else loaded))
    return 0


if __name__ == "__main__":
    sys.exit(main())
