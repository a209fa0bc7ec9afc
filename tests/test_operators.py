"""Operators on small inputs, with expected values, and against plain implementations."""

import math
import sqlite3

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodegraph.functions import text as T
from lodegraph.operators import evaluate, fusion, graph, knn, lexical, link, resolve, retrieval, sections
from lodegraph.plans import incremental as inc


def nodes_of(spark, ids):
    return spark.createDataFrame([(i, 1, f"n{i}", "function", 1, True) for i in ids], "node_id long, file_id long, name string, kind string, start_line int, is_exported boolean")


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "source long, target long, kind string")


GRAPH = [(1, 2, "calls"), (2, 3, "calls"), (1, 4, "calls"), (1, 2, "refs")]


@pytest.mark.parametrize(
    ("start", "direction", "hops", "kinds", "want"),
    [
        (1, "callees", 2, None, {2: 1, 4: 1, 3: 2}),
        (1, "callees", 1, None, {2: 1, 4: 1}),
        (3, "callers", 2, None, {2: 1, 1: 2}),
        (4, "both", 2, None, {1: 1, 2: 2}),
        (1, "callees", 2, ["refs"], {2: 1}),
        (1, "callees", 0, None, {}),
        (99, "both", 3, None, {}),
    ],
)
def test_traverse(spark, start, direction, hops, kinds, want):
    out = graph.traverse(nodes_of(spark, [1, 2, 3, 4]), edges_of(spark, GRAPH), start, direction, hops, kinds)
    assert {r.node_id: r.depth for r in out.collect()} == want


def test_traverse_cycle_start_and_missing_nodes(spark):
    e = edges_of(spark, [(1, 2, "calls"), (2, 1, "calls"), (2, 9, "calls")])
    n = nodes_of(spark, [1, 2])
    assert {r.node_id: r.depth for r in graph.traverse(n, e, 1, max_hops=5).collect()} == {2: 1}
    assert {r.node_id: r.depth for r in graph.traverse(n, e, 1, max_hops=5, include_start=True).collect()} == {1: 0, 2: 1}
    with pytest.raises(ValueError):
        graph.traverse(n, e, 1, max_hops=6)
    with pytest.raises(ValueError):
        graph.traverse(n, e, 1, "sideways")


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20), st.sets(st.integers(0, 8), min_size=1, max_size=3), st.integers(0, 3))
def test_expand_equals_plain_search(spark, pairs, seeds, hops):
    e = edges_of(spark, [(a, b, "calls") for a, b in pairs])
    out = graph.expand(nodes_of(spark, range(9)), e, spark.createDataFrame([(s,) for s in seeds], "node_id long"), "both", hops)
    near = {i: {b for a, b in pairs if a == i} | {a for a, b in pairs if b == i} for i in range(9)}
    want = {}
    for s in seeds:
        depth, level = {s: 0}, {s}
        for d in range(1, hops + 1):
            level = {y for x in level for y in near[x]} - set(depth)
            depth |= dict.fromkeys(level, d)
        for n, d in depth.items():
            old, by = want.get(n, (99, []))
            want[n] = (min(old, d), sorted([*by, s]))
    assert {r.node_id: (r.depth, r.seeds) for r in out.collect()} == want


def unit(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_knn_distances_and_limits(spark):
    v = unit(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0]), (4, None)])
    out = knn.knn(v, [1.0, 0.0], 5).collect()
    assert [(r.id, round(r.similarity, 6)) for r in out] == [(1, 1.0), (3, 1.0), (2, 0.0)]
    assert out[2].distance == pytest.approx(math.sqrt(2))
    assert knn.knn(v, [1.0, 0.0], 0).count() == 0
    assert [r.id for r in knn.knn_within(v, v.filter("id = 2"), [1.0, 0.0], 5).collect()] == [2]


def test_similarity_topk_equals_plain(spark):
    g = np.random.default_rng(0)
    q, v = g.standard_normal((300, 6)).astype(np.float32), g.standard_normal((70, 6)).astype(np.float32)
    v[5] = v[9]
    out = knn.similarity_topk(unit(spark, [(i, x.tolist()) for i, x in enumerate(q)], "qid"), unit(spark, [(i, x.tolist()) for i, x in enumerate(v)]).repartition(3), 4)
    d = np.sqrt(((q[:, None].astype(float) - v[None].astype(float)) ** 2).sum(-1))
    want = {(i, int(j)) for i in range(300) for j in np.lexsort((np.arange(70), d[i]))[:4]}
    assert {(r.qid, r.id) for r in out.collect()} == want


@pytest.mark.parametrize("query_bytes", [1 << 20, 600])
def test_similarity_topk_of_long_vectors(spark, query_bytes):
    g = np.random.default_rng(1)
    q, v = 1e6 + g.standard_normal((40, 8)), 1e6 + g.standard_normal((900, 8))
    side = lambda m, name: spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], f"{name} long, embedding array<double>").repartition(3)
    out = knn.similarity_topk(side(q, "qid"), side(v, "id"), 5, query_bytes)
    d = np.sqrt(((q[:, None] - v[None]) ** 2).sum(-1))
    assert {(r.qid, r.id) for r in out.collect()} == {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(900), d[i]))[:5]}
    assert knn.similarity_topk(side(q, "qid"), side(v, "id").filter("id < 3"), 5, query_bytes).count() == 120


def test_centroids_are_means(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 6.0]), (2, [5.0, 5.0]), (2, None), (None, [9.0, 9.0])], "g long, embedding array<float>").repartition(3)
    assert {r.id: r.embedding for r in knn.centroids(v, "g").collect()} == {1: [2.0, 4.0], 2: [5.0, 5.0]}


def test_imports_bind_the_local_name_first(spark):
    symbols = spark.createDataFrame([(1, "b", "other", 0), (2, "b", "createUser", 1), (3, "b", "User", 2)], "node_id long, file_path string, name string, ordinal int")
    rows = [(1, "b", "default", "createUser", "default"), (2, "b", "default", "unknown", "default"), (3, "b", "User", "createUser", "named"), (4, "b", "*", "User", "namespace"), (5, "b", "none", "User", "named"), (6, "b", "createUser", "x", "require")]
    out = resolve.bind_imports(spark.createDataFrame(rows, "import_id long, file_path string, imported string, local string, kind string"), symbols)
    assert {r.import_id: r.node_id for r in out.collect()} == {1: 2, 2: 1, 3: 3, 4: 3, 6: 1}


@pytest.mark.parametrize(("cosine", "grade", "confidence"), [(1.0, "strong", 1.0), (0.85, "strong", 0.85), (0.8, "weak", 0.64), (0.70, "weak", 0.56), (0.5, None, None)])
def test_link_grades(spark, cosine, grade, confidence):
    kind, conf = link.grade(F.lit(cosine))
    r = spark.range(1).select(kind.alias("k"), conf.alias("c")).first()
    assert r.k == grade and (r.c is None if confidence is None else r.c == pytest.approx(confidence))


def test_rrf(spark):
    ranks = lambda ids: spark.createDataFrame(list(zip(ids, range(len(ids)))), "id long, rank int")
    out = fusion.rrf(ranks([10, 20]), ranks([20, 10])).collect()
    assert [r.id for r in out] == [10, 20] and all(r.rrf_score == pytest.approx(1 / 60 + 1 / 61) and r.channel == "dense+fts5" for r in out)
    out = fusion.rrf(ranks([1]), ranks([2]), limit=1).collect()
    assert [(r.id, r.channel) for r in out] == [(1, "dense")]
    assert fusion.rrf(ranks([7, 8, 7]), ranks([])).first().rrf_score == pytest.approx(1 / 60)


def test_text_functions(spark):
    c = lambda col: spark.range(1).select(col.alias("c")).first().c
    assert c(T.match_expr(F.lit("user login"))) == '"user" OR "login"'
    assert c(T.match_expr(F.lit("get_user() AND drop"))) == '"get_user" OR "AND" OR "drop"'
    assert c(T.match_expr(F.lit("!@#$%"))) is None and c(T.match_expr(F.lit("溯源"))) is None
    assert c(T.escape_like(F.lit("a%b_c\\d"))) == "a\\%b\\_c\\\\d"
    assert c(T.occurrences(F.lit("aaaa"), "aa")) == 3 and c(T.occurrences(F.lit("a"), "aa")) == 0
    assert [c(T.extension(F.lit(p))) for p in ("a/b.test.TS", ".gitignore", "Makefile", "x/.a.ts")] == [".ts", "", "", ".ts"]
    assert c(T.identifier(F.lit('"db"."t_user"'))) == "t_user"
    assert c(T.contains_folded(F.lit("É"), "é")) is False and c(T.contains_folded(F.lit("ABC"), "bc")) is True


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("abcÉé 溯", max_size=12), st.none() | st.text("abcd éÉ溯源", max_size=20)), min_size=1, max_size=12), st.lists(st.text("abcé溯", min_size=3, max_size=4), min_size=1, max_size=3))
def test_bm25_equals_sqlite(spark, rows, tokens):
    db = sqlite3.connect(":memory:")
    try:
        db.execute("CREATE VIRTUAL TABLE t USING fts5(name, summary, tokenize='trigram')")
    except sqlite3.OperationalError:
        pytest.skip("no trigram index here")
    db.executemany("INSERT INTO t(rowid, name, summary) VALUES (?, ?, ?)", [(i, *r) for i, r in enumerate(rows)])
    want = db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ? ORDER BY 1", (" OR ".join(f'"{x}"' for x in tokens),)).fetchall()
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id long, name string, summary string")
    got = sorted((r.id, r.score) for r in lexical.bm25(docs, tokens).collect())
    assert [i for i, _ in got] == [i for i, _ in want]
    assert [s for _, s in got] == pytest.approx([s for _, s in want], abs=1e-9)


def test_search_ranks_and_fallback(spark):
    docs = spark.createDataFrame([(1, "authenticateUser", "login"), (2, "renderList", "ab"), (3, "parse", "溯源 origin"), (4, "xab", None)], "id long, name string, summary string")
    assert [(r.id, r.rank) for r in lexical.search(docs, "user 溯源", 5).collect()] == [(1, 0), (3, 1)]
    assert [r.id for r in lexical.search(docs, "ab", 5).collect()] == [2, 4]
    assert lexical.search(docs, "!!", 5).count() == 0 and lexical.search(docs, "user", 0).count() == 0


def test_hybrid_fallback_flag(spark):
    nodes = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [0.0, 1.0])], "id long, file_id long, embedding array<float>")
    files = unit(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0])])
    docs = spark.createDataFrame([(1, "alpha", ""), (2, "beta", "")], "id long, name string, summary string")
    o = retrieval.Options(file_top_k=1)
    near = retrieval.search_hybrid(files, nodes, docs, [1.0, 0.0], "beta", o).collect()
    assert [(r.id, r.channel, r.fallback) for r in near] == [(1, "dense", False), (2, "fts5", False)]
    wide = retrieval.search_hybrid(files, nodes.filter("id = 2"), docs, [1.0, 0.0], "zzz", o).collect()
    assert [(r.id, r.fallback) for r in wide] == [(2, True)]


def test_evaluation(spark):
    cases = spark.createDataFrame([(1, ["A", "b "], 10.0), (2, [], 20.0), (3, ["zz"], 30.0)], "query_id long, expected array<string>, elapsed_ms double")
    hits = spark.createDataFrame([(1, 0, "x"), (1, 1, "a"), (1, 2, "B"), (3, 0, "q")], "query_id long, rank int, name string")
    m = {r.query_id: r for r in evaluate.case_metrics(cases, hits, 2).collect()}
    assert (m[1].recall, m[1].reciprocal_rank, m[1].first_hit_rank) == (0.5, 0.5, 2)
    assert m[2].empty and m[2].recall is None and (m[3].recall, m[3].reciprocal_rank) == (0.0, 0.0)
    r = evaluate.report(evaluate.case_metrics(cases, hits, 2)).first()
    assert (r.total, r.valid, r.mean_recall, r.mrr, r.avg_query_ms) == (3, 2, 0.25, 0.25, 20.0)
    assert "miss" in evaluate.render_report(r, sorted(m.values(), key=lambda x: x.query_id))


def test_renames_need_a_unique_hash(spark):
    s = lambda rows: spark.createDataFrame(rows, "file_path string, hash string")
    old, new = s([("a", "1"), ("b", "2"), ("c", "3"), ("d", "3"), ("same", "9")]), s([("a2", "1"), ("b", "2x"), ("c2", "3"), ("same", "9"), ("n", "7")])
    out = {(r.change, r.path, r.from_path) for r in inc.with_renames(inc.diff(old, new)).collect()}
    assert out == {("renamed", "a2", "a"), ("modified", "b", None), ("deleted", "c", None), ("deleted", "d", None), ("added", "c2", None), ("added", "n", None)}


def test_summaries_are_kept_over_half(spark):
    cols = "file_path string, name string, source_code string, summary string, summary_status string"
    old = spark.createDataFrame([("f", "a", "1", "sa", "done"), ("f", "b", "2", "sb", "done"), ("g", "a", "1", "sg", "done")], cols)
    new = spark.createDataFrame([("f", "a", "1"), ("f", "b", "2!"), ("g", "a", "1!"), ("g", "c", "3")], "file_path string, name string, source_code string")
    out = {(r.file_path, r.name): (r.summary, r.summary_status) for r in inc.restore_summaries(old, new).collect()}
    assert out == {("f", "a"): ("sa", "done"), ("f", "b"): (None, "pending"), ("g", "a"): (None, "pending"), ("g", "c"): (None, "pending")}


def test_dense_ids_follow_the_order(spark):
    df = spark.createDataFrame([(f"p{i:03}",) for i in range(200)], "file_path string").repartition(7)
    assert [r.file_id for r in inc.assign_ids(df, "file_id", "file_path").orderBy("file_path").collect()] == list(range(1, 201))


def test_dense_ids_of_wide_rows(spark):
    # with the columns that the counts don't need, an exchange has several partitions to the end; without, Spark makes them one
    df = spark.range(40_000).select(F.format_string("p%05d", "id").alias("file_path"), F.concat(*[F.sha2(F.concat("id", F.lit(f"/{k}")), 256) for k in range(4)]).alias("hash")).repartition(7)
    out = inc.assign_ids(df, "file_id", "file_path").groupBy((F.col("file_id") - F.substring("file_path", 2, 5).cast("long")).alias("shift"))
    assert [(r.shift, r.n) for r in out.agg(F.count("hash").alias("n"), F.max("hash")).collect()] == [(1, 40_000)]


def test_sliced_edges_alone_are_exchanged(spark):
    edges = spark.range(20_000).selectExpr("id % 5000 AS source_key", "(id % 5000) * 7 % 5000 AS target_key", "'k' AS kind")
    edges = edges.union(spark.createDataFrame([(None, 3, "k"), (None, None, "k")], edges.schema))
    nodes = spark.createDataFrame([(3,), (3,), (77,), (None,)], "key long")
    out = inc.slice_edges(edges, nodes)
    expected = sorted({(s, s * 7 % 5000) for s in range(5000) if {s, s * 7 % 5000} & {3, 77}} | {(None, 3)}, key=str)
    for df in (out, inc.slice_edges(edges, nodes, broadcast_keys=1)):
        assert sorted(((r.source_key, r.target_key) for r in df.collect()), key=str) == expected
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    # the one exchange of edges is that of the result's distinct, above the joins
    top = plan.index("BroadcastHashJoin")
    assert plan[:top].count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(source_key" not in plan[top:] and "SortMergeJoin" not in plan


def test_import_candidates_and_sections(spark):
    tried = resolve.import_candidates("src/a/x.ts", "../b/y.js")
    assert tried[0] == "src/b/y.js" and "src/b/y.ts" in tried and tried[-8] == "src/b/y/index.ts"
    assert resolve.import_candidates("src/a.ts", "react") == []
    h = spark.createDataFrame([("d", 0, 1), ("d", 3, 2), ("d", 5, 2), ("d", 8, 1)], "doc string, pos int, level int")
    assert [(r.pos, r.end) for r in sections.section_ends(h).orderBy("pos").collect()] == [(0, 8), (3, 5), (5, 8), (8, None)]
