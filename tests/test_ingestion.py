"""Parsers, readers, builds, stores, services and the command line, in temporary folders."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lodegraph import cli
from lodegraph.functions import chunk, summarize
from lodegraph.parse.facts import adapter
from lodegraph.plans import build, embed, mount
from lodegraph.plans.schemas import TABLES
from lodegraph.plans.store import Store
from lodegraph.service import Service
from lodegraph.sources import config, evalset, repository, resources

TS = """import { Base, type Opt as O } from './base.js';
import * as all from "./all";
const fs = require('fs');
export abstract class Service extends Base<User> implements Repo, Closer {
  constructor(private x: number) { super(x); }
  run(name: string): User { return helper(this.x, name); }
}
export const useThing = async (a: number): Promise<void> => { await run(a); };
export function Panel(props: Props) { return <Item x={1} />; }
interface Hidden { id: number }
export { inner as outer };
let a = 1, b = 2;
"""
GO = 'package p\nimport (\n\t"fmt"\n\tx "a/b"\n\t. "c/d"\n)\ntype User struct {\n\tName string\n}\ntype Doer interface {\n\tDo(id string) error\n}\nfunc (u *User) Save(n int) error {\n\treturn x.Call(u, helper(n))\n}\nfunc helper(n int) int { return n }\nvar (\n\tLimit = 3\n\tlow, high = 1, 2\n)\n'
JAVA = "package p;\nimport java.util.List;\nimport a.b.*;\npublic class A extends B implements C, D {\n  private int x = 1, y;\n  public A() { super(); }\n  public List<String> get(String k) throws E { return load(k); }\n  static void run() {}\n}\ninterface I extends J, K { void f(); }\n"
PY = "__all__ = ['run']\nimport os.path as p\nfrom . import q\nfrom m import *\nclass A(Base, Mixin):\n    def f(self): return go(1)\n@deco\ndef run(x: int, *y) -> str:\n    return A().f(x)\nLIMIT, other = 1, 2\n"


def symbols(language, source):
    return {(s.name, s.kind, s.exported): s for s in adapter(language).parse("x", source).symbols}


def test_typescript():
    s, f = symbols("typescript", TS), adapter("typescript").parse("x.ts", TS)
    assert set(s) == {("Service", "component", True), ("useThing", "hook", True), ("Panel", "component", True), ("Hidden", "type", False), ("inner", "variable", True), ("fs", "variable", False), ("a", "variable", False), ("b", "variable", False)}
    top = s[("Service", "component", True)]
    assert (top.extends, top.implements, top.start, top.end) == ("Base", ["Repo", "Closer"], 4, 7)
    assert [(i.module, i.kind, i.bindings) for i in f.imports] == [("./base.js", "named", [("Base", "Base"), ("Opt", "O")]), ("./all", "namespace", [("*", "all")]), ("fs", "require", [("default", "fs")])]
    assert {(n, o) for n, _, o in f.calls} == {("helper", "Service"), ("run", "useThing")}
    assert {"Base", "Repo", "Props", "Item"} <= {n for n, _, _ in f.refs}


def test_go():
    s, f = symbols("go", GO), adapter("go").parse("x.go", GO)
    assert set(s) == {("User", "class", True), ("Doer", "type", True), ("Save", "method", True), ("helper", "function", False), ("Limit", "variable", True), ("low", "variable", False), ("high", "variable", False)}
    assert s[("Save", "method", True)].signature == "(u *User) (n int) error"
    assert [(i.module, i.kind, i.bindings[0][1]) for i in f.imports] == [("fmt", "named", "fmt"), ("a/b", "named", "x"), ("c/d", "namespace", "d")]
    assert [(n, o) for n, _, o in f.calls] == [("Call", "Save"), ("helper", "Save")]


def test_java():
    s, f = symbols("java", JAVA), adapter("java").parse("A.java", JAVA)
    assert set(s) == {("A", "class", True), ("x", "variable", False), ("y", "variable", False), ("get", "method", True), ("run", "method", False), ("I", "type", False), ("f", "method", False)}
    assert (s[("A", "class", True)].extends, s[("A", "class", True)].implements) == ("B", ["C", "D"])
    assert (s[("I", "type", False)].extends, s[("I", "type", False)].implements) == ("J", ["K"])
    assert [(n, o) for n, _, o in f.calls] == [("load", "get")]
    assert [(i.module, i.kind) for i in f.imports] == [("java.util.List", "named"), ("a.b", "namespace")]


def test_python():
    s, f = symbols("python", PY), adapter("python").parse("x.py", PY)
    assert set(s) == {("A", "class", False), ("run", "function", True), ("LIMIT", "variable", False), ("other", "variable", False)}
    assert s[("run", "function", True)].start == 7 and s[("run", "function", True)].signature == "(x: int, *y) -> str"
    assert (s[("A", "class", False)].extends, s[("A", "class", False)].implements) == ("Base", ["Mixin"])
    assert [(i.module, i.kind) for i in f.imports] == [("os.path", "namespace"), (".", "named"), ("m", "namespace")]
    assert {(n, o) for n, _, o in f.calls} == {("go", "A"), ("A", "run"), ("f", "run")}
    assert {"Base", "Mixin", "deco", "int", "str"} <= {n for n, _, _ in f.refs}


def test_chunks_of_odd_inputs():
    assert chunk.markdown("") == [] and chunk.markdown("just text", "D")[0].name == "D"
    assert [c.name for c in chunk.markdown("#### deep\n# A\n```\n# no\n```\n## B")] == ["A", "B"]
    assert chunk.ddl("SELECT 1;") == [] and chunk.ddl("CREATE TABLE t (a int") == []
    assert [c.name for c in chunk.json_schema([{"table": "a", "fields": {"x": "int"}}, 3, {"columns": ["y"]}])] == ["a"]
    assert chunk.json_schema(None) == [] and chunk.json_schema(5) == []
    assert chunk.json_schema({"u": ["id", {"column": "n"}], "v": {"name": "w"}})[0].summary == "表 u，字段：id, n"
    for path in ("a.pdf", "b.doc"):
        with pytest.raises(chunk.UnsupportedFormatError):
            chunk.requirement_chunks(path, b"")


def office(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_office_files():
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = office(
        {
            "xl/workbook.xml": f'<workbook {main} {rel}><sheets><sheet name="users" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<R><x Id="r1" Target="worksheets/s.xml"/></R>',
            "xl/sharedStrings.xml": f"<sst {main}><si><t>id</t></si></sst>",
            "xl/worksheets/s.xml": f'<worksheet {main}><sheetData><row><c t="s"><v>0</v></c><c t="inlineStr"><is><t>name</t></is></c></row><row><c><v>1</v></c></row></sheetData></worksheet>',
        }
    )
    assert chunk.schema_chunks("a.xlsx", book)[0].summary == "表 users，字段：id, name"
    word = office({"word/document.xml": '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t># Head</w:t></w:r></w:p><w:p><w:r><w:t>body</w:t></w:r></w:p></w:body></w:document>'})
    assert chunk.requirement_chunks("x/a.docx", word)[0].summary == "Head. body"


def test_answers():
    assert summarize.parse_answer('```json\n{"file_summary": "f", "nodes": [{"name": "a", "summary": "s"}, {"name": 1}]}\n```') == ("f", {"a": "s"})
    for bad in ("no", "[]", '{"nodes": []}'):
        with pytest.raises(ValueError):
            summarize.parse_answer(bad)
    assert summarize.CUT in summarize.prompt("p", [("a", "", "x" * 2000)])


def test_retries():
    calls, slept = [], []

    def fail(status):
        def call():
            calls.append(1)
            raise embed.HttpError(status, "x")

        return call

    with pytest.raises(embed.HttpError):
        embed.with_retries(fail(429), sleep=slept.append)
    assert len(calls) == 4 and slept == [0.5, 1.0, 2.0]
    calls.clear()
    with pytest.raises(embed.HttpError):
        embed.with_retries(fail(401), sleep=slept.append)
    assert len(calls) == 1
    client = embed.EmbeddingClient("http://x/", "k", "m", 2, 2, send=lambda url, key, body: {"data": [{"index": i, "embedding": [float(len(t)), 0.0]} for i, t in reversed(list(enumerate(body["input"])))]})
    assert client(["a", "bb", "ccc"]) == [[1.0, 0.0], [2.0, 0.0], [3.0, 0.0]]


def test_failed_batches_are_marked(spark):
    def broken(texts):
        if "bad" in texts:
            raise ValueError
        return [[1.0]] * len(texts)

    rows = spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "ok")], "id long, text string").coalesce(1)
    assert {r.id: r.status for r in embed.embed_rows(rows, broken, "m", batch=1).collect()} == {1: "done", 2: "error", 3: "done"}


def test_config(tmp_path):
    own, user = tmp_path / "p.json", tmp_path / "u.json"
    own.write_text(json.dumps({"retrieval": {"hops": 3}}))
    user.write_text(json.dumps({"retrieval": {"hops": 1, "nodeTopK": 7}}))
    c = config.load(str(own), str(user), {"LODEGRAPH_LLM_KEY": "k"})
    assert (c["retrieval"]["hops"], c["retrieval"]["nodeTopK"], c["llm"]["apiKey"]) == (3, 7, "k")
    own.write_text(json.dumps({"llm": [{"apiKey": "x"}]}))
    with pytest.raises(ValueError, match="apiKey"):
        config.load(str(own), env={})
    own.write_text(json.dumps({"retrieval": {"hops": 9}}))
    with pytest.raises(ValueError):
        config.load(str(own), env={})
    assert config.mask("abcdefghij") == "abcd****ghij" and config.mask("short") == "****"


def test_eval_set(spark, tmp_path):
    f = tmp_path / "e.json"
    f.write_text(json.dumps({"queries": [{"query": "a", "expected_nodes": ["x", 3]}]}))
    assert [(r.query, r.expected) for r in evalset.read(spark, str(f)).collect()] == [("a", ["x"])]
    f.write_text(json.dumps([{"query": " "}]))
    with pytest.raises(ValueError):
        evalset.read(spark, str(f))


def tree(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_scan(spark, tmp_path):
    tree(tmp_path, {"src/a.ts": "x", "src/.b.ts": "x", "node_modules/c.ts": "x", "gen/d.py": "x", "e.txt": "x", "f.py": "a\0b", "lib/g.go": "package g", "keep/gen/h.py": "y"})
    out = repository.scan(spark, str(tmp_path), exclude=["**/node_modules/**"], gitignore="gen/\n!keep/gen/\n")
    assert {(r.file_path, r.language) for r in out.collect()} == {("src/a.ts", "typescript"), ("lib/g.go", "go"), ("keep/gen/h.py", "python")}
    only = spark.createDataFrame([("lib/g.go",)], "file_path string")
    assert [r.file_path for r in repository.scan(spark, str(tmp_path), only_paths=only).collect()] == ["lib/g.go"]


def test_build_query_and_mount(spark, tmp_path, capsys):
    root, where = tmp_path / "repo", str(tmp_path / "store")
    tree(root, {"pkg/models.py": "class User:\n    def save(self):\n        return normalize(1)\n\ndef normalize(x):\n    return x\n", "pkg/service.py": "from models import User\n\ndef create_user(name):\n    return User(normalize(name))\n"})
    assert cli.main(["--store", where, "build", str(root)], spark) == 0
    store = Store(spark, where)
    n = {r.name: r.node_id for r in store.read("nodes").collect()}
    assert set(n) == {"pkg/models.py", "pkg/service.py", "User", "normalize", "create_user"}
    e = {(r.source, r.target, r.kind) for r in store.read("edges").collect()}
    assert {(n["create_user"], n["User"], "calls"), (n["create_user"], n["normalize"], "calls"), (n["User"], n["normalize"], "calls")} <= e
    assert cli.main(["--store", where, "query", "create_user", "--json"], spark) == 0
    found = json.loads(capsys.readouterr().out.strip().split("\n")[-1])
    assert any(r["name"] == "create_user" and r["role"] == "hit" for r in found["rows"])
    s = Service(store)
    assert s.call("node", {"name": "normalize"})["result"]["callers"] == sorted([n["User"], n["create_user"]])
    assert {r["node_id"] for r in s.call("related", {"name": "normalize"})["result"]} >= {n["User"]}
    assert "error" in s.call("explore", {"query": ""}) and "error" in s.call("nothing", {}) and "5 nodes" in s.instructions()
    tree(tmp_path, {"docs/prd.md": "# Users\ncreate_user normalize"})
    assert cli.main(["--store", where, "mount", "prd", str(tmp_path / "docs/prd.md")], spark) == 0
    assert [r.name for r in Store(spark, where).read("resources").collect()] == ["Users"]


def test_incremental_equals_full(spark, tmp_path):
    cols = "file_path string, language string, source_code string"
    make = lambda rows: spark.createDataFrame(rows, cols).withColumn("hash", F.sha2("source_code", 256))
    a, b = ("p/a.py", "python", "def f():\n    return g()\n"), ("p/b.py", "python", "def g():\n    return 1\n")
    store = Store(spark, str(tmp_path / "s"))
    store.write(**build.full(make([a, b])))
    moved = ("p/c.py", "python", b[2])
    changes, tables = build.incremental(store.tables(), make([a, moved]))
    assert {(r.change, r.path, r.from_path) for r in changes.collect()} == {("renamed", "p/c.py", "p/b.py")}
    names = {r.node_id: r.name for r in tables["nodes"].collect()}
    assert {(names[r.source], r.kind, names[r.target]) for r in tables["edges"].collect()} == {("f", "calls", "g")}
    assert store.versions() == [1]
    store.write(**tables)
    store.prune(1)
    assert store.versions() == [2] and {r.file_path for r in store.read("files").collect()} == {"p/a.py", "p/c.py"}
    store.reset()
    assert not store.exists() and store.read("nodes").count() == 0


def test_ids_and_links_last_over_builds(spark, tmp_path, monkeypatch):
    root, where = tmp_path / "repo", str(tmp_path / "store")
    tree(root, {"p/b.py": "def keep():\n    return 1\n", "p/c.py": "def mover():\n    return keep()\n", "p/d.py": "def gone():\n    return 2\n"})
    tree(tmp_path, {"docs/prd.md": "# Keep\np/b.py keep\n# Gone\np/d.py gone"})
    assert cli.main(["--store", where, "build", str(root)], spark) == 0
    assert cli.main(["--store", where, "mount", "prd", str(tmp_path / "docs/prd.md")], spark) == 0
    t = Store(spark, where).tables()
    files = {r.file_path: r.file_id for r in t["files"].collect()}
    nodes = {r.name: r.node_id for r in t["nodes"].collect()}
    forged = [(1, 1, files["p/b.py"], "describes", 0.9, 0.9, "strong"), (2, 2, files["p/d.py"], "describes", 0.9, 0.9, "strong")]
    Store(spark, where).write(resource_edges=spark.createDataFrame(forged, TABLES["resource_edges"]))
    # one file comes first in path order, one moves, one goes, one has an error
    (root / "p/c.py").rename(root / "p/z.py")
    (root / "p/d.py").unlink()
    tree(root, {"a.py": "def early():\n    return keep()\n", "bad.py": "def broken(:\n"})
    parsed = []
    real = build.parse
    monkeypatch.setattr(build, "parse", lambda f: parsed.append(sorted(r.file_path for r in f.collect())) or real(f))
    assert cli.main(["--store", where, "build", str(root)], spark) == 0
    assert parsed == [["a.py", "bad.py", "p/z.py"]]
    t = Store(spark, where).tables()
    now = {r.file_path: r.file_id for r in t["files"].collect()}
    assert now["p/b.py"] == files["p/b.py"] and now["p/z.py"] == files["p/c.py"] and set(now) == {"a.py", "bad.py", "p/b.py", "p/z.py"}
    assert min(now["a.py"], now["bad.py"]) > max(files.values())
    names = {r.name: r.node_id for r in t["nodes"].collect()}
    assert all(names[x] == nodes[x] for x in ("keep", "mover", "p/b.py")) and names["p/z.py"] == nodes["p/c.py"] and "gone" not in names and "bad.py" in names
    e = {(r.source, r.target, r.kind) for r in t["edges"].collect()}
    assert e == {(names["mover"], names["keep"], "calls"), (names["early"], names["keep"], "calls")}
    assert [(r.resource_id, r.file_id) for r in t["resource_edges"].filter("link_type = 'strong' AND similarity = 0.9").collect()] == [(1, files["p/b.py"])]
    assert {r.file_id for r in t["resource_edges"].collect()} <= set(now.values())
    assert cli.main(["--store", where, "rebuild", str(root)], spark) == 0
    assert Store(spark, where).read("resources").isEmpty() and Store(spark, where).read("files").count() == 4


def test_mount_replaces_a_source(spark):
    tables = {k: spark.createDataFrame([], v) for k, v in TABLES.items()}
    tables["file_vectors"] = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], TABLES["file_vectors"])
    files = spark.createDataFrame([("/x.sql", bytearray(b"CREATE TABLE a (id int); CREATE TABLE b (id int);"))], "path string, content binary")
    once = mount.mount(tables, resources.chunk_rows(files, "db"), lambda texts: [[1.0, 0.0]] * len(texts))
    once = {k: spark.createDataFrame(v.collect(), v.schema) for k, v in once.items()}
    assert {(r.resource_id, r.file_id, r.kind, r.link_type) for r in once["resource_edges"].collect()} == {(1, 1, "reads", "strong"), (2, 1, "reads", "strong")}
    twice = mount.mount(once, resources.chunk_rows(files, "db"), None)
    assert {r.resource_id for r in twice["resources"].collect()} == {3, 4} and twice["resource_vectors"].count() == 0 and twice["resource_edges"].count() == 0


def test_summaries_by_a_model(spark):
    from lodegraph.plans.enrich import summarize

    files = spark.createDataFrame([(1, "a", None, "pending", None), (2, "bad", None, "pending", None)], "file_id long, file_path string, file_summary string, summary_status string, summary_model string")
    nodes = spark.createDataFrame([(1, 1, "x"), (2, 1, "y"), (3, 2, "z")], "node_id long, file_id long, name string").selectExpr("*", "'' AS signature", "'' AS source_code", "1 AS start_line", "CAST(NULL AS STRING) AS summary", "'pending' AS summary_status", "CAST(NULL AS STRING) AS summary_model")
    f, n = summarize(files, nodes, lambda p: "nothing" if "File: bad" in p else '{"file_summary": "f", "nodes": [{"name": "x", "summary": "sx"}]}', "m")
    assert {(r.file_id, r.file_summary, r.summary_status) for r in f.collect()} == {(1, "f", "done"), (2, None, "error")}
    assert {(r.name, r.summary, r.summary_status) for r in n.collect()} == {("x", "sx", "done"), ("y", None, "done"), ("z", None, "error")}
