"""The mini tree with its known values, determinism, tampering, navigation."""

import json

import pytest
from lithoscope.operators import diff, graph, integrity
from lithoscope.plans.pipeline import Analysis, compare, run
from lithoscope.sources.tree import list_snapshots, read_tree

CLOCK = "2000-01-01T00:00:00.000Z"
FILES = {
    "README.md": None,
    "src/index.ts": 'import { u } from "./util.js";\nimport { start } from "./runtime";\n\nstart(u);\n',
    "src/util.ts": "export const u = 1;\n",
    "src/runtime.ts": 'import http from "http";\nimport fs from "fs";\nexport function start(n) {\n  http.createServer(() => n);\n  setInterval(() => {\n    n++;\n  }, 10);\n  fs.writeFileSync("out.txt", "hello");\n}\n',
    "_private.ts": "export const p = 2;\n",
    "__tests__/x.test.ts": 'import { u } from "../src/util";\n',
    "node_modules/a/index.ts": "ignored",
    ".hidden/x.ts": "ignored",
    "pic.PNG": b"\xff\xfe\x00",
    "bad.md": b"ok \xff\xfe end",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in FILES.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text if isinstance(text, bytes) else (text or "# Mini\n").encode())
    return root


def test_scan(spark, tree):
    rows = {r.path: r for r in read_tree(spark, str(tree)).collect()}
    assert set(rows) == {n for n in FILES if not n.startswith((".", "node_modules"))}
    import hashlib

    assert rows["pic.PNG"].sha256 == hashlib.sha256(FILES["pic.PNG"]).hexdigest() and rows["pic.PNG"].is_binary
    assert rows["bad.md"].sha256 == hashlib.sha256(FILES["bad.md"].decode("utf-8", "replace").encode()).hexdigest()
    assert rows["src/util.ts"].lang == "ts" and rows["src/util.ts"].bytes == len(FILES["src/util.ts"])


def test_facts(spark, tree):
    a = Analysis(read_tree(spark, str(tree)))
    assert sorted((r["from"], r["to"], r["kind"]) for r in a.edges.collect()) == [("__tests__/x.test.ts", "src/util.ts", "import"), ("src/index.ts", "src/runtime.ts", "import"), ("src/index.ts", "src/util.ts", "import")]
    assert sorted((r.file, r.line, r.kind, r.snippet) for r in a.signals.collect()) == [("src/runtime.ts", 4, "httpServer", "http.createServer(() => n);"), ("src/runtime.ts", 5, "setInterval", "setInterval(() => {"), ("src/runtime.ts", 8, "fsWrite", 'fs.writeFileSync("out.txt", "hello");')]
    topo = {r.id: r for r in a.topology.collect()}
    assert topo["src/runtime.ts"].flags == ["net-exposure", "timers", "writes"] and topo["src/index.ts"].centrality == 1.0
    assert {r.relation: r.id for r in a.impact("src/util.ts").filter("relation = 'reverse'").orderBy("id").collect()} == {"reverse": "src/index.ts"}
    assert a.impact("nowhere.ts").count() == 0
    assert a.rank(1).first().path == "src/index.ts"


def test_run_is_deterministic_and_verified(spark, tree, tmp_path):
    first, second = run(spark, str(tree), str(tmp_path / "a"), CLOCK), run(spark, str(tree), str(tmp_path / "b"), CLOCK)
    assert first == second and first["runId"] == first["runId"]
    gaps = json.loads((tmp_path / "a/analysis/gaps_report.json").read_text())
    assert [g["id"] for g in gaps["gaps"]] == ["net-exposure", "writes-without-ledger"]
    assert gaps["summary"] == {"critical": 0, "high": 0, "medium": 2, "low": 0}
    assert integrity.verify(str(tmp_path / "a")) == {"schemaVersion": "1.0", "verifiedAtIso": "1970-01-01T00:00:00.000Z", "hashMatch": True, "schemaValid": True}
    broken = tmp_path / "a/topology/brain_topology.json"
    broken.write_text(broken.read_text().replace('"schemaVersion":"1.0"', '"schemaVersion":"2.0"'))
    got = integrity.verify(str(tmp_path / "a"))
    assert not got["hashMatch"] and not got["schemaValid"]
    (tree / "extra.txt").write_text("new")
    run(spark, str(tree), str(tmp_path / "b"), CLOCK)
    (tree / "extra.txt").unlink()
    ids = list_snapshots(str(tmp_path / "b"))
    report = compare(spark, str(tmp_path / "b")).first()
    assert len(ids) == 2 and {*report.added, *report.removed} == {"extra.txt"}
    assert list_snapshots(str(tmp_path / "none")) == []


def test_limits(spark, tree):
    totals = integrity.scan_totals(read_tree(spark, str(tree)))
    with pytest.raises(ValueError):
        integrity.check_guard(totals, max_files=1)
    integrity.check_guard(totals, force=True, max_files=1)


def test_known_hashes(spark):
    """The record shape and run id of two files, worked out by hand."""
    import hashlib

    rows = [("b.ts", 2, "ts", False, "22"), ("a.md", 1, "md", False, "11")]
    got = integrity.input_hash(spark.createDataFrame(rows, "path string, bytes long, lang string, is_binary boolean, sha256 string")).first()
    text = '[{"bytes":1,"isBinary":false,"lang":"md","path":"a.md","sha256":"11"},{"bytes":2,"isBinary":false,"lang":"ts","path":"b.ts","sha256":"22"}]'
    assert got.input_hash == hashlib.sha256(text.encode()).hexdigest() and got.snapshot_id == got.input_hash[:12]


def test_manifest_order(spark):
    rows = spark.createDataFrame([(p, "0") for p in ("aB", "ab", "a/b", "a-b", "a_b")], "path string, sha256 string")
    assert [r.path_rel for r in integrity.manifest(rows).orderBy("nth").collect()] == ["a_b", "a-b", "a/b", "ab", "aB"]


@pytest.mark.parametrize("value, text", [(1.0, "1"), (0.1, "0.1"), (1e21, "1e+21"), (1.5e-7, "1.5e-7"), (1e-6, "0.000001"), (123456.789, "123456.789"), (-2.5, "-2.5"), (0.0, "0"), (5, "5"), (1.2345e22, "1.2345e+22")])
def test_numbers(value, text):
    assert integrity.canonical_json(value) == text


def test_canonical_json_and_paths(tmp_path):
    assert integrity.canonical_json({"b": [3, {"z": None, "a": True}], "a": "é\n"}) == '{"a":"é\\n","b":[3,{"a":true}]}'
    with pytest.raises(ValueError):
        integrity.write_atomic(str(tmp_path), "../x.json", {})


def test_delta(spark):
    edges = spark.createDataFrame([("a", "b"), ("c", "a"), ("d", "c"), ("b", "d"), ("b", "d")], "from string, to string")
    delta = spark.createDataFrame([("a", "added"), ("b", "removed"), ("c", "changed")], "path string, change string")
    assert sorted(r["shift"] for r in diff.dependency_shifts(edges, delta).collect()) == ["a -> b", "b -> d", "b -> d", "c -> a"]
    symbols = spark.createDataFrame([("a", "x"), ("c", "y")], "path string, name string")
    assert [tuple(r) for r in diff.delta_symbols(symbols, delta).collect()] == [("added", "a::x")]


def frames(spark, edges, nodes=None):
    names = sorted(nodes or {x for e in edges for x in e})
    return spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(edges, "from string, to string")


def test_betweenness_with_a_doubled_edge(spark):
    nodes, edges = frames(spark, [("a", "b"), ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("d", "d")])
    got = {r.id: r.betweenness for r in graph.betweenness(nodes, edges).collect()}
    assert got == pytest.approx({"a": 0, "b": 4 / 3, "c": 2 / 3, "d": 3, "e": 0})


def test_pagerank_sums_to_one_and_empty_graph_fails(spark):
    from lithoscope.operators import score

    nodes, edges = frames(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    ranks = {r.id: r["rank"] for r in graph.pagerank(nodes, edges).collect()}
    assert ranks == pytest.approx(dict.fromkeys("abc", 1 / 3))
    none = nodes.limit(0)
    assert score.metric_sanity(none, edges.limit(0), graph.pagerank(none, edges.limit(0))).first().failed == "n must be > 0"


def test_cycles(spark):
    nodes, edges = frames(spark, [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("b", "c"), ("e", "e"), ("f", "a"), ("d", "g")])
    assert sorted(r.members for r in graph.cycles(nodes, edges).collect()) == [["a", "b"], ["c", "d"]]
    weak = {r.id: r.component for r in graph.weak_components(nodes, edges).collect()}
    assert set(weak.values()) == {"a", "e"}
    seen = {(r.start, r.id) for r in graph.reach(edges, spark.createDataFrame([("f",), ("zz",)], "id string")).collect()}
    assert ("zz", "zz") in seen and {b for a, b in seen if a == "f"} == {"f", "a", "b", "c", "d", "g"}
