"""The whole analysis of a tree: relations planned once, artifacts written, hashed and recorded."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lithoscope.functions.text import is_test_path
from lithoscope.operators import diff, essence, export, extract, graph, integrity, resolve, rules, score, similarity, topology
from lithoscope.sources.tree import list_snapshots, read_tree

TOOL_VERSION = "0.1.0"


class Analysis:
    """Relations of one tree of files (path, text, bytes, lang, is_binary, sha256), each computed once."""

    def __init__(self, files: DataFrame):
        self.files = files.persist()
        self.scripts = extract.script_files(self.files)
        self.nodes = self.scripts.select(F.col("path").alias("id"))
        self.signals = extract.runtime_signals(self.scripts).persist()
        self.edges = resolve.dep_edges(self.scripts, self.files).persist()
        self.symbols = extract.extract_exports(self.scripts)
        self.in_repo = topology.edges_in_repo(self.edges, self.nodes).persist()
        self.topology = topology.topology_nodes(self.nodes, self.edges, self.signals).persist()
        self.tests = self.files.filter(is_test_path("path")).select(F.col("path").alias("id"))

    def gaps(self) -> DataFrame:
        return rules.gap_rules(self.signals, graph.cycles(self.nodes, self.in_repo), rules.has_tests(self.files))

    def metrics(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Ranks, betweenness and gateways of a sound topology; others fail."""
        sound = graph.invariants(self.nodes, self.in_repo).first()
        if not (sound.unique_ids and sound.ends_known):
            raise ValueError("topology invariants violated")
        ranks = graph.pagerank(self.nodes, self.in_repo).persist()
        sane = score.metric_sanity(self.nodes, self.in_repo, ranks).first()
        if not sane.ok:
            raise ValueError(sane.failed)
        between = graph.betweenness(self.nodes, self.in_repo).persist()
        return ranks, between, graph.gateways(between)

    def duplicates(self) -> DataFrame:
        texts = self.files.filter(~F.col("is_binary") & F.col("lang").isin(*similarity.TEXT_LANGS))
        return similarity.duplicate_pairs(similarity.simhash64(texts))

    def impact(self, target: str) -> DataFrame:
        return graph.neighbours(self.edges, self.nodes, target)

    def risk(self, target: str) -> DataFrame:
        return score.risk_score(self.impact(target), self.topology, self.tests, target)

    def rank(self, n: int = 20) -> DataFrame:
        return topology.rank_top(topology.rank_entries(self.nodes, self.edges, self.symbols, self.topology), n)

    def focus(self, target: str) -> DataFrame:
        return essence.focused_essence(target, self.impact(target), self.edges, self.topology, self.symbols, self.tests)

    def delta(self, before: DataFrame) -> dict[str, DataFrame]:
        """What changed since an earlier (path, sha256)."""
        files = diff.file_delta(before, self.files.select("path", "sha256"))
        return {"files": files, "symbols": diff.delta_symbols(self.symbols, files), "shifts": diff.dependency_shifts(self.edges, files)}

    def export(self, fmt: str) -> DataFrame:
        return export.FORMATS[fmt](self.nodes, self.in_repo)


def records(df: DataFrame, *order: str) -> list[dict]:
    """The rows of an artifact, which is one JSON document by contract, in order."""
    return [json.loads(r) for r in df.orderBy(*order).select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]]


def run(spark: SparkSession, root: str, out: str, clock: str | None = None, max_files: int = 50_000, max_bytes: int = 2_000_000_000, force: bool = False, command: str = "run") -> dict:
    """Scans a tree, writes artifacts under out, and returns the ledger entry. A second run gives the same bytes.

    command: how far it goes (scan, map, gaps, essence; any other goes to the end)."""
    at, began = integrity.clock(clock), time.time()

    def finish() -> dict:
        run_id = integrity.hashlib.sha256(f"{hashes.input_hash}|{at}".encode()).hexdigest()[:12]
        entry = {"runId": run_id, "atIso": at, "command": command, "repoRoot": root, "inputHash": hashes.input_hash, "outputHash": integrity.folder_output_hash(out, names), "artifacts": sorted(names), "notes": []}
        integrity.append_ledger(out, entry)
        return entry

    files = read_tree(spark, root)
    integrity.check_guard(integrity.scan_totals(files), force, max_files=max_files, max_bytes=max_bytes)
    a = Analysis(files)
    hashes, totals = integrity.input_hash(a.files).first(), integrity.scan_totals(a.files).first()
    scanned = time.time()
    put = lambda name, value: integrity.write_atomic(out, name, value) and name
    index = records(a.files.select("path", "bytes", "sha256", "lang", F.col("is_binary").alias("isBinary")), "path")
    names = [put(f"snapshots/{hashes.snapshot_id}/fileIndex.json", {"schemaVersion": "1.0", "repoRoot": root, "generatedAtIso": at, "files": index, "totals": {"fileCount": totals.file_count, "totalBytes": totals.total_bytes}})]
    if command == "scan":
        return finish()
    names.append(put("facts/runtimeSignals.json", {"schemaVersion": "1.0", "signals": records(a.signals, "file", "line", "kind", "snippet")}))
    edges = records(a.edges.select("from", "to", "kind", F.col("is_external").alias("isExternal")), "from", "to", "kind")
    nodes = [r["id"] for r in records(a.nodes, "id")]
    names.append(put("facts/depGraph.json", {"schemaVersion": "1.0", "nodes": nodes, "edges": edges}))
    names.append(put("facts/symbolIndex.json", {"schemaVersion": "1.0", "symbols": []}))
    graphed = time.time()
    topo = records(a.topology.select("id", F.col("id").alias("label"), F.lit("module").alias("kind"), F.col("flags").alias("riskFlags"), "centrality"), "id")
    links = [{"from": e["from"], "to": e["to"], "kind": "imports", "riskFlags": []} for e in records(a.in_repo.select("from", "to"), "from", "to")]
    names.append(put("topology/brain_topology.json", {"schemaVersion": "1.0", "nodes": topo, "edges": links, "metrics": {"nodeCount": len(topo), "edgeCount": len(links)}}))
    flows = records(topology.flows(a.topology).select(F.col("flow_id").alias("id"), F.array("id").alias("path"), "kind", F.col("flags").alias("riskFlags")), "id")
    names.append(put("topology/flows.json", {"schemaVersion": "1.0", "flows": flows}))
    done = time.time()
    if command == "map":
        return finish()
    gaps = a.gaps().persist()
    summary = {k: v for k, v in rules.gap_summary(gaps).first().asDict().items()}
    listed = records(rules.gap_order(gaps).select(F.col("gap_id").alias("id"), "severity", "title", "evidence", rules.severity_rank(F.col("severity")).alias("o")), "o", "title", "id")
    for g in listed:
        del g["o"]
    names.append(put("analysis/gaps_report.json", {"schemaVersion": "1.0", "summary": summary, "gaps": listed}))
    names.append(put("analysis/gaps_report.md", rules.gaps_markdown(gaps).first().text))
    if command == "gaps":
        return finish()
    stable = score.stability(a.nodes, a.in_repo).persist()
    pack = essence.essence(a.topology, stable, gaps).persist()
    p = pack.first()
    payload = {"schemaVersion": "1.0", "constraints": {"maxChars": 12000, "maxEvidencePointers": 30, "maxNodes": 200}, "overview": p.overview, "keyRisks": p.key_risks, "topologySummary": {"nodeCount": len(topo), "edgeCount": len(links), "topCentralNodes": p.top_central}, "evidencePointers": [e.asDict() for e in p.evidence]}
    run_id = integrity.hashlib.sha256(f"{hashes.input_hash}|{at}".encode()).hexdigest()[:12]
    identity = {"runId": run_id, "snapshotId": hashes.snapshot_id, "inputHash": hashes.input_hash}
    names.append(put("essence/pack.json", {"identity": identity, "payload": payload}))
    names.append(put("essence/pack.md", essence.essence_markdown(pack).first().text))
    if command == "essence":
        return finish()
    ms = lambda x, y: int(1000 * (y - x))
    put("telemetry.json", {"schemaVersion": "1.0", "scanMs": ms(began, scanned), "graphMs": ms(scanned, graphed), "topologyMs": ms(graphed, done), "totalMs": ms(began, done)})
    ranks, between, gates = a.metrics()
    gateways = [r.id for r in gates.collect()]
    put("advanced/advanced_metrics.json", {"schemaVersion": "1.0", "pageRank": {r.id: r["rank"] for r in ranks.collect()}, "betweenness": {r.id: r.betweenness for r in between.collect()}, "gateways": gateways, "stabilityIndex": stable.first().stability})
    health = score.health(stable, rules.gap_summary(gaps), 0, len(gateways)).first()
    names.append(put("rc_metrics.json", {"schemaVersion": "1.0", "healthScore": health.health, "nodeCount": len(topo), "edgeCount": len(links), "duplicatePairs": 0, "gatewayNodes": len(gateways), "structuralDensity": health.structural_density}))
    made = spark.createDataFrame([(n, integrity.hashlib.sha256(integrity.Path(out, n).read_bytes()).hexdigest()) for n in names], "path string, sha256 string")
    artifacts = [{"pathRel": r.path_rel, "sha256": r.sha256} for r in integrity.manifest(made).orderBy("nth").collect()]
    names.append(put("manifest.json", {"schemaVersion": "1.0", "toolVersion": TOOL_VERSION, "repoHash": hashes.input_hash, "snapshotId": hashes.snapshot_id, "runId": run_id, "generatedAtIso": at, "artifacts": artifacts}))
    return finish()


def compare(spark: SparkSession, out: str, first: str | None = None, second: str | None = None) -> DataFrame:
    """The diff report of two snapshots, by default of the last two in the order of their names."""
    ids = list_snapshots(out)
    first, second = first or ids[-2], second or ids[-1]
    from lithoscope.schemas import read_artifact

    index = lambda s: read_artifact(spark, f"{out}/snapshots/{s}/fileIndex.json").select(F.inline("files"))
    return diff.diff_report(index(first), index(second))


def inspect(out: str) -> dict:
    """Counts from the artifacts of the last ledger entry; what isn't there is left out."""
    entry = integrity.latest_ledger(out)
    if entry is None:
        raise ValueError("ledger is empty")
    found = {"runId": entry["runId"], "command": entry["command"], "artifacts": len(entry["artifacts"])}
    counts = {"fileIndex": ("files", "files"), "depGraph": ("dependencies", "edges"), "runtimeSignals": ("signals", "signals"), "flows": ("flows", "flows"), "gaps_report": ("gaps", "gaps")}
    for path in entry["artifacts"]:
        name = path.rpartition("/")[2].removesuffix(".json")
        if name in counts and integrity.Path(out, path).exists():
            found[counts[name][0]] = len(json.loads(integrity.Path(out, path).read_text(encoding="utf-8"))[counts[name][1]])
    return found
