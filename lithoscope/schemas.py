"""Relations as Spark schemas, and checks of JSON artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VERSION = "1.0"
#: Artifacts as Spark DDL. Fixed values.
ARTIFACTS = {
    "fileIndex": "schemaVersion string, repoRoot string, generatedAtIso string, files array<struct<path:string,bytes:bigint,sha256:string,lang:string,isBinary:boolean,mtimeMs:double>>, totals struct<fileCount:bigint,totalBytes:bigint>",
    "depGraph": "schemaVersion string, nodes array<string>, edges array<struct<from:string,to:string,kind:string,isExternal:boolean>>",
    "symbolIndex": "schemaVersion string, symbols array<struct<name:string,file:string,kind:string,exported:boolean>>",
    "runtimeSignals": "schemaVersion string, signals array<struct<file:string,line:int,kind:string,snippet:string>>",
    "brain_topology": "schemaVersion string, nodes array<struct<id:string,label:string,kind:string,riskFlags:array<string>,centrality:double>>, edges array<struct<from:string,to:string,kind:string,riskFlags:array<string>>>, metrics struct<nodeCount:bigint,edgeCount:bigint>",
    "flows": "schemaVersion string, flows array<struct<id:string,path:array<string>,kind:string,riskFlags:array<string>>>",
    "gaps_report": "schemaVersion string, summary struct<critical:bigint,high:bigint,medium:bigint,low:bigint>, gaps array<struct<id:string,severity:string,title:string,evidence:array<struct<file:string,line:int,note:string>>>>",
    "pack": "schemaVersion string, constraints struct<maxChars:bigint,maxEvidencePointers:bigint,maxNodes:bigint>, overview string, keyRisks array<string>, topologySummary struct<nodeCount:bigint,edgeCount:bigint,topCentralNodes:array<string>>, evidencePointers array<struct<path:string,note:string>>",
    "advanced_metrics": "schemaVersion string, pageRank map<string,double>, betweenness map<string,double>, gateways array<string>, stabilityIndex double",
    "rc_metrics": "schemaVersion string, healthScore double, nodeCount bigint, edgeCount bigint, duplicatePairs bigint, gatewayNodes bigint, structuralDensity double",
    "manifest": "schemaVersion string, toolVersion string, repoHash string, snapshotId string, runId string, generatedAtIso string, artifacts array<struct<pathRel:string,sha256:string>>",
    "telemetry": "schemaVersion string, scanMs bigint, graphMs bigint, topologyMs bigint, totalMs bigint",
    "duplicates": "schemaVersion string, pairs array<struct<pathA:string,pathB:string,simhashA:string,simhashB:string,hamming:int>>",
    "impact_report": "schemaVersion string, nodeId string, forwardCount bigint, backwardCount bigint, topNodes array<struct<nodeId:string,forward:bigint,backward:bigint,total:bigint>>",
    "last_verification": "schemaVersion string, verifiedAtIso string, hashMatch boolean, schemaValid boolean",
    "contracts_snapshot": "versions struct<schema:string>, timestamp string, schemaHashes map<string,string>, cliSourceHash string",
}
#: Fields that an artifact may lack. Fixed values.
OPTIONAL = {"mtimeMs", "line", "advancedMetricsHash", "notes"}
PYTHON = {"string": str, "bigint": int, "int": int, "double": (int, float), "boolean": bool}


def name_of(path: str) -> str:
    return path.rpartition("/")[2].removesuffix(".json")


def problems(path: str, value) -> list[str]:
    """What is wrong with an artifact, by its file name; nothing for names without a schema. A wrapped pack is unwrapped."""
    from pyspark.sql.types import _parse_datatype_string  # noqa: PLC2701

    ddl = ARTIFACTS.get(name_of(path))
    if not ddl:
        return []
    if name_of(path) == "pack" and isinstance(value, dict) and "payload" in value:
        value = value["payload"]
    return compared(_parse_datatype_string(ddl), value, name_of(path))


def compared(kind, value, at: str) -> list[str]:
    name = kind.typeName()
    if name == "struct":
        if not isinstance(value, dict):
            return [f"{at}: not an object"]
        out = [f"{at}.{f.name}: missing" for f in kind if f.name not in value and f.name not in OPTIONAL]
        if "schemaVersion" in kind.names and value.get("schemaVersion") not in (None, VERSION):
            out.append(f"{at}: schemaVersion {value['schemaVersion']}")
        return out + [p for f in kind if value.get(f.name) is not None for p in compared(f.dataType, value[f.name], f"{at}.{f.name}")]
    if name == "array":
        return [p for i, v in enumerate(value) for p in compared(kind.elementType, v, f"{at}[{i}]")] if isinstance(value, list) else [f"{at}: not an array"]
    if name == "map":
        return [p for k, v in value.items() for p in compared(kind.valueType, v, f"{at}.{k}")] if isinstance(value, dict) else [f"{at}: not an object"]
    ok = isinstance(value, PYTHON[kind.simpleString()]) and (kind.simpleString() == "boolean" or not isinstance(value, bool))
    return [] if ok and not (isinstance(value, int) and not isinstance(value, bool) and value < 0) else [f"{at}: {value!r} is no {kind.simpleString()}"]


def read_artifact(spark: SparkSession, path: str) -> DataFrame:
    """A JSON artifact as a relation with its schema; malformed JSON and other versions fail."""
    df = spark.read.schema(ARTIFACTS[name_of(path)]).option("multiLine", True).option("mode", "FAILFAST").json(path)
    if "schemaVersion" in df.columns and not df.filter(f"schemaVersion IS NULL OR schemaVersion <> '{VERSION}'").isEmpty():
        raise ValueError(f"{path}: schemaVersion isn't {VERSION}")
    return df
