"""Hashes, canonical JSON, manifests, ledger and verification."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SNAPSHOT_CHARS = 12


def content_hash(files: DataFrame) -> DataFrame:
    """path, sha256 of content (binary): of the bytes of binary files, else of the text, invalid UTF-8 replaced."""
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return files.select("path", F.when(F.col("is_binary"), F.sha2("content", 256)).otherwise(F.sha2(text, 256)).alias("sha256"))


def scan_totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("file_count"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("total_bytes"))


def scan_guard(totals: DataFrame, max_files: int = 50_000, max_bytes: int = 2 * 1024**3, warn_files: int = 10_000, warn_bytes: int = 50 * 1024**2) -> DataFrame:
    """One row: whether the hard limits and the soft ones are passed."""
    return totals.select("file_count", "total_bytes", ((F.col("file_count") > max_files) | (F.col("total_bytes") > max_bytes)).alias("over_limit"), ((F.col("file_count") > warn_files) | (F.col("total_bytes") > warn_bytes)).alias("large"))


def check_guard(totals: DataFrame, force: bool = False, **limits) -> None:
    row = scan_guard(totals, **limits).first()
    if row.over_limit and not force:
        raise ValueError(f"scan of {row.file_count} files, {row.total_bytes} bytes is over the limits; use force")


def record_json(row_columns: dict):
    """Canonical JSON of a record: keys in order."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in sorted(row_columns.items())]))


def input_hash(files: DataFrame) -> DataFrame:
    """One row: input_hash, snapshot_id over the canonical records in path order.

    The hash is of one string by definition, which a file index's size bounds; the records are made in parallel."""
    record = record_json({"bytes": F.col("bytes"), "isBinary": F.col("is_binary"), "lang": F.col("lang"), "path": F.col("path"), "sha256": F.col("sha256")})
    rows = files.agg(F.sort_array(F.collect_list(F.struct("path", record.alias("r")))).alias("a"))
    text = F.concat(F.lit("["), F.array_join(F.transform("a", lambda x: x["r"]), ","), F.lit("]"))
    return rows.select(F.sha2(text, 256).alias("input_hash")).withColumn("snapshot_id", F.substring("input_hash", 1, SNAPSHOT_CHARS))


def run_id(input_hash, iso, legacy: bool = False, *more):
    """The first 12 (legacy: 16) digits of the hash of the parts joined by a pipe."""
    return F.substring(F.sha2(F.concat_ws("|", input_hash, iso, *more), 256), 1, 16 if legacy else 12)


def input_signature(root, input_hash):
    return F.sha2(record_json({"inputHash": input_hash, "repoRoot": root}), 256)


def output_hash(artifacts: DataFrame) -> DataFrame:
    """One row: hash of `path\\ncontent\\n` of all artifacts (path, content) in path order."""
    rows = artifacts.agg(F.sort_array(F.collect_list(F.struct("path", "content"))).alias("a"))
    return rows.select(F.sha2(F.array_join(F.transform("a", lambda x: F.concat(x["path"], F.lit("\n"), x["content"], F.lit("\n"))), ""), 256).alias("output_hash"))


def manifest(files: DataFrame) -> DataFrame:
    """path_rel, sha256, nth in the order of a locale."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.orderBy(F.collate("path", "UNICODE"))) - 1
    return files.select(F.col("path").alias("path_rel"), "sha256", order.alias("nth"))


def manifest_diff(before: DataFrame, after: DataFrame, changed: bool = True) -> DataFrame:
    """path, change between two manifests (path, sha256); without changed: added and removed only."""
    from lithoscope.operators.diff import file_delta

    out = file_delta(before, after)
    return out if changed else out.filter("change <> 'changed'")


def number_text(x: float | int) -> str:
    """A number as JavaScript prints it."""
    if isinstance(x, int):
        return str(x)
    if not math.isfinite(x):
        return "null"
    if x == int(x) and abs(x) < 1e21:
        return str(int(x))
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    digits = "".join(map(str, digits)).rstrip("0") or "0"
    point = len(Decimal(repr(x)).as_tuple().digits) + exponent  # places before the decimal point
    head = "-" if sign else ""
    if -6 < point <= 0:
        return f"{head}0.{'0' * -point}{digits}"
    if 0 < point <= 21:
        return f"{head}{digits[:point]}.{digits[point:]}" if len(digits) > point else head + digits + "0" * (point - len(digits))
    e = point - 1
    return f"{head}{digits[0]}{'.' + digits[1:] if digits[1:] else ''}e{'+' if e > 0 else ''}{e}"


def canonical_json(value) -> str:
    """JSON with sorted keys, arrays as they are, null fields left out, numbers as in JavaScript."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical_json(v)}" for k, v in sorted(value.items()) if v is not None) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(canonical_json(v) for v in value) + "]"
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return json.dumps(value, ensure_ascii=False)
    return number_text(value)


def write_atomic(folder: str, relative: str, value) -> str:
    """Canonical JSON (or text) under folder, by a temporary name and a rename; paths that leave the folder are refused."""
    root = Path(folder).resolve()
    target = (root / relative).resolve()
    if not target.is_relative_to(root):
        raise ValueError(f"{relative} leaves {folder}")
    target.parent.mkdir(parents=True, exist_ok=True)
    beside = target.with_name(target.name + ".tmp")
    beside.write_text(value if isinstance(value, str) else canonical_json(value), encoding="utf-8")
    beside.replace(target)
    return str(target)


def append_ledger(folder: str, entry: dict) -> None:
    """One canonical line more in ledger.jsonl."""
    missing = {"runId", "atIso", "command", "repoRoot", "inputHash", "outputHash", "artifacts"} - entry.keys()
    if missing:
        raise ValueError(f"ledger entry lacks {sorted(missing)}")
    path = Path(folder) / "ledger.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as f:
        f.write(canonical_json({"notes": [], **entry}) + "\n")


def latest_ledger(folder: str) -> dict | None:
    path = Path(folder) / "ledger.jsonl"
    lines = [x for x in path.read_text(encoding="utf-8").splitlines() if x.strip()] if path.exists() else []
    return json.loads(lines[-1]) if lines else None


def folder_output_hash(folder: str, artifacts: list[str]) -> str:
    digest = hashlib.sha256()
    for relative in sorted(artifacts):
        digest.update(f"{relative}\n{(Path(folder) / relative).read_text(encoding='utf-8')}\n".encode())
    return digest.hexdigest()


def verify(folder: str, validators: dict | None = None, clock: str = "1970-01-01T00:00:00.000Z") -> dict:
    """Hash and schemas of the last ledger entry's artifacts; written as last_verification.json."""
    from lithoscope.schemas import problems

    entry = latest_ledger(folder)
    if entry is None:
        raise ValueError("ledger is empty")
    found = all((Path(folder) / a).exists() for a in entry["artifacts"])
    match = found and folder_output_hash(folder, entry["artifacts"]) == entry["outputHash"]
    valid = found and not any(problems(a, json.loads((Path(folder) / a).read_text(encoding="utf-8"))) for a in entry["artifacts"] if a.endswith(".json"))
    out = {"schemaVersion": "1.0", "verifiedAtIso": clock, "hashMatch": match, "schemaValid": valid}
    write_atomic(folder, "last_verification.json", out)
    return out


def clock(fixed: str | None = None) -> str:
    """A given instant, else the epoch; never the present."""
    if fixed is None:
        return "1970-01-01T00:00:00.000Z"
    datetime.datetime.fromisoformat(fixed.replace("Z", "+00:00"))
    return fixed


def snapshot_contracts(folder: str, sources: str | Path, at: str | None = None) -> dict:
    """Hashes of every artifact's schema and of the sources of a folder (sorted, joined by line breaks), written under folder."""
    from lithoscope.schemas import ARTIFACTS, VERSION

    texts = [p.read_text(encoding="utf-8") for p in sorted(Path(sources).glob("*.py"))]
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    out = {"versions": {"schema": VERSION}, "timestamp": clock(at), "schemaHashes": {k: digest(v) for k, v in ARTIFACTS.items()}, "cliSourceHash": digest("\n".join(texts))}
    write_atomic(folder, "contracts_snapshot.json", out)
    return out
