"""Risk rules over signals, cycles and tests, their summary and order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules: id, severity, title, kinds. Fixed values.
RULES = (
    ("bind-all-interfaces", "high", "Server binds to 0.0.0.0 without explicit opt-in", ("bindAllInterfaces",)),
    ("exec-without-policy", "high", "Process execution detected without policy gate", ("spawn", "exec")),
    ("writes-without-ledger", "medium", "Writes without ledger pattern", ("fsWrite",)),
    ("net-exposure", "medium", "Net exposure (listen/serve)", ("httpServer", "httpsServer", "netListen", "wsUpgrade")),
)
#: The older rules, one gap for each signal: prefix, severity, title, kinds. Fixed values.
LEGACY_RULES = (
    ("gap-bind", "high", "0.0.0.0 bind without opt-in", ("bindAllInterfaces",)),
    ("gap-net", "medium", "Net exposure (listen/serve)", ("httpServer", "httpsServer", "netListen", "wsUpgrade")),
    ("gap-write", "medium", "Writes without ledger pattern", ("fsWrite",)),
    ("gap-exec", "high", "Exec path without policy gate", ("spawn", "exec")),
)
CYCLE_TITLE, CYCLE_NOTE = "Cyclic dependency (SCC)", "part of cycle"
TESTS_TITLE, TESTS_NOTE = "Modules without tests", "No test folder or *.test.ts / *.spec.ts found"
#: Severities from the gravest on. Fixed values.
SEVERITIES = ("critical", "high", "medium", "low")
EVIDENCE = "array<struct<file:string,line:int,note:string>>"


def kind_rules(rules):
    """A map from kind to its rule, inlined in the plan: no join."""
    pairs = [x for rule in rules for k in rule[3] for x in (F.lit(k), F.struct(*(F.lit(v).alias(n) for n, v in zip(("rule", "severity", "title"), rule))))]
    return F.create_map(*pairs)


def judged(signals: DataFrame, rules) -> DataFrame:
    return signals.withColumn("r", kind_rules(rules)[F.col("kind")]).filter("r IS NOT NULL").select("file", "line", "kind", "snippet", "r.*")


def has_tests(files: DataFrame, mode: str = "tree") -> DataFrame:
    """One row: has_tests. tree: a test file anywhere outside skipped folders; shallow: a tests folder, or a test file directly in
    src, test, spec or the root; index: 'test' or 'spec' in a path."""
    test = F.col("path").rlike(r"\.test\.(ts|js)$")
    if mode == "tree":
        skipped = F.exists(F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(0))), lambda s: s.isin("node_modules", ".git", "dist", "storage"))
        hit = test & ~skipped
    elif mode == "shallow":
        hit = F.col("path").startswith("tests/") | F.col("path").rlike(r"^((src|test|spec)/)?[^/]*\.test\.(ts|js)$")
    else:
        hit = F.col("path").contains("test") | F.col("path").contains("spec")
    return files.agg(F.coalesce(F.max(hit), F.lit(False)).alias("has_tests"))


def cycle_gaps(cycles: DataFrame, prefix: str = "cycle-") -> DataFrame:
    name = F.concat(F.lit(prefix), F.replace(F.array_join("members", "-"), F.lit("/"), F.lit("_")))
    evidence = F.transform("members", lambda m: F.struct(m.alias("file"), F.lit(None).cast("int").alias("line"), F.lit(CYCLE_NOTE).alias("note")))
    return cycles.select(name.alias("gap_id"), F.lit("medium").alias("severity"), F.lit(CYCLE_TITLE).alias("title"), evidence.cast(EVIDENCE).alias("evidence"))


def test_gap(missing: DataFrame, gap_id: str) -> DataFrame:
    """missing: one row (has_tests); a gap if that is false."""
    evidence = F.array(F.struct(F.lit("repo").alias("file"), F.lit(None).cast("int").alias("line"), F.lit(TESTS_NOTE).alias("note")))
    return missing.filter("NOT has_tests").select(F.lit(gap_id).alias("gap_id"), F.lit("low").alias("severity"), F.lit(TESTS_TITLE).alias("title"), evidence.cast(EVIDENCE).alias("evidence"))


def gap_rules(signals: DataFrame, cycles: DataFrame, tests: DataFrame) -> DataFrame:
    """gap_id, severity, title, evidence: one gap for each rule that fires, with all its signals in order."""
    fired = judged(signals, RULES).groupBy("rule", "severity", "title").agg(F.sort_array(F.collect_list(F.struct("file", "line", "kind", "snippet"))).alias("e"))
    evidence = F.transform("e", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["snippet"].alias("note")))
    fired = fired.select(F.col("rule").alias("gap_id"), "severity", "title", evidence.cast(EVIDENCE).alias("evidence"))
    return fired.unionAll(cycle_gaps(cycles)).unionAll(test_gap(tests, "modules-without-tests"))


def legacy_tests(files: DataFrame) -> DataFrame:
    """One row: has_tests is false only if there are sources under src/ and nothing that names a test."""
    source = F.col("path").rlike(r"^src/.*\.(ts|js)$")
    named = F.col("path").contains("test") | F.col("path").contains("spec")
    return files.agg((~F.coalesce(F.max(source), F.lit(False)) | F.coalesce(F.max(named), F.lit(False))).alias("has_tests"))


def gap_rules_legacy(signals: DataFrame, cycles: DataFrame, files: DataFrame) -> DataFrame:
    """The same columns: one gap for each signal."""
    each = judged(signals, LEGACY_RULES)
    evidence = F.array(F.struct("file", "line", F.col("snippet").alias("note")))
    fired = each.select(F.concat("rule", F.lit("-"), "file", F.lit(":"), "line").alias("gap_id"), "severity", "title", evidence.cast(EVIDENCE).alias("evidence"))
    return fired.unionAll(cycle_gaps(cycles, "gap-cycle-")).unionAll(test_gap(legacy_tests(files), "gap-no-tests"))


def severity_rank(severity):
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), severity)


def gap_summary(gaps: DataFrame) -> DataFrame:
    """One row: gaps by severity."""
    return gaps.agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def gap_order(gaps: DataFrame) -> DataFrame:
    """The gravest first, then by title; ties by id."""
    return gaps.orderBy(severity_rank(F.col("severity")), "title", "gap_id")


def gaps_markdown(gaps: DataFrame) -> DataFrame:
    """One row: text of the report. A report has a bounded number of gaps but for cycles; it is one file by nature."""
    mention = lambda e: F.concat(F.lit("- "), e["file"], F.coalesce(F.concat(F.lit(":"), e["line"].cast("string")), F.lit("")), F.lit(" — "), e["note"])
    ordered = F.sort_array(F.collect_list(F.struct(severity_rank(F.col("severity")).alias("rank"), "title", "gap_id", "severity", "evidence")))
    rows = gaps.agg(ordered.alias("g"))
    table = F.transform("g", lambda g: F.concat(F.lit("| "), g["severity"], F.lit(" | "), g["title"], F.lit(" |")))
    parts = F.flatten(F.transform("g", lambda g: F.concat(F.array(F.concat(F.lit("## "), g["title"], F.lit(" ("), g["severity"], F.lit(")")), F.lit("")), F.transform(g["evidence"], mention), F.array(F.lit("")))))
    head = F.array(*map(F.lit, ("# Gaps Report", "", "| Severity | Title |", "|----------|-------|")))
    return rows.select(F.array_join(F.concat(head, table, F.array(F.lit("")), parts), "\n").alias("text"))
