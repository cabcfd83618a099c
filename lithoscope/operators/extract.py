"""Facts from source texts: imports, exports and runtime signals, by regular expressions in the scan itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.functions.text import EDGE, END, SCRIPTS, WS

#: Import forms in the order in which they count. Fixed values.
IMPORTS = {
    "import": rf"""{EDGE}import{WS}+(?:[^"']+{WS}+from{WS}+)?["']([^"']+)["']""",
    "dynamicImport": rf"""{EDGE}import{WS}*\({WS}*["']([^"']+)["']{WS}*\)""",
    "require": rf"""{EDGE}require{WS}*\({WS}*["']([^"']+)["']{WS}*\)""",
}
#: The older extractor's forms: kind and pattern. Fixed values.
LEGACY_IMPORTS = (
    ("import", rf"""from{WS}+["']([^"']+)["']"""),
    ("import", rf"""import{WS}+["']([^"']+)["']{WS}*;?"""),
    ("dynamicImport", rf"""import{WS}*\({WS}*["']([^"']+)["']{WS}*\)"""),
    ("require", rf"""require{WS}*\({WS}*["']([^"']+)["']{WS}*\)"""),
)
#: Declared exports in the order of precedence. Fixed values.
EXPORTS = tuple((kind, rf"export{WS}+{kind}{WS}+([A-Za-z0-9_]+)") for kind in ("function", "class", "const", "type", "interface"))
EXPORT_BLOCK = rf"export{WS}*\{{{WS}*([^}}]+)\}}"
#: Signal kinds and their patterns. Fixed values.
SIGNALS = {
    "spawn": rf"{EDGE}child_process\.(?:spawn|spawnSync){END}|{EDGE}spawn{WS}*\(",
    "exec": rf"{EDGE}child_process\.(?:exec|execSync){END}|{EDGE}exec{WS}*\(",
    "httpServer": rf"{EDGE}http{WS}*\.{WS}*createServer{WS}*\(",
    "httpsServer": rf"{EDGE}https{WS}*\.{WS}*createServer{WS}*\(",
    "setInterval": rf"{EDGE}setInterval{WS}*\(",
    "setTimeout": rf"{EDGE}setTimeout{WS}*\(",
    "chokidarWatch": rf"{EDGE}chokidar\.watch{WS}*\(",
    "fsWrite": rf"{EDGE}fs\.(?:writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream){END}",
    "envMutation": rf"(?i){EDGE}process\.env\.[A-Z0-9_]+{WS}*=",
    "netListen": rf"{EDGE}net\.createServer{WS}*\(",
    "bindAllInterfaces": rf"""{EDGE}listen{WS}*\([^)]*["']0\.0\.0\.0["']""",
}
SNIPPET = 120


def script_files(files: DataFrame) -> DataFrame:
    """Files whose texts are read for facts."""
    return files.filter(~F.col("is_binary") & F.col("lang").isin(*SCRIPTS))


def matches(files: DataFrame, patterns, group: int) -> DataFrame:
    """path, kind, nth, found: all matches of all (kind, pattern), one pass over the files."""
    def found(form: int, kind: str, pattern: str):
        row = lambda m, i: F.struct(F.lit(kind).alias("kind"), F.lit(form).alias("form"), i.alias("nth"), m.alias("found"))
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), group), row)

    arrays = [found(form, kind, pattern) for form, (kind, pattern) in enumerate(patterns)]
    return files.select("path", F.inline(F.concat(*arrays)))


def extract_imports(files: DataFrame) -> DataFrame:
    """path, spec, kind, nth of every import, repeated ones too."""
    return matches(files, IMPORTS.items(), 1).select("path", F.col("found").alias("spec"), "kind", "nth")


def extract_imports_legacy(files: DataFrame) -> DataFrame:
    """path, spec, kind, is_external: once for each file, kind and specifier."""
    found = matches(files, LEGACY_IMPORTS, 1).filter("found <> ''")
    return found.select("path", F.col("found").alias("spec"), "kind").distinct().withColumn("is_external", is_external(F.trim("spec")))


def is_external(spec):
    """Neither relative nor absolute."""
    return ~(spec.startswith(".") | spec.startswith("/"))


def normal_spec(spec):
    """Without one leading ./, any ../, and one script extension."""
    return F.regexp_replace(F.replace(F.regexp_replace(spec, r"^\./", ""), F.lit("../"), F.lit("")), r"\.(ts|js|mjs|cjs)$", "")


def extract_exports(files: DataFrame) -> DataFrame:
    """path, name, kind of exported symbols; of several declarations of a name in a file the first form counts."""
    declared = matches(files, EXPORTS, 1).select("path", "form", F.col("found").alias("name"), "kind")
    blocks = files.select("path", F.explode(F.regexp_extract_all("text", F.lit(EXPORT_BLOCK), 1)).alias("block"))
    items = blocks.select("path", F.explode(F.split("block", ",")).alias("item")).select("path", F.regexp_replace("item", rf"^{WS}+|{WS}+$", "").alias("item"))
    named = items.select("path", F.split("item", f"{WS}+as{WS}+")[0].alias("item"))
    named = named.select("path", F.lit(len(EXPORTS)).alias("form"), F.element_at(F.split("item", f"{WS}+"), -1).alias("name"), F.lit("export").alias("kind")).filter(F.col("name").rlike("^[A-Za-z0-9_]+$"))
    first = declared.unionByName(named).groupBy("path", "name").agg(F.min_by("kind", "form").alias("kind"))
    return first


def hits(kind: str, pattern: str):
    """An array of (kind, line, snippet) of a pattern's hits in text.

    What lies before a hit follows from the lengths of the gaps and hits so far, so no text is searched twice."""
    breaks = lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit("\n"), F.lit("")))
    parts = F.zip_with(F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), 0), lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    start = F.struct(F.lit(1).alias("at"), F.lit(1).alias("line"), F.array().cast("array<struct<at:int,line:int>>").alias("out"))

    def step(a, x):
        at, line = a["at"] + F.char_length(x["gap"]), a["line"] + breaks(x["gap"])
        done = F.when(x["hit"].isNotNull(), F.concat(a["out"], F.array(F.struct(at.alias("at"), line.alias("line"))))).otherwise(a["out"])
        return F.struct((at + F.coalesce(F.char_length(x["hit"]), F.lit(0))).alias("at"), (line + F.coalesce(breaks(x["hit"]), F.lit(0))).alias("line"), done.alias("out"))

    placed = F.aggregate(parts, start, step, lambda a: a["out"])
    snippet = lambda p: F.split(F.substr("text", p["at"], F.lit(SNIPPET)), "\r?\n")[0]
    return F.transform(placed, lambda p: F.struct(F.lit(kind).alias("kind"), p["line"].alias("line"), snippet(p).alias("snippet")))


def runtime_signals(files: DataFrame) -> DataFrame:
    """file, line, kind, snippet of every hit of every kind, in one pass over the files."""
    # A kind whose pattern hits nowhere costs one search; the rest is worked out only where there is a hit.
    none = F.array().cast("array<struct<kind:string,line:int,snippet:string>>")
    arrays = [F.when(F.col("text").rlike(p), hits(k, p)).otherwise(none) for k, p in SIGNALS.items()]
    return files.select(F.col("path").alias("file"), F.inline(F.concat(*arrays))).select("file", "line", "kind", "snippet")
