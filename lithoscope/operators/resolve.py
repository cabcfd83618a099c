"""From import specifiers to files: by suffix, by relative path, and by candidates with path mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.functions.text import dirname, normal_path, without_extension
from lithoscope.operators.extract import extract_imports, extract_imports_legacy, is_external, normal_spec

#: Suffix lengths of the join keys: a specifier joins on the longest that fits into it.
GRAINS = (3, 8, 16, 32)
#: What the probing resolver appends to a path, in order. Fixed values.
CANDIDATES = ("", ".ts", ".tsx", ".js", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.mjs", "/index.cjs")


def resolve_suffix(norms: DataFrame, files: DataFrame) -> DataFrame:
    """distinct norm -> norm and the first path, in order, whose stem ends with it or with it and /index.

    There is no boundary at path segments, so the keys are character suffixes: an equi-join on the last characters,
    verified by the whole suffix. Specifiers shorter than the shortest key are so few distinct ones (and every path may
    fit them) that they are compared with all paths, after a distinct.
    """
    stems = files.select("path", without_extension("path").alias("stem"))
    stems = stems.unionAll(stems.filter(F.col("stem").endswith("/index")).select("path", F.expr("left(stem, char_length(stem) - 6)").alias("stem")))
    size = F.char_length("norm")
    grain = F.lit(None).cast("int")
    for g in GRAINS:
        grain = F.when(size >= g, g).otherwise(grain)
    keyed = norms.distinct().withColumn("grain", grain)
    long = keyed.filter("grain IS NOT NULL").withColumn("key", F.expr("right(norm, grain)"))
    grains = F.filter(F.array(*map(F.lit, GRAINS)), lambda g: g <= F.char_length("stem"))
    ends = stems.select("path", "stem", F.explode(grains).alias("grain")).withColumn("key", F.expr("right(stem, grain)"))
    found = long.join(ends, ["grain", "key"]).filter(F.expr("endswith(stem, norm)")).groupBy("norm").agg(F.min("path").alias("to"))
    short = keyed.filter("grain IS NULL").select("norm").join(stems, F.expr("endswith(stem, norm)")).groupBy("norm").agg(F.min("path").alias("to"))
    return found.unionAll(short)


def dep_edges(scripts: DataFrame, files: DataFrame) -> DataFrame:
    """from, to, kind, is_external of every resolved local import; a multigraph."""
    local = extract_imports(scripts).filter(~is_external(F.col("spec"))).withColumn("norm", normal_spec(F.col("spec")))
    targets = resolve_suffix(local.select("norm"), files)
    return local.join(targets, "norm").select(F.col("path").alias("from"), "to", "kind", F.lit(False).alias("is_external"))


def resolve_legacy(scripts: DataFrame) -> DataFrame:
    """from, to of the older resolver: relative path, exact, else equal but for the extension."""
    nodes = scripts.select("path")
    specs = extract_imports_legacy(scripts).filter("NOT is_external").filter(F.col("spec").startswith(".") | F.col("spec").startswith("/"))
    joined = specs.withColumn("target", normal_path(F.concat_ws("/", dirname("path"), F.col("spec")))).withColumn("stem", F.regexp_replace("target", r"\.[^.]+$", ""))
    stems = nodes.select(F.regexp_replace("path", r"\.[^.]+$", "").alias("stem"), F.col("path").alias("near")).groupBy("stem").agg(F.min("near").alias("near"))
    exact = nodes.select(F.col("path").alias("exact"))
    hit = joined.join(exact, joined.target == exact.exact, "left").join(stems, "stem", "left").withColumn("to", F.coalesce("exact", "near"))
    return hit.filter("to IS NOT NULL").select(F.col("path").alias("from"), "to")


def resolve_probe(edges: DataFrame, files: DataFrame, mappings: dict[str, list[str]] | None = None) -> DataFrame:
    """edges (from, to as written) -> with resolved (null: external): relative or mapped paths, tried with extensions."""
    relative = normal_path(F.concat_ws("/", dirname("from"), F.col("to")))
    targets = F.when(F.col("to").startswith("node:"), F.array().cast("array<string>")).when(F.col("to").startswith("."), F.array(relative))
    for spec, mapped in (mappings or {}).items():
        if spec != "*":
            targets = targets.when(F.col("to") == spec, F.array(*[F.lit(m.removeprefix("./")) for m in mapped]))
    if "*" in (mappings or {}):
        targets = targets.otherwise(F.array(*[F.regexp_replace(F.replace(F.lit(m), F.lit("*"), F.col("to")), r"^\./", "") for m in mappings["*"]]))
    distinct = edges.select("from", "to").distinct()
    tried = distinct.select("from", "to", F.posexplode(targets).alias("t", "target")).select("from", "to", "t", "target", F.posexplode(F.array(*map(F.lit, CANDIDATES))).alias("c", "tail"))
    hits = tried.withColumn("path", F.concat("target", "tail")).join(files.select("path"), "path").groupBy("from", "to").agg(F.min(F.struct("t", "c", "path")).alias("best"))
    return edges.join(hits, ["from", "to"], "left").select(*edges.columns, F.col("best.path").alias("resolved"))
