"""The driver's tables as engine relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithoscope.functions.text import is_binary, is_hidden, is_ignored, language

#: Folders and extensions that documents get by their ids.
FOLDERS = ("src", "lib", "node_modules/a", ".hidden", "tests", "docs", "dist")
EXTENSIONS = (".ts", ".js", ".mjs", ".cjs", ".json", ".md", ".yml", ".yaml", ".tsx", ".PNG", ".txt", ".tmp", ".test.ts")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a file listing: path, text, bytes, lang, is_binary."""
    pick = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("doc_id") % len(values)).cast("int"))
    path = F.concat(pick(FOLDERS), F.lit("/"), "source", F.lit("/doc_"), F.col("doc_id").cast("string"), pick(EXTENSIONS))
    d = table(spark, sf_dir, "documents").select(path.alias("path"), "text", "doc_id")
    return d.select("path", "text", "doc_id", F.octet_length("text").cast("long").alias("bytes"), language("path").alias("lang"), is_binary("path").alias("is_binary"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listing without hidden and ignored paths, with sha256."""
    return listing(spark, sf_dir).filter(~is_hidden("path") & ~is_ignored("path")).withColumn("sha256", F.sha2("text", 256))


LISTING_SQL = f"""
listing AS (
  SELECT ({list(FOLDERS)!r})[1 + doc_id % {len(FOLDERS)}] || '/' || source || '/doc_' || doc_id || ({list(EXTENSIONS)!r})[1 + doc_id % {len(EXTENSIONS)}] AS path,
         text, doc_id, octet_length(encode(text)) AS bytes FROM documents),
typed AS (
  SELECT *, CASE regexp_replace(path, '^.*\\.', '.') WHEN '.ts' THEN 'ts' WHEN '.js' THEN 'js' WHEN '.mjs' THEN 'js' WHEN '.cjs' THEN 'js' WHEN '.json' THEN 'json'
         WHEN '.md' THEN 'md' WHEN '.yml' THEN 'yml' WHEN '.yaml' THEN 'yaml' ELSE 'unknown' END AS lang, lower(path) LIKE '%.png' AS is_binary FROM listing),
scanned AS (
  SELECT *, sha256(text) AS sha256 FROM typed
  WHERE NOT regexp_matches(path, '(^|/)\\.') AND NOT regexp_matches(path, '(^|/)(node_modules|dist)(/|$)') AND path NOT LIKE '%.tmp')
"""


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: each nation's strongest supplier nations, 1 + src % 7 of them."""
    t = lambda n: table(spark, sf_dir, n)
    sold = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    weights = sold.groupBy(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")).agg(F.count("*").alias("w")).filter("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("w"), "dst"))
    return weights.withColumn("r", rank).filter("r <= 1 + src % 7").select("src", "dst")


TRADE_SQL = """
weights AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, count(*) AS w
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey),
trade AS (SELECT src, dst FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS r FROM weights) WHERE r <= 1 + src % 7)
"""

#: Lines of a nation's file: (condition, line), `{k}` being its key.
LINES = (
    ("true", 'import fs from "fs";'),
    ("k % 4 = 0", "fs.writeFileSync('o');"),
    ("k % 5 = 0", "  setTimeout(f, 1);"),
    ("k % 6 = 0", "http.createServer(f); https . createServer(f);"),
    ("k % 7 = 0", "child_process.exec(c);"),
    ("k % 14 = 0", "re.exec(s);"),
    ("k % 9 = 0", "process.env.A_{k} = 1;"),
    ("k % 11 = 0", "s.listen(80, '0.0.0.0');"),
    ("k % 10 = 1", "chokidar.watch('x'); spawn(y);"),
    ("k = 2", 'import z from "./7";'),
    ("true", "export function f{k}() {{}}"),
    ("k % 3 = 0", "export class C{k} {{}}"),
    ("true", "export const c{k} = 1;"),
    ("k % 2 = 0", "export {{ a{k} as b, f{k}, d{k} }};"),
    ("k % 8 = 5", "import {{ x }} from 'react';"),
)
#: Files beside the nations': for suffixes without boundary, data and index files.
MORE = {"src/17.ts": "export const s = 17;", "src/7.ts": "export const s = 7;", "src/data.json": "{}", "src/lib/index.ts": 'import "../data.json"; import "./index";', "tests/a.spec.ts": 'import { x } from "../src/nation_3";\nimport b from "./helper/b.test";', "src/tests/b.test.ts": 'const n = require("../nation_4.ts"); import("../lib")'}


def import_line(dst: str) -> str:
    """SQL (of both dialects) for the line that imports nation dst: static, required or dynamic."""
    return f"""CASE {dst} % 3 WHEN 0 THEN concat('import {{ x }} from "./nation_', {dst}, '.js";') WHEN 1 THEN concat('const y = require("./nation_', {dst}, '");') ELSE concat('await import("../src/nation_', {dst}, '.ts");') END"""


def own_lines(key: str) -> list[str]:
    return [f"CASE WHEN {c.replace('k', key)} THEN {concatenated(line, key)} END" for c, line in LINES]


def concatenated(line: str, key: str) -> str:
    parts = line.replace("{{", "\x01").replace("}}", "\x02").split("{k}")
    quoted = ["'" + p.replace("\x01", "{").replace("\x02", "}").replace("'", "''") + "'" for p in parts]
    return "concat(" + f", {key}, ".join(quoted) + ")"


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source tree of one file for each nation, and a few more: path, text, bytes, lang, is_binary, sha256."""
    quotes = lambda sql: sql.replace("''", "\\'")  # noqa: E731  Spark's string literals escape by a backslash
    lines = [F.expr(quotes(x)) for x in own_lines("n_nationkey")]
    imports = trade_edges(spark, sf_dir).groupBy(F.col("src").alias("n_nationkey")).agg(F.sort_array(F.collect_list(F.expr(import_line("dst")))).alias("imports"))
    nations = table(spark, sf_dir, "nation").join(imports, "n_nationkey", "left")
    body = F.array_join(F.concat(F.coalesce("imports", F.array().cast("array<string>")), F.array_compact(F.array(*lines))), "\n")
    files = nations.select(F.format_string("src/nation_%d.ts", "n_nationkey").alias("path"), body.alias("text"))
    files = files.unionAll(spark.createDataFrame(list(MORE.items()), "path string, text string"))
    return files.withColumns({"bytes": F.octet_length("text").cast("long"), "lang": language("path"), "is_binary": is_binary("path"), "sha256": F.sha2("text", 256)})


def rendered_sql() -> str:
    lines = ", ".join(own_lines("n_nationkey"))
    more = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in kv) + ")" for kv in MORE.items())
    return f"""{TRADE_SQL},
imports0 AS (SELECT src, list(line ORDER BY line) AS imports FROM (SELECT src, {import_line("dst")} AS line FROM trade) GROUP BY src),
files AS (
  SELECT path, text, octet_length(encode(text)) AS bytes, sha256(text) AS sha256, CASE WHEN path LIKE '%.ts' THEN 'ts' ELSE 'json' END AS lang, false AS is_binary FROM (
    SELECT 'src/nation_' || n_nationkey || '.ts' AS path, array_to_string(list_concat(coalesce(imports, []), list_filter([{lines}], lambda x: x IS NOT NULL)), chr(10)) AS text
    FROM nation LEFT JOIN imports0 ON src = n_nationkey
    UNION ALL SELECT * FROM (VALUES {more.replace(chr(10), "' || chr(10) || '")}) AS v(path, text))),
scripts AS (SELECT * FROM files WHERE lang = 'ts')
"""


def graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The trade graph as nodes (id) and edges (from, to)."""
    name = lambda c: F.format_string("n%02d", c)
    nodes = table(spark, sf_dir, "nation").select(name("n_nationkey").alias("id"))
    return nodes, trade_edges(spark, sf_dir).select(name("src").alias("from"), name("dst").alias("to"))


GRAPH_SQL = f"""{TRADE_SQL},
nodes AS (SELECT 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS id FROM nation),
edges AS (SELECT 'n' || lpad(src::VARCHAR, 2, '0') AS a, 'n' || lpad(dst::VARCHAR, 2, '0') AS b FROM trade)
"""
