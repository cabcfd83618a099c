"""Queries over a rendered source tree: extraction, resolution, topology, rules, essence, exports."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import functions as F

from lithoscope.functions.text import is_test_path
from lithoscope.operators import diff, essence as essences, export, extract, graph, resolve, rules, score, topology
from lithoscope.sources.tables import rendered, rendered_sql

Q: dict = {}
O: dict = {}
TARGET = "src/nation_3.ts"


def query(sql: str | None = None, *more: str):
    """Registers a query, with its oracle after the tree's SQL and the further common tables it names."""

    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = f"WITH RECURSIVE {', '.join([rendered_sql(), *more])} {sql}"
        return f

    return keep


class Tree:
    """The relations of the rendered tree. Those that several others read are kept in memory or on disk; what an executor
    loses is computed again."""

    def __init__(self, spark, d):
        self.files = rendered(spark, d).persist()
        self.scripts = extract.script_files(self.files)
        self.nodes = self.scripts.select(F.col("path").alias("id"))

    @cached_property
    def edges(self):
        return resolve.dep_edges(self.scripts, self.files).persist()

    @cached_property
    def signals(self):
        return extract.runtime_signals(self.scripts).persist()

    @cached_property
    def symbols(self):
        return extract.extract_exports(self.scripts)

    @cached_property
    def topology(self):
        return topology.topology_nodes(self.nodes, self.edges, self.signals).persist()

    @cached_property
    def in_repo(self):
        return topology.edges_in_repo(self.edges, self.nodes)

    @cached_property
    def cycles(self):
        return graph.cycles(self.nodes, self.edges)

    @cached_property
    def gaps(self):
        return rules.gap_rules(self.signals, self.cycles, rules.has_tests(self.files)).persist()

    @cached_property
    def cone(self):
        return graph.neighbours(self.edges, self.nodes, TARGET)

    @cached_property
    def tests(self):
        return self.files.filter(is_test_path("path")).select(F.col("path").alias("id"))


IMPORTS = r"""imports AS (
  SELECT path, 'import' AS kind, unnest(regexp_extract_all(text, '\bimport\s+(?:[^"'']+\s+from\s+)?["'']([^"'']+)["'']', 1)) AS spec FROM scripts
  UNION ALL SELECT path, 'dynamicImport', unnest(regexp_extract_all(text, '\bimport\s*\(\s*["'']([^"'']+)["'']\s*\)', 1)) FROM scripts
  UNION ALL SELECT path, 'require', unnest(regexp_extract_all(text, '\brequire\s*\(\s*["'']([^"'']+)["'']\s*\)', 1)) FROM scripts)"""
LOCAL = r"""local_ AS (
  SELECT *, regexp_replace(replace(regexp_replace(spec, '^\./', ''), '../', ''), '\.(ts|js|mjs|cjs)$', '') AS norm FROM imports WHERE spec[1:1] IN ('.', '/')),
bases AS (SELECT path AS target, regexp_replace(path, '\.(ts|js|mjs|cjs)$', '') AS base FROM files),
resolved AS (SELECT norm, min(target) AS target FROM (SELECT DISTINCT norm FROM local_) JOIN bases ON suffix(base, norm) OR suffix(base, norm || '/index') GROUP BY norm),
edges AS (SELECT path AS a, target AS b, kind FROM local_ JOIN resolved USING (norm)),
nodes AS (SELECT path AS id FROM scripts),
inrepo AS (SELECT * FROM edges WHERE a IN (FROM nodes) AND b IN (FROM nodes))"""
PATTERNS = {
    "spawn": r"\bchild_process\.(?:spawn|spawnSync)\b|\bspawn\s*\(",
    "exec": r"\bchild_process\.(?:exec|execSync)\b|\bexec\s*\(",
    "httpServer": r"\bhttp\s*\.\s*createServer\s*\(",
    "httpsServer": r"\bhttps\s*\.\s*createServer\s*\(",
    "setInterval": r"\bsetInterval\s*\(",
    "setTimeout": r"\bsetTimeout\s*\(",
    "chokidarWatch": r"\bchokidar\.watch\s*\(",
    "fsWrite": r"\bfs\.(?:writeFile|writeFileSync|appendFile|appendFileSync|createWriteStream)\b",
    "envMutation": r"(?i)\bprocess\.env\.[A-Z0-9_]+\s*=",
    "netListen": r"\bnet\.createServer\s*\(",
    "bindAllInterfaces": r"""\blisten\s*\([^)]*["'']0\.0\.0\.0["'']""",
}
#: In the rendered texts no line has two hits of one kind, so the lines give the line numbers, and what follows the hit the snippet.
SIGNALS = "tlines AS (SELECT path, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM scripts), signals AS (" + " UNION ALL ".join(f"SELECT path AS file, line, '{k}' AS kind, regexp_extract(l, '((?:{p}).*)$', 1)[1:120] AS snippet FROM tlines WHERE regexp_matches(l, '{p}')" for k, p in PATTERNS.items()) + ")"
KINDS = "kinds AS (SELECT n.id, list_sort(list(DISTINCT kind) FILTER (kind IS NOT NULL)) AS kinds FROM nodes n LEFT JOIN signals ON file = n.id GROUP BY n.id)"
FLAG_CASES = ", ".join(f"CASE WHEN list_has_any(coalesce(kinds, []), [{', '.join(map(repr, k))}]) THEN '{f}' END" for f, k in topology.FLAGS.items())
TOPOLOGY = f"""{KINDS}, topo AS (
  SELECT n.id, list_filter([{FLAG_CASES}], lambda x: x IS NOT NULL) AS flags, (SELECT count(*) FROM inrepo WHERE a = n.id) AS out_degree, (SELECT count(*) FROM inrepo WHERE b = n.id) AS in_degree FROM kinds n),
top_ AS (SELECT *, out_degree / greatest(1, max(out_degree) OVER ()) AS centrality FROM topo)"""
SCC = "fw AS (SELECT id AS s, id AS v FROM nodes UNION SELECT s, b FROM fw JOIN inrepo ON a = v), scc AS (SELECT x.s AS id, min(x.v) AS component FROM fw x JOIN fw y ON x.s = y.v AND x.v = y.s GROUP BY x.s), cyc AS (SELECT component, list_sort(list(id)) AS members FROM scc GROUP BY component HAVING count(*) > 1)"
RULE_ROWS = ", ".join(f"('{r}', '{s}', '{t}', '{k}')" for r, s, t, ks in rules.RULES for k in ks)
GAPS = f"""rule_rows AS (FROM (VALUES {RULE_ROWS}) AS r(gap_id, severity, title, kind)),
gaps AS (
  SELECT gap_id, severity, title, string_agg(file || ':' || line || ':' || snippet, ';' ORDER BY file, line, kind, snippet) AS evidence FROM signals JOIN rule_rows USING (kind) GROUP BY gap_id, severity, title
  UNION ALL SELECT 'cycle-' || replace(array_to_string(members, '-'), '/', '_'), 'medium', '{rules.CYCLE_TITLE}', array_to_string(list_transform(members, lambda m: m || ':-:part of cycle'), ';') FROM cyc)"""
ALL = (IMPORTS, LOCAL, SIGNALS, TOPOLOGY)


def flat(evidence: str = "evidence"):
    """Evidence as one string."""
    one = lambda e: F.concat_ws(":", e["file"], F.coalesce(e["line"].cast("string"), F.lit("-")), e["note"])
    return F.array_join(F.transform(evidence, one), ";")


def joined(*columns: str):
    return [F.array_join(c, ",").alias(c) for c in columns]


@query("SELECT path, lang FROM scripts")
def script_files(spark, d):
    return Tree(spark, d).scripts.select("path", "lang")


@query("SELECT path, kind, spec FROM imports", IMPORTS)
def extract_imports(spark, d):
    return extract.extract_imports(Tree(spark, d).scripts).select("path", "kind", "spec")


@query("SELECT spec, spec[1:1] NOT IN ('.', '/') AS external, count(*) AS n FROM imports GROUP BY ALL", IMPORTS)
def is_external(spark, d):
    specs = extract.extract_imports(Tree(spark, d).scripts)
    return specs.groupBy("spec", extract.is_external(F.col("spec")).alias("external")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT spec, norm FROM local_", IMPORTS, LOCAL)
def normalize_spec(spark, d):
    specs = extract.extract_imports(Tree(spark, d).scripts).filter(~extract.is_external(F.col("spec")))
    return specs.select("spec", extract.normal_spec(F.col("spec")).alias("norm")).distinct()


@query('SELECT norm, target AS "to" FROM resolved', IMPORTS, LOCAL)
def resolve_suffix(spark, d):
    t = Tree(spark, d)
    local = extract.extract_imports(t.scripts).filter(~extract.is_external(F.col("spec")))
    return resolve.resolve_suffix(local.select(extract.normal_spec(F.col("spec")).alias("norm")), t.files)


@query('SELECT a AS "from", b AS "to", kind FROM edges', IMPORTS, LOCAL)
def dep_edges(spark, d):
    return Tree(spark, d).edges.select("from", "to", "kind")


LEGACY = r"""legacy AS (SELECT DISTINCT path, kind, spec FROM (
  SELECT path, 'import' AS kind, unnest(regexp_extract_all(text, 'from\s+["'']([^"'']+)["'']', 1)) AS spec FROM scripts
  UNION ALL SELECT path, 'import', unnest(regexp_extract_all(text, 'import\s+["'']([^"'']+)["'']\s*;?', 1)) FROM scripts
  UNION ALL SELECT path, 'dynamicImport', unnest(regexp_extract_all(text, 'import\s*\(\s*["'']([^"'']+)["'']\s*\)', 1)) FROM scripts
  UNION ALL SELECT path, 'require', unnest(regexp_extract_all(text, 'require\s*\(\s*["'']([^"'']+)["'']\s*\)', 1)) FROM scripts))"""


@query("SELECT path, kind, spec, trim(spec)[1:1] NOT IN ('.', '/') AS is_external FROM legacy", LEGACY)
def extract_imports_legacy(spark, d):
    return extract.extract_imports_legacy(Tree(spark, d).scripts)


@query(r"""SELECT path, name, arg_min(kind, form) AS kind FROM (
  SELECT path, form, kind, unnest(regexp_extract_all(text, 'export\s+' || kind || '\s+(\w+)', 1)) AS name FROM scripts, (VALUES (0, 'function'), (1, 'class'), (2, 'const'), (3, 'type'), (4, 'interface')) AS v(form, kind)
  UNION ALL SELECT path, 5, 'export', regexp_extract(trim(item), '^(\w+)', 1) FROM (SELECT path, unnest(string_split(block, ',')) AS item FROM (SELECT path, unnest(regexp_extract_all(text, 'export\s*\{\s*([^}]+)\}', 1)) AS block FROM scripts)))
  GROUP BY path, name""")
def extract_exports(spark, d):
    return Tree(spark, d).symbols


@query("SELECT path AS name, path AS file, path AS kind, false AS exported FROM files WHERE false")
def symbol_index(spark, d):
    """The live index is empty by definition; extract_exports is the older one."""
    return spark.createDataFrame([], "name string, file string, kind string, exported boolean")


@query(r"""SELECT path AS "from", target AS "to" FROM (
  SELECT l.path, coalesce((SELECT path FROM scripts WHERE path = tgt), (SELECT min(path) FROM scripts WHERE regexp_replace(path, '\.[^.]+$', '') = regexp_replace(tgt, '\.[^.]+$', ''))) AS target FROM (
    SELECT path, CASE WHEN spec LIKE './%' THEN dir || '/' || spec[3:] WHEN spec LIKE '../%' THEN CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') || '/' ELSE '' END || spec[4:] ELSE dir || spec END AS tgt
    FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM legacy) WHERE spec[1:1] IN ('.', '/')) l) WHERE target IS NOT NULL""", LEGACY)
def resolve_legacy(spark, d):
    return resolve.resolve_legacy(Tree(spark, d).scripts)


@query(r"""SELECT path AS "from", spec AS "to", (SELECT path FROM files f JOIN (VALUES (0, ''), (1, '.ts'), (2, '.tsx'), (3, '.js'), (6, '/index.ts')) AS c(n, tail) ON f.path = tgt || tail ORDER BY n LIMIT 1) AS resolved FROM (
    SELECT path, spec, CASE WHEN spec LIKE './%' THEN dir || '/' || spec[3:] WHEN spec LIKE '../%' THEN CASE WHEN contains(dir, '/') THEN regexp_replace(dir, '/[^/]*$', '') || '/' ELSE '' END || spec[4:] ELSE 'src/' || spec END AS tgt
    FROM (SELECT *, regexp_replace(path, '/[^/]*$', '') AS dir FROM legacy))""", LEGACY)
def resolve_probe(spark, d):
    t = Tree(spark, d)
    edges = extract.extract_imports_legacy(t.scripts).select(F.col("path").alias("from"), F.col("spec").alias("to"), "kind")
    return resolve.resolve_probe(edges, t.files, {"*": ["./src/*"]}).select("from", "to", "resolved")


@query("SELECT file, line, kind, snippet FROM signals", SIGNALS)
def runtime_signals(spark, d):
    return Tree(spark, d).signals.select("file", F.col("line").cast("long").alias("line"), "kind", "snippet")


@query("SELECT file, kind, min(line) AS first, max(line) AS last FROM signals GROUP BY ALL", SIGNALS)
def line_number(spark, d):
    return Tree(spark, d).signals.groupBy("file", "kind").agg(F.min("line").cast("long").alias("first"), F.max("line").cast("long").alias("last"))


@query("SELECT snippet, count(*) AS n FROM signals GROUP BY ALL", SIGNALS)
def snippet(spark, d):
    return Tree(spark, d).signals.groupBy("snippet").agg(F.count("*").alias("n"))


@query("SELECT id, coalesce(array_to_string(kinds, ','), '') AS kinds FROM kinds", IMPORTS, LOCAL, SIGNALS, KINDS)
def signals_by_file(spark, d):
    t = Tree(spark, d)
    return topology.signals_by_file(t.nodes, t.signals).select("id", *joined("kinds"))


@query("SELECT id, array_to_string(flags, ',') AS flags FROM top_", *ALL)
def risk_flags(spark, d):
    t = Tree(spark, d)
    by_file = topology.signals_by_file(t.nodes, t.signals)
    return by_file.select("id", topology.risk_flags(F.col("kinds")).alias("flags")).select("id", *joined("flags"))


@query("SELECT id, array_to_string(flags, ',') AS flags, out_degree, in_degree, round(centrality, 6) AS centrality FROM top_", *ALL)
def topology_nodes(spark, d):
    return Tree(spark, d).topology.select("id", *joined("flags"), F.col("out_degree").cast("long").alias("out_degree"), F.col("in_degree").cast("long").alias("in_degree"), F.round("centrality", 6).alias("centrality"))


@query("SELECT 'flow:' || id || ':' || kind AS flow_id, id, kind, array_to_string(flags, ',') AS flags FROM top_ JOIN (VALUES ('net-exposure', 'net'), ('writes', 'write'), ('exec', 'exec')) AS w(flag, kind) ON list_contains(flags, flag)", *ALL)
def flows(spark, d):
    return topology.flows(Tree(spark, d).topology).select("flow_id", "id", "kind", *joined("flags"))


@query("SELECT 'flow-' || (row_number() OVER (ORDER BY id) - 1) AS flow_id, id, CASE WHEN net AND wr THEN 'mixed' WHEN net THEN 'net' ELSE 'write' END AS kind, concat_ws(',', CASE WHEN net THEN 'net-exposure' END, CASE WHEN wr THEN 'writes' END) AS flags FROM (SELECT id, coalesce(list_has_any(kinds, ['httpServer', 'httpsServer', 'netListen', 'bindAllInterfaces']), false) AS net, coalesce(list_contains(kinds, 'fsWrite'), false) AS wr FROM kinds) WHERE net OR wr", IMPORTS, LOCAL, SIGNALS, KINDS)
def flows_legacy(spark, d):
    t = Tree(spark, d)
    return topology.flows_legacy(topology.signals_by_file(t.nodes, t.signals)).select("flow_id", "id", "kind", *joined("flags"))


@query("SELECT kind, count(*) AS n FROM edges GROUP BY kind", IMPORTS, LOCAL)
def edge_kind_hist(spark, d):
    return Tree(spark, d).edges.groupBy("kind").agg(F.count("*").alias("n"))


SYMBOLS = r"""symbols AS (SELECT DISTINCT path, name FROM (
  SELECT path, unnest(regexp_extract_all(text, 'export\s+(?:function|class|const|type|interface)\s+(\w+)', 1)) AS name FROM scripts
  UNION ALL SELECT path, regexp_extract(trim(item), '^(\w+)', 1) FROM (SELECT path, unnest(string_split(block, ',')) AS item FROM (SELECT path, unnest(regexp_extract_all(text, 'export\s*\{\s*([^}]+)\}', 1)) AS block FROM scripts))))"""
RANK = "ranked AS (SELECT id AS path, (SELECT count(*) FROM edges WHERE a = id) AS import_degree, (SELECT count(*) FROM symbols s WHERE s.path = id) AS export_degree, in_degree, out_degree, round(centrality, 6) AS centrality FROM top_)"


def ranked(spark, d):
    t = Tree(spark, d)
    entries = topology.rank_entries(t.nodes, t.edges, t.symbols, t.topology)
    return entries.select("path", *[F.col(c).cast("long").alias(c) for c in ("import_degree", "export_degree", "in_degree", "out_degree")], F.round("centrality", 6).alias("centrality"))


@query("FROM ranked", *ALL, SYMBOLS, RANK)
def rank_join(spark, d):
    return ranked(spark, d)


@query("SELECT path, import_degree, in_degree, out_degree FROM ranked", *ALL, SYMBOLS, RANK)
def rank_degrees(spark, d):
    return ranked(spark, d).select("path", "import_degree", "in_degree", "out_degree")


@query("SELECT path, export_degree FROM ranked", *ALL, SYMBOLS, RANK)
def export_degree(spark, d):
    return ranked(spark, d).select("path", "export_degree")


@query("FROM ranked ORDER BY centrality DESC, in_degree DESC, out_degree DESC, path LIMIT 20", *ALL, SYMBOLS, RANK)
def rank_top(spark, d):
    return topology.rank_top(ranked(spark, d))


@query("SELECT id FROM top_ ORDER BY centrality DESC, id LIMIT 5", *ALL)
def top_central(spark, d):
    return topology.top_by(Tree(spark, d).topology, "centrality", 5).select("id")


@query("SELECT gap_id, severity, title, evidence FROM gaps", *ALL, SCC, GAPS)
def gap_rules(spark, d):
    return Tree(spark, d).gaps.select("gap_id", "severity", "title", flat().alias("evidence"))


LEGACY_ROWS = ", ".join(f"('{p}', '{s}', '{t}', '{k}')" for p, s, t, ks in rules.LEGACY_RULES for k in ks)


@query(f"SELECT prefix || '-' || file || ':' || line AS gap_id, severity, title, file || ':' || line || ':' || snippet AS evidence FROM signals JOIN (VALUES {LEGACY_ROWS}) AS r(prefix, severity, title, kind) USING (kind) UNION ALL SELECT 'gap-cycle-' || replace(array_to_string(members, '-'), '/', '_'), 'medium', '{rules.CYCLE_TITLE}', array_to_string(list_transform(members, lambda m: m || ':-:part of cycle'), ';') FROM cyc", *ALL, SCC)
def gap_rules_legacy(spark, d):
    t = Tree(spark, d)
    return rules.gap_rules_legacy(t.signals, t.cycles, t.files).select("gap_id", "severity", "title", flat().alias("evidence"))


@query("SELECT count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM gaps", *ALL, SCC, GAPS)
def gap_summary(spark, d):
    return rules.gap_summary(Tree(spark, d).gaps)


@query("SELECT row_number() OVER (ORDER BY list_position(['critical', 'high', 'medium', 'low'], severity), title, gap_id) AS nth, gap_id FROM gaps", *ALL, SCC, GAPS)
def gap_order(spark, d):
    from pyspark.sql import Window

    nth = F.row_number().over(Window.orderBy(rules.severity_rank(F.col("severity")), "title", "gap_id"))
    return Tree(spark, d).gaps.select(nth.cast("long").alias("nth"), "gap_id")


@query("""SELECT concat_ws(chr(10), '# Gaps Report', '', '| Severity | Title |', '|----------|-------|', string_agg('| ' || severity || ' | ' || title || ' |', chr(10) ORDER BY o, title, gap_id), '',
  string_agg('## ' || title || ' (' || severity || ')' || chr(10) || chr(10) || body || chr(10), chr(10) ORDER BY o, title, gap_id)) AS text
  FROM (SELECT *, list_position(['critical', 'high', 'medium', 'low'], severity) AS o, replace('- ' || replace(evidence2, chr(1), chr(10) || '- '), ':-:', ' — ') AS body FROM (
    SELECT gap_id, severity, title, '' AS evidence, string_agg(file || ':' || line || ' — ' || snippet, chr(1) ORDER BY file, line, kind, snippet) AS evidence2 FROM signals JOIN rule_rows USING (kind) GROUP BY gap_id, severity, title
    UNION ALL SELECT gap_id, severity, title, '', replace(evidence, ';', chr(1)) FROM gaps WHERE gap_id LIKE 'cycle-%'))""", *ALL, SCC, GAPS)
def gaps_md(spark, d):
    return rules.gaps_markdown(Tree(spark, d).gaps)


@query("SELECT DISTINCT title FROM gaps ORDER BY title LIMIT 10", *ALL, SCC, GAPS)
def key_risks(spark, d):
    return essences.key_risks(Tree(spark, d).gaps)


EVIDENCE = f"proof AS (SELECT * FROM (SELECT file AS path, title || ':' || line AS note FROM signals JOIN rule_rows USING (kind) UNION ALL SELECT unnest(members), '{rules.CYCLE_TITLE}' FROM cyc) ORDER BY path, note LIMIT 30)"


@query("FROM proof", *ALL, SCC, GAPS, EVIDENCE)
def evidence_topk(spark, d):
    return essences.evidence(Tree(spark, d).gaps)


PACK = """pack AS (SELECT 'Repo has ' || (SELECT count(*) FROM nodes) || ' modules and ' || (SELECT count(*) FROM inrepo) || ' edges. ' || (SELECT count(DISTINCT title) FROM gaps) || ' distinct risk categories detected.' AS overview,
  (SELECT string_agg(title, ';' ORDER BY title) FROM (SELECT DISTINCT title FROM gaps ORDER BY title LIMIT 10)) AS key_risks, (SELECT string_agg(id, ';' ORDER BY centrality DESC, id) FROM (SELECT * FROM top_ ORDER BY centrality DESC, id LIMIT 5)) AS top_central)"""


def packed(t):
    return essences.essence(t.topology, score.stability(t.nodes, t.in_repo), t.gaps)


@query("SELECT *, (SELECT string_agg(path || '|' || note, ';' ORDER BY path, note) FROM proof) AS evidence FROM pack", *ALL, SCC, GAPS, EVIDENCE, PACK)
def essence(spark, d):
    proof = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["path"], e["note"])), ";").alias("evidence")
    return packed(Tree(spark, d)).select("overview", F.array_join("key_risks", ";").alias("key_risks"), F.array_join("top_central", ";").alias("top_central"), proof)


@query("SELECT concat_ws(chr(10), '# Essence Pack', '', overview, '', '## Top Central Nodes', '- ' || replace(top_central, ';', chr(10) || '- '), '', '## Key Risks', '- ' || replace(key_risks, ';', chr(10) || '- ')) AS text FROM pack", *ALL, SCC, GAPS, PACK)
def essence_md(spark, d):
    return essences.essence_markdown(packed(Tree(spark, d)))


CONE = f"""d1 AS (SELECT DISTINCT b AS id FROM inrepo WHERE a = '{TARGET}'), r1 AS (SELECT DISTINCT a AS id FROM inrepo WHERE b = '{TARGET}'),
d2 AS (SELECT DISTINCT b AS id FROM inrepo WHERE a IN (FROM d1) AND b <> '{TARGET}' AND b NOT IN (FROM d1)), r2 AS (SELECT DISTINCT a AS id FROM inrepo WHERE b IN (FROM r1) AND a <> '{TARGET}' AND a NOT IN (FROM r1)),
hit AS (SELECT id FROM (FROM r1 UNION FROM r2) WHERE regexp_matches(id, '/tests?/|/spec/|(\\.test|\\.spec)\\.(ts|js|tsx|jsx)$')),
inside AS (FROM d1 UNION FROM r1 UNION FROM d2 UNION SELECT '{TARGET}'),
sizes AS (SELECT (SELECT count(*) FROM d1) + (SELECT count(*) FROM r1) + (SELECT count(*) FROM d2) AS cone, (SELECT count(*) FROM hit) AS tests, (SELECT max(centrality) FROM top_ WHERE id = '{TARGET}') AS centrality)"""


@query("SELECT id FROM hit", *ALL, CONE)
def impacted_tests(spark, d):
    t = Tree(spark, d)
    return t.cone.filter("relation IN ('reverse', 'reverse2')").join(t.tests, "id", "left_semi").select("id").distinct()


@query("SELECT path, name FROM symbols WHERE path IN (SELECT id FROM top_ WHERE id IN (FROM inside) ORDER BY centrality DESC, id LIMIT 5)", *ALL, SYMBOLS, CONE)
def cone_symbols(spark, d):
    t = Tree(spark, d)
    inside = t.cone.filter("relation <> 'reverse2'").select("id").unionAll(spark.createDataFrame([(TARGET,)], "id string"))
    top = topology.top_by(t.topology.join(inside, "id", "left_semi"), "centrality", 5)
    return t.symbols.join(top.select(F.col("id").alias("path")), "path", "left_semi").select("path", "name")


@query("SELECT cone, tests, cone + tests AS radius, round(centrality, 6) AS centrality, floor(least(1, centrality) * 40 + least(1, cone / 50) * 30 + least(1, tests / 20) * 20 + least(1, (cone + tests) / 50) * 10 + 0.5)::BIGINT AS risk FROM sizes", *ALL, CONE)
def risk_score(spark, d):
    t = Tree(spark, d)
    return score.risk_score(t.cone, t.topology, t.tests, TARGET).withColumn("centrality", F.round("centrality", 6))


@query(f"""SELECT 'Focus: {TARGET}. Cone nodes: ' || (SELECT count(*) FROM inside) || ', edges: ' || (SELECT count(*) FROM edges WHERE a IN (FROM inside) AND b IN (FROM inside)) || '. Direct imports: ' || (SELECT count(*) FROM d1) || '. Reverse imports: ' || (SELECT count(*) FROM r1)
  || '. Indirect (depth 2): ' || (SELECT count(*) FROM d2) || '. Impacted tests: ' || (SELECT count(*) FROM hit) || '.' AS overview, (SELECT string_agg(id, ',' ORDER BY centrality DESC, id) FROM foc) AS top_central,
  (SELECT string_agg(path || '|' || note, ';' ORDER BY path, note) FROM (SELECT * FROM (SELECT id AS path, 'test' AS note FROM hit UNION ALL SELECT path, 'symbol:' || name FROM symbols WHERE path IN (SELECT id FROM foc)) ORDER BY path, note LIMIT 10)) AS evidence""", *ALL, SYMBOLS, CONE, "foc AS (SELECT id, centrality FROM top_ WHERE id IN (FROM inside) ORDER BY centrality DESC, id LIMIT 5)")
def focused_essence(spark, d):
    t = Tree(spark, d)
    proof = F.array_join(F.transform("evidence", lambda e: F.concat_ws("|", e["path"], e["note"])), ";").alias("evidence")
    return essences.focused_essence(TARGET, t.cone, t.edges, t.topology, t.symbols, t.tests).select("overview", F.array_join("top_central", ",").alias("top_central"), proof)


@query("""SELECT floor(greatest(0, least(1, st * 0.7 + (1 - least(1, risk / 10)) * 0.3)) * 100 + 0.5) / 100 AS health, greatest(1, ceil(n / 20))::BIGINT AS gateway_nodes, 3::BIGINT AS duplicate_pairs, floor((1 - st) * 100 + 0.5) / 100 AS structural_density FROM (
  SELECT n, greatest(0, least(1, 1 - m / (n * n))) AS st, (SELECT sum(CASE severity WHEN 'high' THEN 0.4 WHEN 'medium' THEN 0.2 ELSE 0.05 END) FROM gaps) AS risk FROM (SELECT (SELECT count(*) FROM nodes)::DOUBLE AS n, (SELECT count(*) FROM inrepo) AS m))""", *ALL, SCC, GAPS)
def health_score(spark, d):
    t = Tree(spark, d)
    n = t.nodes.count()
    return score.health(score.stability(t.nodes, t.in_repo), rules.gap_summary(t.gaps), 3, max(1, -(-n // 20)))


DELTA = "delta AS (SELECT 'src/nation_1.ts' AS path, 'added' AS change UNION ALL SELECT 'src/nation_4.ts', 'removed')"


def changes(spark):
    return spark.createDataFrame([("src/nation_1.ts", "added"), ("src/nation_4.ts", "removed")], "path string, change string")


@query("SELECT change, path || '::' || name AS symbol FROM symbols JOIN delta USING (path)", SYMBOLS, DELTA)
def delta_symbols(spark, d):
    return diff.delta_symbols(Tree(spark, d).symbols, changes(spark))


@query("SELECT a || ' -> ' || b AS shift FROM edges WHERE a IN (SELECT path FROM delta) OR b IN (SELECT path FROM delta WHERE change = 'added')", IMPORTS, LOCAL, DELTA)
def dependency_shifts(spark, d):
    return diff.dependency_shifts(Tree(spark, d).edges, changes(spark))


EXPORTS = {
    "graphml": """SELECT 0 AS section, 0 AS nth, '<?xml version="1.0" encoding="UTF-8"?>' AS line UNION ALL SELECT 0, 1, '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">' UNION ALL SELECT 0, 2, '  <graph id="G" edgedefault="directed">'
      UNION ALL SELECT 1, n, '    <node id="' || id || '"><data key="label">' || id || '</data></node>' FROM nn UNION ALL SELECT 2, n, '    <edge id="e' || n || '" source="' || a || '" target="' || b || '"/>' FROM ee UNION ALL SELECT 3, 0, '  </graph>' UNION ALL SELECT 3, 1, '</graphml>'""",
    "mermaid": """SELECT 0 AS section, 0 AS nth, 'graph LR' AS line UNION ALL SELECT 1, n, '  ' || id || '["' || id || '"]' FROM nn UNION ALL SELECT 2, n, '  ' || a || ' --> ' || b FROM ee""",
    "dot": """SELECT 0 AS section, 0 AS nth, 'digraph topology {' AS line UNION ALL SELECT 1, n, '  "' || id || '" [label="' || id || '"];' FROM nn UNION ALL SELECT 2, n, '  "' || a || '" -> "' || b || '";' FROM ee UNION ALL SELECT 3, 0, '}'""",
}
NUMBERED = "nn AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM nodes), ee AS (SELECT a, b, row_number() OVER (ORDER BY a, b) - 1 AS n FROM inrepo)"


def exported(fmt: str):
    def run(spark, d):
        t = Tree(spark, d)
        return export.FORMATS[fmt](t.nodes, t.in_repo)

    run.__name__ = f"export_{fmt}"
    return query(EXPORTS[fmt], IMPORTS, LOCAL, NUMBERED)(run)


export_graphml, export_mermaid, export_dot = map(exported, EXPORTS)
