"""Queries over documents as a file listing: scan, hashes, similarity, snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from lithoscope.functions.text import is_hidden, is_ignored
from lithoscope.operators import diff, integrity, rules, similarity
from lithoscope.sources.tables import LISTING_SQL, listing, scanned, table

Q: dict = {}
O: dict = {}


def query(sql: str | None = None, prefix: str = f"WITH {LISTING_SQL}"):
    """Registers a query under its function's name, with its oracle after the common prefix."""

    def keep(f):
        Q[f.__name__] = f
        if sql:
            O[f.__name__] = f"{prefix} {sql}"
        return f

    return keep


@query("SELECT path, bytes, sha256, lang, is_binary FROM scanned")
def scan_files(spark, d):
    return scanned(spark, d).select("path", "bytes", "sha256", "lang", "is_binary")


@query("SELECT path, regexp_matches(path, '(^|/)(node_modules|dist)(/|$)') OR path LIKE '%.tmp' AS ignored, regexp_matches(path, '(^|/)\\.') AS hidden FROM listing")
def ignore_filter(spark, d):
    return listing(spark, d).select("path", is_ignored("path").alias("ignored"), is_hidden("path").alias("hidden"))


@query("SELECT lang, count(*) AS n FROM typed GROUP BY lang")
def lang_classify(spark, d):
    return listing(spark, d).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT path, is_binary FROM typed")
def binary_classify(spark, d):
    return listing(spark, d).select("path", "is_binary")


@query("SELECT path, sha256(text) AS sha256 FROM typed")
def content_hash(spark, d):
    return integrity.content_hash(listing(spark, d).withColumn("content", F.encode("text", "UTF-8")))


@query("SELECT count(*) AS file_count, sum(bytes)::BIGINT AS total_bytes FROM scanned")
def scan_totals(spark, d):
    return integrity.scan_totals(scanned(spark, d))


@query("SELECT count(*) AS file_count, sum(bytes)::BIGINT AS total_bytes, count(*) > 50000 OR sum(bytes) > 2147483648 AS over_limit, count(*) > 10000 OR sum(bytes) > 52428800 AS large FROM scanned")
def scan_guard(spark, d):
    return integrity.scan_guard(integrity.scan_totals(scanned(spark, d)))


HASH_SQL = """sha256('[' || string_agg('{"bytes":' || bytes || ',"isBinary":' || is_binary || ',"lang":"' || lang || '","path":"' || path || '","sha256":"' || sha256 || '"}', ',' ORDER BY path) || ']')"""


@query(f"SELECT {HASH_SQL} AS input_hash FROM scanned")
def input_hash(spark, d):
    return integrity.input_hash(scanned(spark, d)).select("input_hash")


@query(f"SELECT substr({HASH_SQL}, 1, 12) AS snapshot_id FROM scanned")
def snapshot_id(spark, d):
    return integrity.input_hash(scanned(spark, d)).select("snapshot_id")


@query(f"SELECT substr(sha256(h || '|' || '2000-01-01T00:00:00.000Z'), 1, 12) AS run_id, substr(sha256(h || '|' || '2000-01-01T00:00:00.000Z' || '|scan'), 1, 16) AS legacy_run_id FROM (SELECT {HASH_SQL} AS h FROM scanned)")
def run_id(spark, d):
    h = integrity.input_hash(scanned(spark, d))
    iso = F.lit("2000-01-01T00:00:00.000Z")
    return h.select(integrity.run_id(F.col("input_hash"), iso).alias("run_id"), integrity.run_id(F.col("input_hash"), iso, True, F.lit("scan")).alias("legacy_run_id"))


@query(f"""SELECT sha256('{{"inputHash":"' || h || '","repoRoot":"/repo"}}') AS signature FROM (SELECT {HASH_SQL} AS h FROM scanned)""")
def input_signature(spark, d):
    return integrity.input_hash(scanned(spark, d)).select(integrity.input_signature(F.lit("/repo"), F.col("input_hash")).alias("signature"))


@query("SELECT path, '{\"bytes\":' || bytes || ',\"isBinary\":' || is_binary || ',\"lang\":\"' || lang || '\",\"path\":\"' || path || '\"}' AS json FROM scanned")
def stable_json(spark, d):
    return scanned(spark, d).select("path", integrity.record_json({"path": F.col("path"), "lang": F.col("lang"), "isBinary": F.col("is_binary"), "bytes": F.col("bytes")}).alias("json"))


@query("SELECT sha256(string_agg(path || chr(10) || text || chr(10), '' ORDER BY path)) AS output_hash FROM scanned")
def output_hash(spark, d):
    return integrity.output_hash(scanned(spark, d).select("path", F.col("text").alias("content")))


@query()
def write_manifest(spark, d):
    """In the order of a locale, which is checked in tests."""
    return integrity.manifest(scanned(spark, d))


@query("SELECT bool_or(regexp_matches(path, '\\.test\\.(ts|js)$') AND NOT regexp_matches(path, '(^|/)(node_modules|\\.git|dist|storage)/')) AS tree, bool_or(path LIKE 'tests/%' OR regexp_matches(path, '^((src|test|spec)/)?[^/]*\\.test\\.(ts|js)$')) AS shallow, bool_or(contains(path, 'test') OR contains(path, 'spec')) AS by_index FROM listing")
def has_tests(spark, d):
    files = listing(spark, d)
    out = rules.has_tests(files).select(F.col("has_tests").alias("tree"))
    for mode, name in (("shallow", "shallow"), ("index", "by_index")):
        out = out.crossJoin(rules.has_tests(files, mode).select(F.col("has_tests").alias(name)))
    return out


SIMHASH_SQL = """,
tokens AS (SELECT path, sha256(t) AS h, count(*) AS n FROM (SELECT path, unnest(regexp_split_to_array(text, '\\s+')) AS t FROM source) WHERE t <> '' GROUP BY ALL),
halves AS (SELECT path, n, ('0x' || substr(h, 1, 8))::UBIGINT AS hi, ('0x' || substr(h, 9, 8))::UBIGINT AS lo FROM tokens),
bits AS (SELECT path, i, sum(n * (2 * ((hi >> i) & 1)::INT - 1)) > 0 AS hi, sum(n * (2 * ((lo >> i) & 1)::INT - 1)) > 0 AS lo FROM halves, range(32) AS r(i) GROUP BY ALL),
words AS (SELECT path, sum(CASE WHEN hi THEN (1::BIGINT << i) ELSE 0 END)::UBIGINT AS hi, sum(CASE WHEN lo THEN (1::BIGINT << i) ELSE 0 END)::UBIGINT AS lo FROM bits GROUP BY path),
hashes AS (SELECT path, coalesce(lpad(lower(printf('%x', hi)), 8, '0') || lpad(lower(printf('%x', lo)), 8, '0'), repeat('0', 16)) AS simhash, coalesce(hi, 0) AS hi, coalesce(lo, 0) AS lo FROM source LEFT JOIN words USING (path))
"""


@query("SELECT path, simhash FROM hashes", f"WITH {LISTING_SQL}, source AS (SELECT path, text FROM listing) {SIMHASH_SQL}")
def simhash64(spark, d):
    return similarity.simhash64(listing(spark, d))


@query("SELECT a.path AS path_a, b.path AS path_b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS distance FROM hashes a JOIN hashes b ON split_part(b.path, 'doc_', 2)[1:2] = split_part(a.path, 'doc_', 2)[1:2] AND a.path < b.path", f"WITH {LISTING_SQL}, source AS (SELECT path, text FROM listing) {SIMHASH_SQL}")
def hamming(spark, d):
    h = similarity.simhash64(listing(spark, d)).withColumn("k", F.substring(F.split("path", "doc_")[1], 1, 2))
    other = h.select("k", F.col("path").alias("path_b"), F.col("simhash").alias("simhash_b"))
    return h.join(other, "k").filter("path < path_b").select(F.col("path").alias("path_a"), "path_b", similarity.hamming(F.col("simhash"), F.col("simhash_b")).alias("distance"))


@query("SELECT a.path AS path_a, b.path AS path_b, a.simhash AS simhash_a, b.simhash AS simhash_b, bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) AS hamming FROM hashes a JOIN hashes b ON a.path < b.path AND bit_count(xor(a.hi, b.hi)) + bit_count(xor(a.lo, b.lo)) <= 3", f"WITH {LISTING_SQL}, source AS (SELECT path, text FROM typed WHERE NOT is_binary AND lang IN ('ts', 'js', 'jsx', 'tsx', 'json', 'md', 'txt', 'css', 'html')) {SIMHASH_SQL}")
def duplicates_pairs(spark, d):
    texts = listing(spark, d).filter(~F.col("is_binary") & F.col("lang").isin(*similarity.TEXT_LANGS))
    return similarity.duplicate_pairs(similarity.simhash64(texts))


#: Two snapshots of the documents: one without every tenth, one without the next tenth and with changed sevenths.
SNAPSHOTS_SQL = """WITH before AS (SELECT source || '/doc_' || doc_id AS path, sha256(text) AS sha256 FROM documents WHERE doc_id % 10 <> 0),
after AS (SELECT source || '/doc_' || doc_id AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' changed' ELSE text END) AS sha256 FROM documents WHERE doc_id % 10 <> 1),
both_ AS (SELECT coalesce(b.path, a.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'removed' WHEN a.sha256 <> b.sha256 THEN 'changed' END AS change FROM before b FULL JOIN after a ON a.path = b.path)
"""


def snapshots(spark, d):
    docs = table(spark, d, "documents").withColumn("path", F.concat("source", F.lit("/doc_"), F.col("doc_id").cast("string")))
    changed = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    return docs.filter("doc_id % 10 <> 0").select("path", F.sha2("text", 256).alias("sha256")), docs.filter("doc_id % 10 <> 1").select("path", F.sha2(changed, 256).alias("sha256"))


@query("SELECT path, change FROM both_ WHERE change IS NOT NULL", SNAPSHOTS_SQL)
def file_delta(spark, d):
    return diff.file_delta(*snapshots(spark, d))


@query("SELECT path FROM both_ WHERE change = 'added'", SNAPSHOTS_SQL)
def diff_added(spark, d):
    before, after = snapshots(spark, d)
    return diff.set_except(after, before)


@query("SELECT path FROM both_ WHERE change = 'removed'", SNAPSHOTS_SQL)
def diff_removed(spark, d):
    before, after = snapshots(spark, d)
    return diff.set_except(before, after)


Q["set_except"], O["set_except"] = diff_added, O["diff_added"]


@query("SELECT path FROM both_ WHERE change = 'changed'", SNAPSHOTS_SQL)
def changed_files(spark, d):
    return diff.file_delta(*snapshots(spark, d)).filter("change = 'changed'").select("path")


@query("SELECT path, change FROM both_ WHERE change IS NOT NULL", SNAPSHOTS_SQL)
def manifest_diff3(spark, d):
    return integrity.manifest_diff(*snapshots(spark, d))


@query("SELECT path, change FROM both_ WHERE change IN ('added', 'removed')", SNAPSHOTS_SQL)
def manifest_diff2(spark, d):
    return integrity.manifest_diff(*snapshots(spark, d), changed=False)


@query("SELECT string_agg(CASE WHEN change = 'added' THEN path END, ',' ORDER BY path) AS added, string_agg(CASE WHEN change = 'removed' THEN path END, ',' ORDER BY path) AS removed, 0 AS edge_delta, 0 AS risk_delta FROM both_", SNAPSHOTS_SQL)
def diff_report(spark, d):
    return diff.diff_report(*snapshots(spark, d)).select(F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"), "edge_delta", "risk_delta")


@query("SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS href FROM pages", "")
def extract_links(spark, d):
    """Regex extraction with explode, as for imports, on real pages."""
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("href"))


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 1", "")
def latest_ledger(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", "event_type").orderBy(F.desc("event_id")).limit(1)


@query("SELECT source, sha256(string_agg(sha256, '' ORDER BY path)) AS ledger_hash, sha256(string_agg(text, chr(10) ORDER BY path)) AS cli_source_hash FROM (SELECT *, split_part(path, '/', 1) AS source FROM scanned) GROUP BY source")
def concatenation_hashes(spark, d):
    """Hashes of concatenated artifacts and of sources joined by line breaks, for each folder."""
    rows = scanned(spark, d).groupBy(F.split("path", "/")[0].alias("source")).agg(F.sort_array(F.collect_list(F.struct("path", "sha256", "text"))).alias("a"))
    join = lambda field, by: F.sha2(F.array_join(F.transform("a", lambda x: x[field]), by), 256)
    return rows.select("source", join("sha256", "").alias("ledger_hash"), join("text", "\n").alias("cli_source_hash"))
