import math

from lithoscope.llm import quality as Q


def test_all_trusted_documents_count(spark):
    """20,500 trusted ids, given twice, all make the target."""
    docs = spark.range(20_600).selectExpr("id AS doc_id", "CASE WHEN id < 20500 THEN concat('t', id % 50) ELSE 'junk' END AS text")
    trusted = spark.range(20_500).selectExpr("id AS doc_id")
    llr = {r.bucket: r.llr for r in Q.ratios(docs, trusted.unionAll(trusted)).collect()}
    for word, aim, raw in (("t1", 410, 410), ("junk", 0, 100)):
        bucket = spark.sql(f"SELECT CAST(pmod(xxhash64('{word}'), {Q.BUCKETS}) AS INT) AS b").first().b
        assert abs(llr[bucket] - math.log((aim + Q.SMOOTHING) / (raw * 20_500 / 20_600 + Q.SMOOTHING))) < 1e-9


def test_flags_are_exact_whatever_the_bitmap(spark):
    """Full, nearly full and sparse bitmaps; null and repeated ids; clashing names."""
    ids = [None, *range(300), 7, 7]
    docs = spark.createDataFrame([(i, f"t{i}", 1, 2) for i in ids], "doc_id long, text string, part int, bit int")
    chosen = spark.range(0, 300, 3).selectExpr("id AS doc_id")
    want = sorted((f"t{i}", 1 if i is not None and i % 3 == 0 else None) for i in ids if i != 7) + [("t7", None)] * 3
    for marks in (1, 64, Q.MARKS):
        got = [(r.text, r.target) for r in Q.flagged(docs, chosen, marks).collect()]
        assert sorted(got, key=str) == sorted(want, key=str), marks
    assert {r.target for r in Q.flagged(docs, chosen.limit(0)).collect()} == {None}
