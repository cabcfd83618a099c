import random

import corpus_pipeline
from lithoscope.llm import pii

JUNK = ["buy!! NOW!! $$$", "###", "***", "CLICK!!", "%%%", "FREE!!", "|||"]


def corpus(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"v{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}o" for i in range(500)]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = {i: "\n".join(sentence(30) for _ in range(6)) for i in range(40)}
    docs[40] = docs[7] + " " + sentence(3)  # a near copy, but each line goes as a repeated line first
    docs[41] = docs[8]
    docs[42] = docs[9].split("\n")[0] + "\n" + "\n".join(sentence(30) for _ in range(5))
    docs[43] = sentence(40) + "\n" + sentence(40) + "\nWrite to ann.lee@mail.example.com or call +1 (212) 555-0100."
    docs[44] = "too short"
    docs[45] = None
    docs.update({50 + i: " ".join(rng.choice(JUNK) for _ in range(80)) for i in range(8)})
    rows = [(i, t, "en", "s", len(t or "")) for i, t in docs.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, int(i < 40), 0) for i in [*range(0, 40, 2), *range(50, 58)]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return docs


def test_pipeline(spark, tmp_path):
    docs = corpus(spark, tmp_path)
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.dtypes == frame.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in frame.collect()})
    good, lines, near, clean = kept
    assert set(good) == {*range(44)}
    assert set(lines) == set(good)
    assert lines[41].text == "" and lines[40].text in ("", docs[40].split("\n")[-1]) and "\n".join(docs[42].split("\n")[1:]) == lines[42].text
    assert all(r.n_chars == len(r.text) for r in lines.values())
    assert set(near) == set(lines)  # copies have lost their lines, and texts without words are linked with nothing
    assert "ann.lee@" not in clean[43].text and "555-0100" not in clean[43].text and clean[43].text.startswith(docs[43][:200])
    assert clean[1].text == docs[1]
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert set(pieces.doc_id) == set(near) and pieces.groupby("sequence_id").length.sum().max() <= 1024


def test_surrogates(spark):
    rows = [(1, "a.b@mail.example.com A.B@mail.example.com c@mail.example.com"), (2, "c@mail.example.com 10.1.2.3, 10.1.2.4 4111111111111111 4111-1111-1111-1111"), (3, None), (4, ""), (5, "plain 12"), (6, "Mr. John Smith and Mrs Smith, Mr John")]
    docs = spark.createDataFrame([(i, t, 9, "k") for i, t in rows], "doc_id long, text string, n_entities int, kind string")
    got = {r.doc_id: r for r in pii.replace_pii(docs).collect()}
    assert [got[i].n_entities for i in range(1, 7)] == [3, 5, 0, 0, 0, 3]
    assert got[3].text is None and got[4].text == "" and got[5].text == "plain 12" and got[1].kind == "k"
    a, b, c = got[1].text.split()
    assert a.lower() == b.lower() and a.lower() != c and not {a, c} & {"a.b@mail.example.com", "c@mail.example.com"}
    assert got[2].text.split()[0] == c
    one, two = got[2].text.split()[1:3]
    assert one.rstrip(",") != two and all(0 <= int(x) < 256 for x in two.split("."))
    x, y = got[2].text.split()[3:]
    assert x == y.replace("-", "") and x != "4111111111111111" and sum(d if i % 2 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, x))) % 10 == 0
    first, _, second = got[6].text.replace(",", "").partition(" and ")
    title, given, family = first.split()
    assert title == "Mr." and given in pii.GIVEN["latin", "m"] and second == f"Mrs {family} Mr {second.split()[-1]}"
    assert pii.replace_pii(docs.limit(0)).count() == 0


def test_surrogates_stay_distinct(spark):
    names = spark.range(3000).selectExpr("'given.latin.f' AS kind", "concat('Name', id) AS canon")
    got = pii.surrogates(names).toPandas()
    assert len(got) == 3000 and got.surrogate.nunique() == 3000 and not set(got.surrogate) & set(got.canon)
    again = pii.surrogates(names).toPandas()
    assert dict(zip(got.canon, got.surrogate)) == dict(zip(again.canon, again.surrogate))
