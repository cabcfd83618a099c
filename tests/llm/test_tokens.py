import zlib
from array import array

import pytest

from lithoscope.llm import packing, token_counts, tokenizers_files

TEXTS = ["", None, " ", "a", "  two  spaces ", "line\nbreak\n", "\n\nx\n\n\ny", "tab\tand\r\nreturn", "▁ marker a▁b", "<|endoftext|> in<|endoftext|>side", "<s> </s>", "é é   x y", "Ça va? OUI!! 12345 don't", "日本語 テキスト", "😀 a😀b", "\x00 nul", "word " * 4000, "x" * 5000, "a b\nc d"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, 1, "z") for i, t in enumerate(TEXTS)] + [(3, "a", 1, "z"), (3, "a", 1, "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, piece int, length string").repartition(3)


def test_token_counts_equal_the_library(docs):
    sp = tokenizers_files.pieces(token_counts.MODEL)
    got = {r.doc_id: r for r in token_counts.token_counts(docs).collect()}
    for i, t in enumerate(TEXTS):
        assert got[i].n_tokens == len(sp.encode(t or "")), (i, t)
        assert got[i].n_bytes == len((t or "").encode())
        assert got[i].over_limit == (got[i].n_tokens > 4096)


def test_token_counts_of_no_rows(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_encoder_equals_the_library():
    hf, encode = tokenizers_files.hf(packing.TOKENIZER), packing.Encoder()
    for t in TEXTS[2:]:
        assert list(array("I", encode(t))) == hf.encode(t, add_special_tokens=False).ids, t


def test_packing_is_whole_and_tight(docs):
    hf = tokenizers_files.hf(packing.TOKENIZER)
    got = packing.best_fit_packing(docs).toPandas()
    for i, t in enumerate(TEXTS):
        if i == 3:
            continue
        ids = [*hf.encode(t or "", add_special_tokens=False).ids, 2]
        rows = got[got.doc_id == i].sort_values("piece")
        at = 0
        for k, r in enumerate(rows.itertuples()):
            assert (r.piece, r.start) == (k, at) and 0 < r.length <= 1024 and (k == 0 or r.length == 1024)
            assert r.ids_crc32 == zlib.crc32(array("I", ids[at : at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    assert (got.doc_id == 3).sum() == 3
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert bin_.offset.tolist() == [0, *bin_.length.cumsum().tolist()[:-1]] and bin_.length.sum() <= 1024
    assert got.sequence_id.nunique() == -(-got.length.sum() // 1024)


def test_best_two_fit_against_first_fit_decreasing():
    import random

    rng = random.Random(5)
    for n, high in ((0, 9), (1, 64), (40, 30), (300, 64), (300, 20)):
        lengths = [rng.randint(1, high) for _ in range(n)]
        bins = packing.best_two_fit(lengths, 64)
        assert sorted(i for b in bins for i in b) == list(range(n))
        assert all(sum(lengths[i] for i in b) <= 64 for b in bins)
        gaps = []
        for x in sorted(lengths, reverse=True):
            k = next((k for k, g in enumerate(gaps) if g >= x), None)
            if k is None:
                gaps.append(64 - x)
            else:
                gaps[k] -= x
        assert len(bins) <= len(gaps) + 1


def test_packing_of_no_rows(spark):
    assert packing.best_fit_packing(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_dedup(spark):
    from lithoscope.llm.exact_dedup import exact_dedup

    rows = [(5, "a b"), (2, "ab"), (9, "a  b"), (4, "a\tb\n "), (7, None), (1, ""), (3, " \n"), (8, "ab c"), (6, " ab"), (10, "x" * 200 + "y"), (11, "x" * 200 + "z"), (12, "q"), (12, "q")]
    docs = spark.createDataFrame([(i, t, 0, "k") for i, t in rows], "doc_id long, text string, size int, text_sha256 string")
    got = exact_dedup(docs).toPandas()
    plain = [(i, "".join(c for c in (t or "") if c not in " \t\n\x0b\x0c\r"), len(t or "")) for i, t in rows]
    for i, p, _ in plain:
        same = [x for x in plain if x[1] == p]
        r = got[got.doc_id == i].iloc[0]
        assert (r.keep_id, r.group_size) == (min(same, key=lambda x: (-x[2], x[0]))[0], len(same)), i
    assert got.kept.sum() == len({p for _, p, _ in plain})
    assert exact_dedup(docs.limit(0)).count() == 0
