import hashlib
import random
import unicodedata
from array import array

import pytest

from lithoscope.llm import bpe, tokenizers_files

TEXTS = ["", None, " ", "a", "Hello, World! 123", "a\x1cb \x85c", "ΑΣ ΣΑΣ", "İstanbul ǅ", "don't WE'LL 's'", "éé ́", "<|startoftext|>a<|endoftext|>", "<| half", "½ Ⅷ ²", "日本 😀", "ab" * 4000, "é" * 3000, "!" * 3000, "hello" * 900 + "!?" * 900, "x y " * 3000]


@pytest.fixture(scope="module")
def codec():
    encoder = bpe.Encoder()
    return encoder, bpe.Decoder(encoder), tokenizers_files.hf(bpe.TOKENIZER)


def test_equals_the_library(codec):
    encode, decoder, hf = codec
    rng = random.Random(2)
    assigned = [chr(c) for c in range(160, 0x3000) if unicodedata.category(chr(c)) != "Cn"]
    more = ["".join(rng.choice("abcdefgh") for _ in range(3000)), "".join(rng.choice([chr(rng.randrange(32, 127)), rng.choice(assigned), " "]) for _ in range(3000))]
    for t in [t or "" for t in TEXTS] + more:
        ids = list(array("I", encode(t)))
        assert ids == hf.encode(t, add_special_tokens=False).ids, t[:40]
        assert decoder.feed(ids) + decoder.finish() == hf.decode(ids, skip_special_tokens=False)


def test_streams_with_constant_memory(codec):
    """Emission starts long before the end, and any window gives the same tokens."""
    t = codec[0].transducer
    rng = random.Random(3)
    for _ in range(20):
        symbols = [rng.choice("aehinorst") for _ in range(rng.randint(1, 3000))]
        symbols[-1] += "</w>"
        assert list(t.stream(iter(symbols))) == t.merged(symbols)
    taken = 0

    def endless():
        nonlocal taken
        for _ in range(10**6):
            taken += 1
            yield "a"

    next(t.stream(endless()))
    assert taken <= t.window


def test_lookahead_of_small_lists():
    assert bpe.lookahead([("a", "b")]) == 1
    assert bpe.lookahead([("b", "c"), ("a", "b")]) == 2  # abc: whether ab merges depends on c
    assert bpe.lookahead([("c", "d"), ("b", "c"), ("a", "b")]) == 3


def test_incremental_text(codec):
    encode, _, _ = codec
    decoder = bpe.Decoder(encode, as_text=True)
    ids = list(array("I", encode("héllo wörld 日本!")))
    whole = decoder.feed(ids) + decoder.finish()
    assert "".join(decoder.feed([i]) for i in ids) + decoder.finish() == whole == "héllo wörld 日本 ! "


def test_documents(spark, codec):
    rows = [(i, t, 1, "k") for i, t in enumerate(TEXTS)] + [(3, "a", 1, "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, ids string").repartition(3)
    got = bpe.round_trip_digests(docs).collect()
    assert len(got) == len(rows)
    hf = codec[2]
    for r in got:
        ids = hf.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(hf.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    encoded = bpe.encode_documents(docs.filter("doc_id = 4"))
    assert bpe.decode_documents(encoded).first().text == "hello , world ! 1 2 3 "
    assert bpe.round_trip_digests(docs.limit(0)).count() == 0
