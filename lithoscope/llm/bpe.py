"""BPE encoding as a streaming transducer with bounded lookahead, and decoding by an incremental state machine.

A merge of two symbols stands unless a merge of higher rank takes its right symbol first, which itself stands unless
a merge of still higher rank takes that one's right symbol, and so on. The longest such chain, computed from the merge
list, bounds how far to the right of a token's end its choice can depend: the sufficient lookahead. The transducer holds
a window of the input, emits the tokens that end at least that far before the window's end, and drops them; its memory
is a constant. What is left of a text after whole tokens is encoded as if it stood alone, so nothing is carried but
the window.

Texts fall into pre-tokens by the tokenizer's own rules (special tokens; NFC, white space, lower case; pattern; byte
symbols; end-of-word suffix). Each worker remembers the ids of words it has met, up to CACHE.

Cases: null counts as empty; an empty text has no ids. Other columns play no part. Any length of text or pre-token.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.llm import tokenizers_files
from lithoscope.llm.common import text_of

TOKENIZER = "word_bpe_49k.json"
CACHE = 300_000
#: White space as the pattern's engine has it: Unicode's White_Space. Fixed values.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Controls that Python's split() takes for white space though Unicode doesn't. Fixed values.
SEPARATORS = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character of each byte: itself if printable in Latin-1, else the next code point from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b if b in own else next(others)) for b in range(256)]


def lookahead(merges: Iterable[tuple[str, str]], length=len) -> int:
    """How many symbols after a token's end its choice can depend on at most."""
    reach: dict[str, int] = {}  # from a merged symbol's start to the last symbol its making depends on
    taken: dict[str, int] = {}  # the same for the merges so far that take a symbol as their left part
    most = 0
    for left, right in merges:
        a, b = length(left), length(right)
        need = max(reach.get(left, a), a + max(reach.get(right, b), taken.get(right, 0)))
        whole = left + right
        reach[whole] = max(reach.get(whole, 0), need)
        taken[left] = max(taken.get(left, 0), need)
        most = max(most, need - a - b)
    return most + 1


class Transducer:
    """Feeds on symbols, emits token ids once they are stable."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.ranks = {m: k for k, m in enumerate(merges)}
        self.cut = len(suffix)
        self.ahead = lookahead(merges, self.size)
        self.window = 4 * self.ahead + 64

    def size(self, token: str) -> int:
        """In symbols: an end-of-word suffix belongs to its symbol."""
        return len(token) - self.cut if self.cut and token.endswith(self.suffix) and len(token) > self.cut else len(token)

    def merged(self, parts: list[str]) -> list[str]:
        """The merge list applied to the symbols: lowest rank first, from left to right."""
        ranks, none = self.ranks, 1 << 30
        while len(parts) > 1:
            pairs = [ranks.get(p, none) for p in zip(parts, parts[1:])]
            low = min(pairs)
            if low == none:
                break
            out, i, n = [], 0, len(pairs)
            while i <= n:
                if i < n and pairs[i] == low:
                    out.append(parts[i] + parts[i + 1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def stream(self, symbols: Iterator[str]) -> Iterator[str]:
        """Tokens of one pre-token's symbols, each as soon as it is stable."""
        held: list[str] = []
        for symbol in symbols:
            held.append(symbol)
            if len(held) >= self.window:
                at = 0
                for token in self.merged(held):
                    if at + self.size(token) > len(held) - self.ahead:
                        break
                    at += self.size(token)
                    yield token
                held = held[at:]
        yield from self.merged(held)


class Encoder:
    """Texts to ids by a tokenizers file: the pre-tokens' rules, then the transducer."""

    def __init__(self, tokenizer: str = TOKENIZER):
        with open(tokenizers_files.path_of(tokenizer), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.transducer = Transducer(self.vocab, merges, self.suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pattern = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.blank = regex.compile(f"[{SPACE}]+")
        self.symbols = byte_symbols()
        self.words: dict[str, bytes] = {}
        self.tokens: dict[str, bytes] = {}

    def stream(self, pretoken: str) -> Iterator[int]:
        """Ids of one pre-token, read byte by byte."""
        data = pretoken.encode()
        last = len(data) - 1
        symbols = (self.symbols[b] + self.suffix if i == last else self.symbols[b] for i, b in enumerate(data))
        for token in self.transducer.stream(symbols):
            if token in self.vocab:
                yield self.vocab[token]

    def word(self, word: str) -> bytes:
        """Ids of what stands between white space; pre-tokens don't cross that, nor does composition."""
        plain = unicodedata.normalize("NFC", word).replace("Σ", "σ").lower()  # lower case without context
        out = []
        for pretoken in self.pattern.findall(plain):
            got = self.tokens.get(pretoken)
            if got is None:
                got = array("I", self.stream(pretoken)).tobytes()
                if len(pretoken) < 100:
                    self.tokens[pretoken] = got
            out.append(got)
        ids = b"".join(out)
        if len(word) < 100:
            self.words[word] = ids
        return ids

    def plain(self, text: str) -> bytes:
        words = self.blank.split(text) if any(c in text for c in SEPARATORS) else text.split()
        known, word = self.words, self.word
        return b"".join([known.get(w) or word(w) for w in words])

    def __call__(self, text: str) -> bytes:
        """Ids, four little-endian bytes each."""
        if len(self.words) > CACHE:
            self.words.clear()
        if len(self.tokens) > CACHE:
            self.tokens.clear()
        if "<|" not in text:
            return self.plain(text)
        return b"".join(array("I", [self.special[p]]).tobytes() if p in self.special else self.plain(p) for p in self.parts.split(text))


class Decoder:
    """Ids to text, one after the other.

    As the library's decode without a decoder rule: the tokens' own strings, joined by a space. With as_text: the
    bytes behind the symbols, an end of word as a space, and UTF-8 decoded as it completes (errors as U+FFFD).
    """

    def __init__(self, encoder: Encoder, as_text: bool = False):
        self.strings = {i: t for t, i in (*encoder.vocab.items(), *encoder.special.items())}
        self.as_text, self.suffix = as_text, encoder.suffix
        self.bytes_of = {s: b for b, s in enumerate(encoder.symbols)}
        self.reset()

    def reset(self) -> None:
        import codecs

        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.started = False

    def feed(self, ids: Iterable[int]) -> str:
        """The text that these ids complete."""
        strings = [s for i in ids if (s := self.strings.get(i)) is not None]
        if not strings:
            return ""
        if not self.as_text:
            out = (" " if self.started else "") + " ".join(strings)
            self.started = True
            return out
        data = bytearray()
        for s in strings:
            end = bool(self.suffix) and s.endswith(self.suffix)
            data += bytes(self.bytes_of[c] for c in (s[: -len(self.suffix)] if end else s) if c in self.bytes_of)
            data += b" " * end
        return self.utf8.decode(bytes(data))

    def finish(self) -> str:
        out = self.utf8.decode(b"", True)
        self.reset()
        return out


CODECS: dict[str, tuple[Encoder, Decoder]] = {}
BLOCK = 4 * 65_536


def codec(tokenizer: str) -> tuple[Encoder, Decoder]:
    if tokenizer not in CODECS:
        encoder = Encoder(tokenizer)
        CODECS[tokenizer] = (encoder, Decoder(encoder))
    return CODECS[tokenizer]


def encode_documents(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array) of every text."""

    def run(batches):
        import pyarrow as pa

        encoder, _ = codec(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [array("I", encoder(t)).tolist() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, tokenizer: str = TOKENIZER, as_text: bool = True) -> DataFrame:
    """doc_id and text of every row's ids (null: empty)."""

    def run(batches):
        import pyarrow as pa

        encoder, _ = codec(tokenizer)
        decoder = Decoder(encoder, as_text)
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                texts.append(decoder.feed(ids or ()) + decoder.finish())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str = TOKENIZER, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: every text encoded, and its ids decoded block by block."""

    def run(batches):
        import pyarrow as pa

        encoder, decoder = codec(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder(text.as_py())
                digest = hashlib.sha256()
                for at in range(0, len(ids), BLOCK):
                    digest.update(decoder.feed(array("I", ids[at : at + BLOCK])).encode())
                digest.update(decoder.finish().encode())
                rows.append((doc_id, len(ids) // 4, hashlib.sha256(ids).hexdigest(), digest.hexdigest()))
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
