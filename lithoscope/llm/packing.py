"""Best-two-fit packing of tokenised documents into sequences of at most `capacity` tokens.

A document's ids end with a separator. A document above the capacity is cut from its end into full pieces, so that
only its first piece may be shorter. Pieces are dealt by hash into shards of about SHARD pieces, and each shard is
packed by itself: a bin is filled greedily with the largest unpacked piece that fits; then its smallest piece gives way
to two unpacked pieces if they fill the expanded gap more tightly, until no exchange helps. A shard leaves less than one
bin of waste beyond a pool's own, so sharding costs about one bin in thousands.

Cases: null counts as empty; an empty document is its separator alone. Repeated rows are packed each. Ties between equal
lengths go by (doc_id, piece). Other columns play no part. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lithoscope.llm import tokenizers_files
from lithoscope.llm.common import Table, small, text_of

CAPACITY = 1024
SHARD = 8192
MOST_PARTITIONS = 20_000
TOKENIZER = "byte_bpe_50k.json"
SAME_RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
END = 2
#: Bytes of words and ids that a worker keeps, with ENTRY for the objects of each; longer words than WORD aren't kept.
CACHE, ENTRY, WORD = 32_000_000, 200, 64
#: Rows of a batch that are worked on at once.
AT_ONCE = 512
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids as the tokenizers library gives them, four little-endian bytes each.

    Where every white-space run is one space or one line break, a text falls into words that are encoded
    independently; each worker keeps the words it has met, up to CACHE bytes. Other texts go to the library whole.
    """

    def __init__(self, tokenizer: str = TOKENIZER, ranks: str = SAME_RANKS):
        self.tokenizer = tokenizer
        self.ranked = tokenizers_files.ranked(ranks)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def word(self, word: str) -> bytes:
        """A word's ids: with the space before it, or with the line break it starts with."""
        got = array("I", self.ranked.encode_ordinary(word if word[0] == "\n" else " " + word)).tobytes()
        if len(word) <= WORD:
            self.held += ENTRY + 4 * len(word) + len(got)
            if self.held > CACHE:
                self.known.clear()
                self.held = 0
            self.known[word] = got
        return got

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        words = text.split()
        if SPECIAL in text or words != text.replace("\n", " ").split(" "):
            return array("I", tokenizers_files.hf(self.tokenizer).encode(text, add_special_tokens=False).ids).tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        known, word = self.known, self.word
        return array("I", self.ranked.encode_ordinary(first)).tobytes() + b"".join([known.get(w) or word(w) for w in rest])


ENCODERS: dict[tuple, Encoder] = {}


def tokenised_pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, ranks: str = SAME_RANKS, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""

    def cut(batches):
        import pyarrow as pa

        encode = ENCODERS.setdefault((tokenizer, ranks), Encoder(tokenizer, ranks))
        last = array("I", [end]).tobytes()
        for batch in small(batches, AT_ONCE):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encode(text.as_py()) + last
                n = len(ids) // 4
                stops = range(n % capacity or capacity, n + 1, capacity) if n > capacity else (n,)
                start = 0
                for k, stop in enumerate(stops):
                    rows.append((doc_id, k, start, stop - start, zlib.crc32(ids[4 * start : 4 * stop])))
                    start = stop
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(cut, PIECES)


def best_two_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indices into lengths; each bin's lengths sum to at most capacity, and every length is at most that.

    The set of unpacked lengths is the bits of an integer, so that the largest length up to a gap, and a pair with
    a given sum, are a few operations on it.
    """
    waiting: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: (lengths[i], -i)):
        waiting.setdefault(lengths[i], []).append(i)
    here = sum(1 << n for n in waiting)
    mirrored = sum(1 << (capacity - n) for n in waiting)

    def take(n: int) -> int:
        nonlocal here, mirrored
        i = waiting[n].pop()
        if not waiting[n]:
            here ^= 1 << n
            mirrored ^= 1 << (capacity - n)
        return i

    def give(n: int, i: int) -> None:
        nonlocal here, mirrored
        waiting[n].append(i)
        here |= 1 << n
        mirrored |= 1 << (capacity - n)

    def largest(gap: int) -> int:
        return (here & ((1 << (gap + 1)) - 1)).bit_length() - 1

    def pair(gap: int, above: int) -> tuple[int, int] | None:
        """Two unpacked lengths with the largest sum up to gap and over above."""
        for total in range(gap, above, -1):
            both = here & (mirrored >> (capacity - total)) & ((1 << total) - 1) & ~1
            while both:
                a = both.bit_length() - 1
                if a != total - a or len(waiting[a]) > 1:
                    return a, total - a
                both ^= 1 << a
        return None

    bins = []
    while here:
        gap, held = capacity, []
        while gap and (n := largest(gap)) > 0:
            held.append((n, take(n)))
            gap -= n
        while gap:
            small = min(held)
            if not (two := pair(gap + small[0], small[0])):
                break
            held.remove(small)
            held += [(n, take(n)) for n in two]
            give(*small)
            gap += small[0] - sum(two)
        bins.append([i for _, i in held])
    return bins


def pack(pieces: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """The pieces (doc_id, piece, length, and what else they carry) with sequence_id and offset."""
    schema = StructType([*pieces.schema.fields, *(StructField(n, LongType()) for n in ("shard", "sequence_id", "offset"))])
    shards = max(1, -(-pieces.count() // shard))
    partitions = min(shards, MOST_PARTITIONS)  # several shards to one beyond that; each is a group of its own

    def one(group):
        import pyarrow as pa

        group = group.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        lengths, number = group["length"].to_pylist(), group["shard"][0].as_py()
        sequence, offset = [0] * len(lengths), [0] * len(lengths)
        for k, held in enumerate(best_two_fit(lengths, capacity)):
            at = 0
            for i in held:
                sequence[i], offset[i] = (number << 32) + k, at
                at += lengths[i]
        return group.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    # All columns: the different texts of one doc_id spread over the shards.
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(*pieces.columns), F.lit(shards)))
    return dealt.repartition(partitions, "shard").groupBy("shard").applyInArrow(one, schema).drop("shard")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, **tokenising) -> DataFrame:
    """docs tokenised, cut and packed: one row per piece. The pieces are written once in the shared folder."""
    return pack(Table(tokenised_pieces(docs, capacity, **tokenising), "pieces").df, capacity, shard)
