"""Token counts without ids: each distinct pre-token is counted once, and a text is the sum over its pre-tokens.

A piece of the model never has a space marker after another character, and none holds a line break, so a text falls
into independent pre-tokens: a run of spaces with what follows it, and what follows a line break. Every worker
keeps the counts of the pre-tokens it has met (bounded by CACHE entries), encodes the distinct new ones of a batch, and
joins them with each document's pre-token frequencies. Nothing is shuffled, and no ids are kept.

Cases: null counts as empty; an empty text has 0 tokens. Other columns play no part. Long texts take memory in
proportion to their distinct pre-tokens. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lithoscope.llm import tokenizers_files
from lithoscope.llm.common import text_of

MODEL = "piece_bpe_32k.model"
CACHE = 400_000
RUNS = re.compile(r" +[^ ]*")


def pretokens(text: str) -> tuple[list[str], list[str]]:
    """A text's pre-tokens: words, each after one space or (with their line break) after a line break; runs of spaces."""
    if not text:
        return [], []
    text = text.replace("▁", " ")  # the model's own space marker
    words = text.replace("\n", " \n").split(" ")
    if "" in words:
        return [], RUNS.findall(" " + text)
    return words, []


class Counts:
    """Numbers of pieces by pre-token."""

    def __init__(self, model: str):
        self.sp = tokenizers_files.pieces(model)
        self.known: dict[str, int] = {}
        self.one = len(self.sp.encode("\n")) - 1  # the marker before a line break

    def learn(self, distinct: set[str]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [x for x in distinct if x not in self.known]
        # The library puts one space before each text: that is the first space of a run.
        ids = self.sp.encode([x[1:] if x[0] == " " else x for x in new], num_threads=1)
        for x, got in zip(new, ids):
            self.known[x] = 1 if x == " " else len(got) - self.one if x[0] == "\n" else len(got)  # no text stands for one space

    def of(self, texts: list[str]) -> list[int]:
        split = [pretokens(t) for t in texts]
        self.learn(set().union(*(words or runs for words, runs in split)))
        known = self.known
        return [sum(known[p] * n for p, n in Counter(words or runs).items()) for words, runs in split]


COUNTS: dict[str, Counts] = {}


def token_counts(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every text."""

    def count(batches):
        import pyarrow as pa

        counts = COUNTS.setdefault(model, Counts(model))
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(counts.of(part.column(2).to_pylist()), pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), text_of(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
