"""Where tokenizer files are, and tokenizers loaded once per Python worker."""

from __future__ import annotations

import base64
import functools
import os


def path_of(name: str) -> str:
    """A public tokenizer's file by name; a path to an existing file stays as it is."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def hf(name: str):
    """A tokenizer of the tokenizers library, single-threaded, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path_of(name))
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


@functools.lru_cache(maxsize=2)
def pieces(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path_of(name))


@functools.lru_cache(maxsize=2)
def ranked(name: str):
    """A tiktoken encoding with the same vocabulary as a byte-level BPE file."""
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path_of(name), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
