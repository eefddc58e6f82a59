"""A public byte-level BPE tokenizer, from a vocabulary file of ranks whose path is a parameter."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the public vocabulary files lie; every function takes another place as a parameter.
FOLDER = os.environ.get("COWRIE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tokenizer of a vocabulary file, once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, path: str | None = None) -> Column:
    """Tokens of a text, zero for null and empty."""
    path = path or f"{FOLDER}/{VOCABULARY}"

    @F.pandas_udf(T.IntegerType())
    def count(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = encoder(path)
        for texts in parts:
            yield pd.Series([len(one.encode_ordinary(t)) if t else 0 for t in texts], index=texts.index, dtype="int32")

    return count(text)
