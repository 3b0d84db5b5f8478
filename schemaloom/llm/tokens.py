"""Sizes in tokens of a public byte-pair tokenizer.

Only counts are needed, and words repeat.  A blank before a non-blank always
starts a new pre-token of the byte-level pattern, so a text is cut there and the
count of every piece is looked up; pieces that are not known yet are encoded.
The sum equals the length of the encoding of the whole text.

Defined results: NULL and empty texts have no tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where the vocabulary lies; never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-token pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that one Python worker remembers before it starts afresh.
REMEMBERED = 400_000

_CUT = re.compile(r" (?=\S)")


@lru_cache(maxsize=4)
def encoder(vocabulary: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(word): int(rank) for word, rank in map(bytes.split, f)}
    return tiktoken.Encoding("counted", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def counter(vocabulary: str = VOCABULARY) -> Callable[[str], int]:
    """A function that counts the tokens of a text."""
    encode = encoder(vocabulary).encode_ordinary

    class Counts(dict):
        def __missing__(self, piece: str) -> int:
            n = len(encode(" " + piece))
            if len(piece) <= 64:
                if len(self) >= REMEMBERED:
                    self.clear()
                self[piece] = n
            return n

    known = Counts().__getitem__

    def count(text: str | None) -> int:
        if not text:
            return 0
        head, *rest = _CUT.split(text)
        return (len(encode(head)) if head else 0) + sum(map(known, rest))

    return count


def token_count(text: str | Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of tokens as bigint."""

    @F.pandas_udf(T.LongType())
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(list(map(counter(vocabulary), texts)), dtype="int64")

    return counted(text)
