"""Token counts: by a public byte-level vocabulary, or by a rule that needs none."""

from __future__ import annotations

import base64
import os
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import regex_tokens

#: The rank file of the vocabulary; every function takes another. Each executor needs it.
VOCABULARY = os.path.join(os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers"), "byte_bpe_50k.tiktoken")
# Fixed value: the published pattern that cuts a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def encoding(path: str):
    """The worker's encoding; strings of special tokens are plain text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def bpe_tokens(text: Column, path: str | None = None) -> Column:
    """Number of tokens by byte-pair encoding. Null and empty texts have none."""
    path = path or VOCABULARY

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        encode = encoding(path).encode_ordinary
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int32")

    return count(text)


#: Counters by name, for settings.
COUNTERS: dict[str, Callable[[Column], Column]] = {"bpe": bpe_tokens, "regex": regex_tokens}
