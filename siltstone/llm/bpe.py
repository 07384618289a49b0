"""Problem 7: byte-level BPE ids of whole texts with a public vocabulary.

A token sequence is the BPE result of a text exactly if each two neighbours are what BPE makes of their joint
bytes. So a text is encoded by taking the longest token at each place and stepping back where a neighbour
doesn't fit; the fit of two tokens is remembered. All tokens at all places come from one pass of an
Aho-Corasick automaton over the bytes, mapped to Latin-1 characters.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.runtime import reach_workers

#: Folder of the public vocabularies; every function takes another.
TOKENIZERS = os.environ.get("SILTSTONE_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the published pattern that cuts a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries that a worker remembers of pieces and of token pairs; both are only speed.
REMEMBERED = 200_000


class Encoder:
    """Encodes with one rank file. Ids are the ranks."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, "rb") as lines:
            pairs = [line.split() for line in lines if line.strip()]
        self.rank = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.bytes = {rank: token for token, rank in self.rank.items()}
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.cut = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def merged(self, data: bytes) -> list[int]:
        """BPE by its definition: the lowest-ranked neighbours merge first. Used for joint bytes of two tokens."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fit(self, left: int, right: int) -> bool:
        known = self.fits.get((left, right))
        if known is None:
            if len(self.fits) >= REMEMBERED:
                self.fits.clear()
            known = self.fits[left, right] = self.merged(self.bytes[left] + self.bytes[right]) == [left, right]
        return known

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece, by backtracking over the tokens that start at each place, longest first."""
        whole = self.rank.get(data)
        if whole is not None:
            return [whole]
        n = len(data)
        starts: list[list[int]] = [[] for _ in range(n)]
        for end, (length, rank) in self.automaton.iter(data.decode("latin-1")):
            starts[end - length + 1].append(rank)  # at one start, ends rise: the longest is last
        path: list[int] = []
        begun = [0]  # where each token of the path starts, then the place reached
        tried = [len(starts[0])]  # of each place on the path, how many of its tokens are still to be tried
        dead = bytearray(n + 1)  # places from which no continuation fits
        while begun[-1] < n:
            at = begun[-1]
            options = starts[at]
            k = tried[-1] - 1
            while k >= 0:
                token = options[k]
                end = at + len(self.bytes[token])
                if not dead[end] and (not path or self.fit(path[-1], token)):
                    break
                k -= 1
            if k >= 0:
                tried[-1] = k
                path.append(token)
                begun.append(end)
                tried.append(len(starts[end]) if end < n else 0)
            else:
                dead[at] = 1
                path.pop()
                begun.pop()
                tried.pop()
        return path

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        known = self.pieces
        for piece in self.cut(text):
            got = known.get(piece)
            if got is None:
                got = self.piece(piece.encode("utf-8", "surrogatepass"))
                if len(piece) <= 64:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[piece] = got
            ids += got
        return ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The worker's encoder; built once in each Python worker."""
    return Encoder(path)


def vocabulary_path(folder: str | None = None, name: str = VOCABULARY) -> str:
    return os.path.join(folder or TOKENIZERS, name)


def token_ids(text: Column, path: str | None = None) -> Column:
    """Ids of each text as array<int>; special tokens' strings are plain text; null and empty texts have an empty list."""
    path = path or vocabulary_path()

    @F.pandas_udf(T.ArrayType(T.IntegerType(), False))
    def ids(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode
        return pd.Series([encode(t) if t else [] for t in texts], dtype=object)

    return ids(text)


def token_count(text: Column, path: str | None = None) -> Column:
    """Number of ids of each text; null and empty texts have none."""
    path = path or vocabulary_path()

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = encoder(path).encode
        return pd.Series([len(encode(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """One row (key, ids) for each row of df, in one pass without a shuffle.

    Null and empty texts have an empty list, never null; very long texts take time in proportion; repeated rows
    stay repeated; a null key stays null; an empty table gives an empty result; other columns are ignored.
    """
    reach_workers(df.sparkSession)
    return df.select(F.col(f"`{key}`").alias(key), token_ids(F.col(f"`{text}`"), path).alias("ids"))
