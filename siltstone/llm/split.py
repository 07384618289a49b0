"""Problem 2: cutting oversized texts into pieces at natural boundaries.

A token is a longest run of characters other than space, tab, CR and LF. Each text's token offsets and sorted
arrays of boundaries (as token numbers), by rank, are computed once; a piece ends at the last boundary under the limit,
found by binary search, of the best rank that has one; else after the last token that fits. The next piece
begins overlap tokens earlier.
"""

from __future__ import annotations

import re
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import small_side, spread

_TOKEN = re.compile(r"[^ \t\r\n]+")
_BLANK = re.compile(r"\n[ \t]*\r?\n")
_ENVIRONMENT = re.compile(r"\\(begin|end)\{[^{}\n]*\}")
_DEFINITION = re.compile(r"^(?:async def |def |class |@\w|func |fn |public |private |#include|import |from \w)", re.M)
_TURN = re.compile(r"^(?:Prompt|Response|User|Assistant|System|Human|Question|Answer|Q|A):", re.M)
_ITEM = re.compile(r"^[ \t]*(?:[-*+]|\d+[.)]|[a-z][.)])[ \t]", re.M)
_SENTENCE = re.compile(r"[.!?\u2026\u3002][\"')\]\u201d\u2019]*(?=[ \t\r\n])")
_CLAUSE = re.compile(r"[,;:\u2013\u2014](?=[ \t\r\n])")
_LINE = re.compile(r"\r\n|\n|\r")
#: Ranks of boundaries, the best first.
RANKS = ("block", "sentence", "line", "clause")
PIECE = "piece int, start long, end long, n_tokens long, cut string"


def token_count(text: Column) -> Column:
    """Tokens of a text; null has none. Stays in the JVM."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\r\n]+")), F.lit(0)).cast("long")


def boundaries(text: str, starts: np.ndarray) -> list[list[int]]:
    """For each rank the sorted numbers of tokens before which one may cut. Those within a LaTeX environment are no better than a line's end."""
    begins, ends, depth = [], [], 0
    for m in _ENVIRONMENT.finditer(text):
        if m[1] == "begin":
            if depth == 0:
                begins.append(m.start())
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                ends.append(m.end())
    closed = ends if len(ends) == len(begins) else [*ends, len(text)]
    inside = list(zip(begins, closed, strict=True))
    first = [a for a, _ in inside]

    def outside(at: int) -> bool:
        k = bisect_right(first, at) - 1
        return k < 0 or at <= inside[k][0] or at >= inside[k][1]

    block = [m.end() for m in _BLANK.finditer(text)] + begins + ends
    block += [m.start() for pattern in (_DEFINITION, _TURN) for m in pattern.finditer(text)]
    sentence = [m.end() for m in _SENTENCE.finditer(text)] + [m.start() for m in _ITEM.finditer(text)]
    line = [m.end() for m in _LINE.finditer(text)]
    ranked = [[at for at in block if outside(at)], [at for at in sentence if outside(at)], line + [at for at in sentence if not outside(at)], [m.end() for m in _CLAUSE.finditer(text)]]
    return [sorted({int(x) for x in np.searchsorted(starts, np.array(r, dtype=np.int64))} - {0, len(starts)}) for r in ranked]


def cuts(n: int, ranked: list[list[int]], most: int, least: int, overlap: int) -> list[tuple[int, int, str]]:
    """(first token, token after the last, why it ends there) of each piece.

    A piece has at most `most` tokens and, where a boundary or a hard cut allows it, at least `least`, the last one too.
    """
    out, at = [], 0
    overlap = max(0, min(overlap, most - 1))
    while n - at > most:
        limit = at + most
        floor = max(at + least, at + overlap + 1)
        # leave the last piece, which begins `overlap` before the cut, enough tokens
        soft = limit if n - (limit - overlap) >= least else max(floor, n + overlap - least)
        end, why = min(limit, soft), "hard"
        for ceiling in dict.fromkeys((min(limit, soft), limit)):
            found = False
            for name, marks in zip(RANKS, ranked, strict=True):
                k = bisect_right(marks, ceiling) - 1
                if k >= 0 and marks[k] >= floor:
                    end, why, found = marks[k], name, True
                    break
            if found:
                break
        out.append((at, end, why))
        at = end - overlap
    out.append((at, n, "end"))
    return out


def pieces_of(text: str, most: int, least: int, overlap: int) -> list[tuple[int, int, int, int, str]]:
    """(number, first character, character after the last, tokens, why it ends there). Pieces keep the white space behind their last token, the first one also what is before its first."""
    spans = [m.span() for m in _TOKEN.finditer(text)]
    n = len(spans)
    if n <= most:
        return [(0, 0, len(text), n, "end")]
    starts = np.fromiter((a for a, _ in spans), dtype=np.int64, count=n)
    out = []
    for k, (a, b, why) in enumerate(cuts(n, boundaries(text, starts), most, least, overlap)):
        first = 0 if a == 0 else spans[a][0]
        out.append((k, first, len(text) if b == n else spans[b][0], b - a, why))
    return out


def limits_of(config: DataFrame, *keys: str) -> DataFrame:
    """Of each key (columns of the config's data set and mode) its limits; of several rows the least max_tokens."""
    named = config.select(F.col("dataset_short_name").alias("ds"), F.lower(F.trim("mode")).alias("md"), F.struct(F.col("max_tokens").alias("most"), F.coalesce("min_tokens", F.lit(1)).alias("least"), F.coalesce("overlap_tokens", F.lit(0)).alias("overlap")).alias("limit"))
    return named.where("limit.most > 0").groupBy(*keys).agg(F.min("limit").alias("limit"))


def split_oversized(df: DataFrame, config: DataFrame, key: str, text: str, dataset: str, mode: str, default_mode: str = "paragraph") -> DataFrame:
    """One row a piece: key, piece (from 0), pieces, start, end (characters), n_tokens, cut, text.

    config has dataset_short_name, mode, min_tokens, max_tokens and overlap_tokens, one row for each dataset and mode, and may have is_default, which
    marks a dataset's limits for modes without a row. A mode counts without outer white space and case; a missing one is default_mode. Texts within the
    limit, and those for which config has no limit, are one whole piece; Python doesn't see them. A null text is one piece with null text and no tokens,
    an empty or blank one is one piece without tokens. A run of characters longer than any limit is one token and
    is never cut. Repeated rows are cut alike; a null key passes through; an overlap of the limit or more counts as one less than it;
    empty tables give an empty result, or whole pieces where config is empty; other columns are ignored.
    """
    trimmed = F.lower(F.regexp_replace(F.col(f"`{mode}`"), r"^\s+|\s+$", ""))
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.col(f"`{dataset}`").alias("ds"), F.when(trimmed.isNull() | (trimmed == ""), default_mode).otherwise(trimmed).alias("md"))
    limited = spread(rows).join(small_side(limits_of(config, "ds", "md")), ["ds", "md"], "left")
    if "is_default" in config.columns:
        default = limits_of(config.where("is_default"), "ds").withColumnRenamed("limit", "default")
        limited = limited.join(small_side(default), "ds", "left").withColumn("limit", F.coalesce("limit", "default"))
    counted = limited.withColumn("n", token_count(F.col("text")))
    over = F.coalesce(F.col("n") > F.col("limit.most"), F.lit(False))

    @F.pandas_udf("array<struct<piece:int,pieces:int,start:bigint,end:bigint,n_tokens:bigint,cut:string,text:string>>")
    def cut(texts: pd.Series, most: pd.Series, least: pd.Series, overlap: pd.Series) -> pd.Series:
        out = []
        for t, *limit in zip(texts, most, least, overlap, strict=True):
            got = pieces_of(t, *map(int, limit)) if t is not None else None
            out.append(got and [{"piece": i, "pieces": len(got), "start": a, "end": b, "n_tokens": n, "cut": why, "text": t[a:b]} for i, a, b, n, why in got])
        return pd.Series(out, dtype=object)

    # only what is over its limit is sent to Python
    parts = cut(F.when(over, F.col("text")), *(F.coalesce(f"limit.{c}", F.lit(0)) for c in ("most", "least", "overlap")))
    length = F.coalesce(F.char_length("text"), F.lit(0)).cast("long")
    whole = F.array(F.struct(F.lit(0).alias("piece"), F.lit(1).alias("pieces"), F.lit(0).cast("long").alias("start"), length.alias("end"), F.col("n").alias("n_tokens"), F.lit("end").alias("cut"), F.col("text").alias("text")))
    made = counted.select("key", F.explode(F.coalesce(parts, whole)).alias("p"))
    return made.select(F.col("key").alias(key), "p.*")
