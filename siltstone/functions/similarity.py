"""Similarities of two texts in one row. Each keeps its own convention for empty texts.

Set measures are built-in array expressions; only those with a dynamic programme over word sequences run in Python,
on Arrow batches.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.text import normalized, space_words, words

NUMBER = r"\b(\d+\.?\d*)\b"


def token_runs(tokens: Column, n: int, between: str = "\u001f") -> Column:
    """The distinct runs of n tokens of an array; none where there are fewer."""
    if n == 1:
        return F.array_distinct(tokens)
    made = F.transform(F.sequence(F.lit(1), F.size(tokens) - (n - 1)), lambda i: F.array_join(F.slice(tokens, i, n), between))
    return F.when(F.size(tokens) >= n, F.array_distinct(made)).otherwise(F.array().cast("array<string>"))


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)(.)"), 1)


def grams(tokens: Column, n: int) -> Column:
    """The distinct runs of n tokens, joined by a unit separator; none where there are fewer tokens."""
    return bound(lambda t: token_runs(t, n), tokens)


def char_grams(text: Column, n: int) -> Column:
    """The distinct runs of n characters, in time linear in the text."""
    return bound(lambda t: token_runs(t, n, ""), characters(text))


def bound(function, *columns: Column) -> Column:
    """function of columns that are computed once: as fields of a lambda's variable, not as expressions repeated in every branch."""
    row = F.array(F.struct(*(c.alias(f"c{i}") for i, c in enumerate(columns))))
    return F.get(F.transform(row, lambda r: function(*(r[f"c{i}"] for i in range(len(columns))))), F.lit(0))


def jaccard(a: Column, b: Column, both_empty: float = 0.0) -> Column:
    """Common over united size of two arrays of distinct values; both_empty where neither has any, 0 where one has none."""

    def ratio(x: Column, y: Column, common: Column) -> Column:
        return F.when((F.size(x) == 0) & (F.size(y) == 0), both_empty).when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(common / (F.size(x) + F.size(y) - common))

    return bound(lambda x, y: bound(ratio, x, y, F.size(F.array_intersect(x, y))), a, b)


def ngram_jaccard(a: Column, b: Column, n: int, tokens=space_words) -> Column:
    """Runs of n tokens; two texts without any are equal."""
    return jaccard(grams(tokens(a), n), grams(tokens(b), n), 1.0)


def ngram_coverage(a: Column, b: Column, n: int, tokens=space_words) -> Column:
    """Share of a's runs that b has: 1 where a has none, 0 where only b has none."""

    def share(x: Column, y: Column) -> Column:
        return F.when(F.size(x) == 0, 1.0).when(F.size(y) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x))

    return bound(share, grams(tokens(a), n), grams(tokens(b), n))


def word_overlap(a: Column, b: Column, n: int) -> Column:
    """Runs of n lower-case words, in percent; 0 where either has none."""
    return 100 * jaccard(grams(words(a), n), grams(words(b), n))


def char_overlap(a: Column, b: Column, n: int) -> Column:
    """Runs of n lower-case characters, in percent; 0 where either has none."""
    return 100 * jaccard(char_grams(F.lower(a), n), char_grams(F.lower(b), n))


def short_safe_char_jaccard(a: Column, b: Column, n: int = 5) -> Column:
    """Runs of n characters of normalised texts; a shorter text is its own only run."""
    of = lambda t: F.when(F.char_length(normalized(t)) < n, F.array(normalized(t))).otherwise(char_grams(normalized(t), n))
    return jaccard(of(a), of(b))


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(F.array_distinct(words(a)), F.array_distinct(words(b)))


def tfidf_cosine(a: Column, b: Column) -> Column:
    """With the two texts as the whole corpus, a word of both has the weight ln(2/2) = 0, and one of a single text meets
    nothing: the cosine is always 0. Null where a text is null."""
    return F.when(a.isNotNull() & b.isNotNull(), 0.0)


def number_preservation(a: Column, b: Column) -> tuple[Column, Column, Column]:
    """(all kept, precision, recall) of the numbers in two texts, as sets."""
    x, y = F.array_distinct(F.regexp_extract_all(a, F.lit(NUMBER), 1)), F.array_distinct(F.regexp_extract_all(b, F.lit(NUMBER), 1))
    common = F.size(F.array_intersect(x, y))
    share = lambda of: F.when(F.size(of) == 0, 1.0).otherwise(common / F.size(of))
    return (F.size(x) == common) & (F.size(y) == common), share(y), share(x)


def length_ratio(a: Column, b: Column) -> Column:
    """Words of b over words of a; 0 where a has none."""
    return F.when(F.size(words(a)) == 0, 0.0).otherwise(F.size(words(b)) / F.size(words(a)))


def _codes(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray]:
    index: dict[str, int] = {}
    return np.array([index.setdefault(w, len(index)) for w in a]), np.array([index.setdefault(w, len(index)) for w in b])


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, one vector operation a word of a."""
    if not a or not b:
        return 0
    x, y = _codes(a, b)
    row = np.zeros(len(y) + 1, dtype=np.int32)
    for code in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], (row[:-1] + 1) * (y == code)))
    return int(row[-1])


def word_edits(a: list[str], b: list[str]) -> int:
    """Edit distance of two word sequences, one vector operation a word of a."""
    x, y = _codes(a, b) if a and b else (np.arange(len(a)), np.arange(len(b)))
    steps = np.arange(len(y) + 1)
    row = steps.copy()
    for i, code in enumerate(x):
        new = np.minimum(row[1:] + 1, row[:-1] + (y != code))
        row = np.minimum.accumulate(np.concatenate([[i + 1], new]) - steps) + steps
    return int(row[-1])


def rouge_l_score(a: list[str], b: list[str]) -> float:
    common = common_subsequence(a, b)
    return 2 * common / (len(a) + len(b)) if common else 0.0


def word_edit_share(a: list[str], b: list[str]) -> float:
    return word_edits(a, b) / max(len(a), len(b)) if a or b else 0.0


def bag_cosine_score(a: list[str], b: list[str]) -> float:
    """Cosine of word counts: 1 where both are empty, 0 where one is. Counted in Python: array expressions would take time in the square of the words."""
    if not a or not b:
        return float(not a and not b)
    x, y = Counter(a), Counter(b)
    return sum(n * y[w] for w, n in x.items() if w in y) / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def _on_words(function, words=words):
    def column(a: Column, b: Column) -> Column:
        @F.pandas_udf("double")
        def apply(x: pd.Series, y: pd.Series) -> pd.Series:
            return pd.Series([function(list(p), list(q)) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)], dtype="float64")

        return apply(words(a), words(b))

    return column


rouge_l = _on_words(rouge_l_score)
word_edit_distance = _on_words(word_edit_share)
bag_cosine = _on_words(bag_cosine_score, space_words)


def pair_metrics(a: Column, b: Column) -> Column:
    """All text measures of a pair as one struct, overlaps rounded to 2 places and the others to 4. Words and characters are taken once for all overlaps."""
    kept, precision, recall = number_preservation(a, b)

    def overlaps(wa: Column, wb: Column, ca: Column, cb: Column) -> Column:
        of_words = [F.round(100 * jaccard(token_runs(wa, n), token_runs(wb, n)), 2).alias(f"word_{n}") for n in range(1, 6)]
        of_chars = [F.round(100 * jaccard(token_runs(ca, n, ""), token_runs(cb, n, "")), 2).alias(f"char_{n}") for n in range(1, 6)]
        return F.struct(*of_words, *of_chars, F.round(jaccard(F.array_distinct(wa), F.array_distinct(wb)), 4).alias("token_jaccard"))

    sets = bound(overlaps, words(a), words(b), characters(F.lower(a)), characters(F.lower(b)))
    rest = [("rouge_l", rouge_l(a, b)), ("edit", word_edit_distance(a, b)), ("tfidf", tfidf_cosine(a, b)), ("number_precision", precision), ("number_recall", recall), ("length_ratio", length_ratio(a, b))]
    return F.struct(sets.alias("overlaps"), *(F.round(c, 4).alias(name) for name, c in rest), kept.alias("numbers_kept"))


def corpus_idf_cosine(a: list[str], b: list[str], idf: dict[str, float]) -> float:
    """Cosine with weights from a whole corpus, which the two-text form can't have."""
    x, y = Counter(a), Counter(b)
    weight = lambda c, w: c[w] * idf.get(w, 0.0)
    dot = sum(weight(x, w) * weight(y, w) for w in x.keys() & y.keys())
    length = math.sqrt(sum(weight(x, w) ** 2 for w in x) * sum(weight(y, w) ** 2 for w in y))
    return dot / length if length else 0.0
