"""Joins with the semantics of lookups: enrichment, not-found marks, ranges, replacement of slots, comparison of metrics, and MinHash joins."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import normalized
from siltstone.operators.dedup import keep_first
from siltstone.operators.sets import set_similarity_join as set_similarity_join
from siltstone.runtime import materialize

#: Starts of ranges that every task may hold.
MAX_RANGES = 1_000_000


def hydrate(matches: DataFrame, texts: DataFrame, key: str, text: str, order: str, missing: str | None = None) -> DataFrame:
    """matches with the text of their key; of several texts the last by order; without one null, or the mark for missing."""
    last = texts.groupBy(key).agg(F.max_by(text, order).alias(text))
    out = matches.join(last, key, "left")
    return out.withColumn(text, F.coalesce(text, F.lit(missing))) if missing is not None else out


def first_by_priority(df: DataFrame, key: str, split: str, priority: list[str], order: str) -> DataFrame:
    """One row a key: of the split that comes first in priority, then the first by order."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(split))
    return keep_first(df.where(place > 0).withColumn("__p", place), [key], ["__p", order]).drop("__p")


def with_tests(df: DataFrame, tests: DataFrame, key: str, missing: str = "drop") -> DataFrame:
    """Rows whose key has tests; missing='keep' keeps the others too, marked by has_tests."""
    known = tests.select(key).distinct()
    if missing == "drop":
        return df.join(known, key, "left_semi").withColumn("has_tests", F.lit(True))
    return df.join(known.withColumn("__t", F.lit(True)), key, "left").withColumn("has_tests", F.coalesce("__t", F.lit(False))).drop("__t")


def metric_comparison(base: DataFrame, tuned: DataFrame, key: str, value: str) -> DataFrame:
    """Both sides' metrics, their difference and percent change (0 where base is 0), also of keys that one side lacks."""
    both = base.select(key, F.col(value).alias("base")).join(tuned.select(key, F.col(value).alias("tuned")), key, "full")
    diff = F.col("tuned") - F.col("base")
    return both.select(key, "base", "tuned", diff.alias("diff"), F.when(F.col("base") == 0, 0.0).otherwise(100 * diff / F.col("base")).alias("pct"))


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, start: str, end: str) -> DataFrame:
    """points with the range [start, end) they fall in; ranges don't overlap, hold something and share points' type.

    Up to MAX_RANGES ranges, their sorted bounds go to every task and a point finds its range by binary search; the rest is an equi-join on
    the range's start. Beyond that, points and starts are sorted together in ranges of about equal size, and each point takes the
    last start at or before it, so that neither a wide range nor a crowded one is a task of its own."""
    inside = (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    clashing = [c for c in ranges.columns if c in points.columns]
    if clashing:
        raise ValueError(f"both sides have {clashing}")
    starts = [r[0] for r in ranges.where(F.col(start).isNotNull()).select(start).distinct().orderBy(start).limit(MAX_RANGES + 1).collect()]
    if len(starts) <= MAX_RANGES:
        kind = ranges.schema[start].dataType.simpleString()
        shared = points.sparkSession.sparkContext.broadcast(np.array(starts))

        @F.pandas_udf(kind)
        def start_of(values: pd.Series) -> pd.Series:
            known = shared.value
            if not len(known):
                return pd.Series([None] * len(values), dtype=object)
            place = np.searchsorted(known, values.to_numpy(), side="right") - 1
            return pd.Series(known[np.maximum(place, 0)]).where(pd.Series(place >= 0) & values.notna().reset_index(drop=True), None)

        found = points.where(F.col(point).isNotNull()).withColumn("__start", start_of(F.col(point)))
    else:
        both = points.select(F.col(point).alias("__v"), F.lit(1).alias("__is_point"), F.struct(*points.columns).alias("__row")).where("__v is not null").unionByName(
            ranges.select(F.col(start).alias("__v"), F.lit(0).alias("__is_point"), F.lit(None).cast(points.schema).alias("__row")).where("__v is not null").distinct()
        )
        parts = materialize(both.repartitionByRange("__v").withColumn("__part", F.spark_partition_id()))
        lasts = parts.where("__is_point = 0").groupBy("__part").agg(F.max("__v").alias("__last"))
        numbers = parts.select("__part").distinct().join(lasts, "__part", "left")
        earlier = numbers.select("__part", F.max("__last").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
        within = Window.partitionBy("__part").orderBy("__v", "__is_point").rowsBetween(Window.unboundedPreceding, 0)
        own = F.max(F.when(F.col("__is_point") == 0, F.col("__v"))).over(within)
        placed = parts.withColumn("__own", own).join(F.broadcast(earlier), "__part").where("__is_point = 1")
        found = placed.select("__row.*", F.coalesce("__own", "__before").alias("__start"))
    return found.join(ranges, F.col("__start") == F.col(start)).where(inside).drop("__start")


def replaced_slots(base: DataFrame, new: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """base with the columns of new at the positions new has; replaced tells where."""
    renamed = new.select(position, *(F.col(c).alias(f"__{c}") for c in columns), F.lit(True).alias("__r"))
    joined = base.join(renamed, position, "left")
    taken = F.coalesce("__r", F.lit(False))
    return joined.select(*(F.when(taken, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns), taken.alias("replaced"))


# --- MinHash of character runs -------------------------------------------------------------------------------------------------

PRIME = (1 << 31) - 1


def permutations(n: int, seed: int = 1) -> list[tuple[int, int]]:
    """(factor, summand) of n hash functions by a rule that any engine can follow."""
    return [((seed * 1_000_003 + i * 7_919_123 + 12_345) % PRIME or 1, (seed * 424_243 + i * 15_485_863 + 6_789) % PRIME) for i in range(1, n + 1)]


class GramCodes(dict):
    """28-bit codes of runs of characters, from their md5; remembered, since a corpus has few distinct ones."""

    limit = 500_000

    def __missing__(self, gram: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        code = self[gram] = int(hashlib.md5(gram.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16)
        return code


def minhash(text: Column, num_perm: int, n: int = 3, seed: int = 1) -> Column:
    """Signature of the runs of n characters of the normalised text, as array<bigint>; null for a shorter text.

    The normalising is the JVM's; runs and permutations of a batch are Python's, in numpy."""
    factors, summands = (np.array(x, dtype=np.uint64) for x in zip(*permutations(num_perm, seed), strict=True))

    @F.pandas_udf("array<bigint>")
    def least(texts: pd.Series) -> pd.Series:
        codes = GramCodes()

        def of(t: str | None):
            if t is None or len(t) < n:
                return None
            out = np.full(len(factors), PRIME, dtype=np.uint64)
            c = np.array([codes[g] for g in {t[i : i + n] for i in range(len(t) - n + 1)}], dtype=np.uint64)
            for at in range(0, len(c), 4096):
                x = c[at : at + 4096, None] * factors + summands
                x = (x & np.uint64(PRIME)) + (x >> np.uint64(31))  # the same modulo 2^31 - 1, and under twice that
                np.minimum(out, np.minimum(x, x - np.uint64(PRIME)).min(axis=0), out=out)  # a negative difference wraps to a great value
            return out.astype(np.int64)

        return texts.map(of)

    return least(normalized(text))


def best_bands(num_perm: int, threshold: float) -> tuple[int, int]:
    """(bands, rows) with the least sum of false positives and negatives over all similarities."""
    s = (np.arange(1000) + 0.5) / 1000
    best = None
    for bands in range(1, num_perm + 1):
        for rows in range(1, num_perm // bands + 1):
            caught = 1 - (1 - s**rows) ** bands
            cost = caught[s < threshold].sum() + (1 - caught[s >= threshold]).sum()
            if best is None or cost < best[0]:
                best = (cost, bands, rows)
    return best[1], best[2]


def sure_bands(num_perm: int, threshold: float, miss_at_threshold: float = 1e-4) -> tuple[int, int]:
    """(bands, rows) with the most rows with which a pair exactly at the threshold shares a band but for this probability; more similar pairs are missed less."""
    rows = max((r for r in range(1, num_perm + 1) if (1 - threshold**r) ** (num_perm // r) <= miss_at_threshold), default=1)
    return num_perm // rows, rows


def band_codes(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[text, band]: a code of each band of the signatures."""
    codes = np.tile(np.arange(1, bands + 1, dtype=np.uint64), (len(signatures), 1))
    for r in range(rows):
        codes = (codes + signatures[:, r : bands * rows : rows].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        codes ^= codes >> np.uint64(29)
    return codes


class HeldOut:
    """Normalised texts with their bands; their runs of n characters are made when a candidate needs them, and remembered up to a limit."""

    limit = 1_000_000

    def __init__(self, texts: list[str], signatures: np.ndarray, bands: int, rows: int, n: int):
        self.texts, self.bands, self.rows, self.n = texts, bands, rows, n
        codes = band_codes(signatures, bands, rows)
        order = np.argsort(codes, axis=None, kind="stable")
        self.codes, self.owner = codes.ravel()[order], order // bands
        self.known: dict[int, set[str]] = {}
        self.held = 0

    def runs(self, text: str) -> set[str]:
        return {text[i : i + self.n] for i in range(len(text) - self.n + 1)}

    def runs_of(self, k: int) -> set[str]:
        if k not in self.known:
            if self.held > self.limit:
                self.known, self.held = {}, 0
            self.known[k] = self.runs(self.texts[k])
            self.held += len(self.known[k])
        return self.known[k]

    def candidates(self, signatures: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, held-out text) of all that share a band, each pair once and rows in order."""
        codes = band_codes(signatures, self.bands, self.rows).ravel()
        low, high = np.searchsorted(self.codes, codes), np.searchsorted(self.codes, codes, side="right")
        count = high - low
        place = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        pair = np.unique(np.repeat(np.arange(len(codes)) // self.bands, count) * len(self.texts) + self.owner[place])
        return np.divmod(pair, len(self.texts))

    def near(self, texts: list[str], signatures: np.ndarray, threshold: float) -> list[int]:
        """Rows that reach the threshold of Jaccard with a held-out text, by their runs themselves."""
        hit, last, own = [], -1, set()
        for row, k in zip(*(x.tolist() for x in self.candidates(signatures)), strict=True):
            if hit and hit[-1] == row:
                continue
            if row != last:
                last, own = row, self.runs(texts[row])
            other = self.runs_of(k)
            if min(len(own), len(other)) / max(len(own), len(other)) >= threshold:
                common = len(own & other)
                if common / (len(own) + len(other) - common) >= threshold:
                    hit.append(row)
        return hit


#: Characters of held-out texts that one index holds; more go through in blocks.
BLOCK_CHARACTERS = 4_000_000


def minhash_decontaminated(
    train: DataFrame, held_out: DataFrame, key: str, text: str, threshold: float = 0.8, num_perm: int = 128, n: int = 3, miss_at_threshold: float = 1e-4, block_characters: int = BLOCK_CHARACTERS
) -> DataFrame:
    """train without the rows whose runs of n characters reach the threshold of Jaccard with any held-out text.

    Candidates share a band of their signatures: a pair exactly at the threshold does but for about miss_at_threshold, a more similar one
    more surely. They are verified on the runs themselves, so no row under the threshold leaves. The distinct held-out texts are an index
    that every task holds, a block at a time; train is read once a block and not shuffled. Texts shorter than n have no runs and stay.
    """
    bands, rows = sure_bands(num_perm, threshold, miss_at_threshold)
    spark = train.sparkSession
    signed = lambda df, *keep: df.select(*keep, normalized(F.col(text)).alias("t")).where(F.length("t") >= n).withColumn("sig", minhash(F.col("t"), num_perm, n))
    known = materialize(signed(held_out.select(normalized(F.col(text)).alias(text)).distinct()))
    blocks = max(1, math.ceil((known.agg(F.sum(F.length("t"))).first()[0] or 0) / block_characters))
    own = signed(train, F.col(key).alias("key"))
    own = materialize(own) if blocks > 1 else own
    parts = []
    for b in range(blocks):
        found = known.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("t").collect()
        signatures = np.array([r.sig for r in found], dtype=np.int64).reshape(len(found), num_perm)
        index = spark.sparkContext.broadcast(HeldOut([r.t for r in found], signatures, bands, rows, n))

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) and index.value.texts:
                    yield batch.iloc[index.value.near(batch["t"].tolist(), np.stack(batch["sig"].tolist()), threshold)][["key"]]

        parts.append(own.mapInPandas(search, f"key {own.schema['key'].dataType.simpleString()}"))
    hit = reduce(DataFrame.union, parts).distinct()
    return train.join(hit.withColumnRenamed("key", key), key, "left_anti")
