"""Problem 5: near-duplicate texts by MinHash with Bayesian pruning of candidates.

1. Each text becomes the set of its runs of consecutive words, and that a MinHash signature. Texts of one set
   form a class; one representative stands for it, so that copies never meet each other.
2. Bands of the signature bring candidates together: of two representatives that reach the threshold, all but
   about miss_at_threshold agree in a band. A bucket of a great many members is cut into blocks; each pair of blocks
   is a task of its own.
3. Candidates compare their signatures step by step; a pair is dropped when the posterior probability (uniform
   prior) that it reaches the threshold falls below a tolerance.
4. The pairs left are verified exactly on their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.classes import BLOCK, in_blocks, pairs_across, pairs_within
from siltstone.llm.words import WordCodes, mix, shingles, words
from siltstone.runtime import materialize, small_side, spread

#: Posterior probability under which a candidate is dropped.
TOLERANCE = 1e-6
#: Values compared between two looks at the posterior.
STEP = 16


def band_rows(num_perm: int, threshold: float, miss_at_threshold: float = 1e-4) -> int:
    """The most rows a band may have so that a pair exactly at the threshold shares a band but for this probability."""
    best = 1
    for rows in range(1, num_perm + 1):
        if (1 - threshold**rows) ** (num_perm // rows) <= miss_at_threshold:
            best = rows
    return best


def beta_tail(matches: int, compared: int, threshold: float, points: int = 4000) -> float:
    """P(similarity >= threshold) after so many matches, for a uniform prior, by integration of the Beta posterior."""
    x = (np.arange(points) + 0.5) / points
    log = matches * np.log(x) + (compared - matches) * np.log1p(-x)
    weight = np.exp(log - log.max())
    return float(weight[x >= threshold].sum() / weight.sum())


def least_matches(num_perm: int, threshold: float, tolerance: float = TOLERANCE, step: int = STEP) -> list[tuple[int, int]]:
    """(values compared, matches that a pair needs to be compared further), computed once for all pairs."""
    out = []
    for compared in [*range(step, num_perm, step), num_perm]:
        out.append((compared, next((m for m in range(compared + 1) if beta_tail(m, compared, threshold) >= tolerance), compared + 1)))
    return out


def permutations(num_perm: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(seed)
    odd = draw.integers(0, 1 << 63, num_perm, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, draw.integers(0, 1 << 63, num_perm, dtype=np.uint64)


def signature(codes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """One 16-bit value for each permutation, of the shingle with the least permuted code. Long texts go through in blocks."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(codes), 4096):
        np.minimum(least, (codes[at : at + 4096, None] * odd + add).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16)


def features(df: DataFrame, key: str, text: str, ngram: int, num_perm: int, seed: int = 7) -> DataFrame:
    """(key, kind, n, sig) of every row whose text has a shingle: kind is a 128-bit code of the set, n its size."""
    odd, add = permutations(num_perm, seed)
    source = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("key is not null and text is not null")

    def compute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for batch in batches:
            keys, kinds, sizes, sigs = [], [], [], []
            for k, t in zip(batch["key"], batch["text"], strict=True):
                runs = shingles(np.array([codes[w] for w in words(t)], dtype=np.uint64), ngram)
                if len(runs):
                    # two sums over scattered codes tell sets apart, whatever their order
                    kind = np.array([mix(runs).sum(dtype=np.uint64), mix(runs ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], dtype=np.uint64)
                    keys.append(k)
                    kinds.append(kind.tobytes())
                    sizes.append(len(runs))
                    sigs.append(signature(runs, odd, add).tobytes())
            if keys:
                yield pd.DataFrame({"key": pd.Series(keys, dtype=object), "kind": kinds, "n": pd.Series(sizes, dtype="int64"), "sig": sigs})

    return spread(source).mapInPandas(compute, f"key {source.schema['key'].dataType.simpleString()}, kind binary, n long, sig binary")


def alike_in_size(threshold: float) -> Column:
    """Whether two sets of na and nb shingles can reach the threshold."""
    return F.least("na", "nb") >= F.lit(threshold) * F.greatest("na", "nb")


def candidates(reps: DataFrame, threshold: float, num_perm: int, rows: int, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b, of representatives (rid, n, sig) that share a band, in large buckets only where the sizes allow the threshold; each pair once."""
    bands = [F.xxhash64(F.lit(i), F.substring("sig", 2 * rows * i + 1, 2 * rows)) for i in range(num_perm // rows)]
    exploded = reps.select("rid", "n", F.explode(F.array(*bands)).alias("band"))
    # counted by pre-aggregation: a bucket of a third of all rows is no task of its own. Most buckets have one member and end here; the two of a
    # bucket of two are its least and greatest
    buckets = materialize(exploded.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("rid").alias("a"), F.max("rid").alias("b")).where("m > 1"))
    twos = buckets.where("m = 2").select("a", "b")
    more = buckets.where("m > 2").select("band", F.ceil(F.col("m") / F.lit(block)).cast("int").alias("blks"))
    # written once, since both sides of a bucket's pairs read them
    members = exploded.join(small_side(more), "band")
    members = materialize(members.withColumn("blk", F.pmod(F.xxhash64("rid"), F.col("blks").cast("long")).cast("int")))
    # each member meets its own block and the others; in a bucket of one block that is one row
    grid = F.explode(F.sequence(F.lit(0), F.col("blks") - 1))
    left = members.select("band", F.col("rid").alias("a"), F.col("n").alias("na"), F.col("blk").alias("x"), grid.alias("y"))
    right = members.select("band", F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("blk").alias("y"), grid.alias("x"))
    pairs = left.join(right, ["band", "x", "y"]).where((F.col("a") < F.col("b")) & alike_in_size(threshold)).select("a", "b")
    return twos.union(pairs).distinct()


def pruned(pairs: DataFrame, reps: DataFrame, threshold: float, num_perm: int, tolerance: float = TOLERANCE) -> DataFrame:
    """Candidates whose sizes and whose signatures, compared step by step, leave the threshold within reach."""
    looks = least_matches(num_perm, threshold, tolerance)
    left = reps.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = reps.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            one = np.frombuffer(b"".join(batch["sa"]), dtype=np.uint16).reshape(-1, num_perm)
            two = np.frombuffer(b"".join(batch["sb"]), dtype=np.uint16).reshape(-1, num_perm)
            left_in, matches, done = np.arange(len(batch)), np.zeros(len(batch), dtype=np.int64), 0
            for compared, needed in looks:
                matches = matches + (one[left_in, done:compared] == two[left_in, done:compared]).sum(axis=1)
                keep = matches >= needed
                left_in, matches, done = left_in[keep], matches[keep], compared
            yield batch.iloc[left_in][["a", "b"]]

    kind = reps.schema["rid"].dataType.simpleString()
    return pairs.join(left, "a").join(right, "b").where(alike_in_size(threshold)).select("a", "b", "sa", "sb").mapInPandas(compare, f"a {kind}, b {kind}")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, ngram: int) -> DataFrame:
    """Pairs (a, b) with their similarity, computed on the words themselves, where it reaches the threshold. texts: rid, text."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sets: dict[int, set] = {}

            def of(rid, text, sets=sets) -> set:
                if rid not in sets:
                    w = words(text)
                    sets[rid] = {tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)}
                return sets[rid]

            found = []
            for a, b, ta, tb in zip(batch["a"], batch["b"], batch["ta"], batch["tb"], strict=True):
                x, y = of(a, ta), of(b, tb)
                common = len(x & y)
                union = len(x) + len(y) - common
                if union and common / union >= threshold:
                    found.append((a, b, common / union))
            if found:
                yield pd.DataFrame(found, columns=["a", "b", "similarity"])

    kind = pairs.schema["a"].dataType.simpleString()
    with_left = pairs.join(texts.select(F.col("rid").alias("a"), F.col("text").alias("ta")), "a")
    both = with_left.join(texts.select(F.col("rid").alias("b"), F.col("text").alias("tb")), "b")
    return both.select("a", "b", "ta", "tb").mapInPandas(check, f"a {kind}, b {kind}, similarity double")


class NearDuplicates:
    """members: (key, kind) of every text; reps: one row a class; links: verified pairs of classes."""

    def __init__(self, df: DataFrame, key: str, text: str, threshold: float = 0.8, ngram: int = 5, num_perm: int = 128, miss_at_threshold: float = 1e-4, tolerance: float = TOLERANCE, block: int = BLOCK):
        rows = band_rows(num_perm, threshold, miss_at_threshold)
        self.block = block
        found = materialize(features(df, key, text, ngram, num_perm))
        self.members = found.select("key", "kind").distinct()
        reps = found.groupBy("kind").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        # an id that is stored with the row, so that it stays when a task is run again
        self.reps = materialize(reps.withColumn("rid", F.monotonically_increasing_id()))
        close = materialize(pruned(candidates(self.reps, threshold, num_perm, rows, block), self.reps, threshold, num_perm, tolerance))
        ends = close.select(F.col("a").alias("rid")).union(close.select(F.col("b"))).distinct()
        wanted = self.reps.select("rid", "key").join(ends, "rid")
        texts = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).where("text is not null").join(wanted, "key")
        # a key may be delivered on many rows with its text
        texts = texts.groupBy("rid").agg(F.first("text").alias("text"))
        self.links = materialize(verified(close, texts, threshold, ngram))

    def pairs(self, key: str) -> DataFrame:
        """Every pair (key_a, key_b, similarity), key_a < key_b: within a class, and between linked classes."""
        placed = materialize(in_blocks(self.members.select(F.col("kind").alias("cls"), "key"), self.block))
        within = pairs_within(placed).withColumn("similarity", F.lit(1.0))
        kinds = self.reps.select("rid", "kind")
        links = self.links.join(kinds.select(F.col("rid").alias("a"), F.col("kind").alias("kind_a")), "a").join(kinds.select(F.col("rid").alias("b"), F.col("kind").alias("kind_b")), "b")
        across = pairs_across(links.select(F.col("kind_a").alias("a"), F.col("kind_b").alias("b"), "similarity"), placed)
        return within.unionByName(across).select(F.col("ka").alias(f"{key}_a"), F.col("kb").alias(f"{key}_b"), "similarity")

    def groups(self, key: str) -> DataFrame:
        """One row a text: its class (the class's least key), how many links the class has, and the group of linked classes (its least key)."""
        label = components(self.links.select("a", "b"))
        degree = self.links.select(F.col("a").alias("rid")).union(self.links.select(F.col("b"))).groupBy("rid").agg(F.count(F.lit(1)).alias("links"))
        named = self.reps.select("rid", "kind", F.col("key").alias("class_id")).join(label, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
        least = named.groupBy("root").agg(F.min("class_id").alias("group_id"))
        classes = named.join(least, "root").join(degree, "rid", "left").select("kind", "class_id", "group_id", F.coalesce("links", F.lit(0)).alias("links"))
        return self.members.join(classes, "kind").select(F.col("key").alias(key), "class_id", "group_id", "links")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(rid, root) of every end of a link: root is the least id connected with it.

    Alternates large-star and small-star steps until no edge changes; each step is one shuffle of the edges
    and pre-aggregates, so that an end with a great many links is no hot task.
    """
    edges = materialize(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e")).select(F.col("e.u").alias("u"), F.col("e.m").alias("v"))
        edges = materialize(small.where("u <> v").distinct())
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("rid"), F.col("v").alias("root")).union(edges.select(F.col("v"), F.col("v"))).distinct()


def near_duplicate_pairs(df: DataFrame, key: str, text: str, **settings) -> DataFrame:
    """Every pair (key_a, key_b, similarity) of different keys whose texts reach the threshold.

    Null keys and texts, and texts of fewer words than a run, are in no pair; a key on several rows counts once
    (its rows carry one text); a similarity exactly at the threshold counts; very long texts go through in blocks;
    an empty table gives an empty result; other columns are ignored.
    """
    return NearDuplicates(df, key, text, **settings).pairs(key)


def near_duplicate_groups(df: DataFrame, key: str, text: str, **settings) -> DataFrame:
    """One row for each key with a text of at least one run: class_id, group_id and the class's links. Other cases as for the pairs."""
    return NearDuplicates(df, key, text, **settings).groups(key)
