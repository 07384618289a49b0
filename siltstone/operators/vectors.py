"""Exact cosine of a bounded set of test vectors against a corpus of any size.

Test vectors go to every task as one matrix (size-checked; more come in blocks), corpus vectors stream through in
Arrow batches and one matrix product scores a batch. A fold says what a task keeps of its scores: the k best, sums by bin, counts, a seeded
sample. What leaves a task so depends on the tests, not on the corpus.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialize, spread

FLOOR = 1e-9
#: Numbers of test vectors times dimensions that one matrix may hold.
BLOCK_NUMBERS = 50_000_000


def as_doubles(vector: str) -> Column:
    return F.transform(F.col(vector), lambda x: x.cast("double"))


def norm(vector: str) -> Column:
    return F.sqrt(F.aggregate(as_doubles(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalized(vector: str, floor: float = FLOOR) -> Column:
    """Each component over the length, which counts as floor at least."""
    return F.transform(as_doubles(vector), lambda x: x / F.greatest(norm(vector), F.lit(floor)))


def cosine(a: str, b: str) -> Column:
    """Cosine of two vectors of one row; 0 where one has no length; an error where their dimensions differ."""
    dot = F.aggregate(F.zip_with(as_doubles(a), as_doubles(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    length = norm(a) * norm(b)
    same = F.assert_true(F.size(a) == F.size(b), F.lit("vectors differ in dimension"))
    return F.when(same.isNull(), F.when(length == 0, 0.0).otherwise(dot / length))


def _matrix(vectors) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), FLOOR)


def _blocks(tests: DataFrame, test_id: str, vector: str) -> tuple[int, Iterator[tuple[list, np.ndarray]]]:
    """(number of blocks, test vectors in blocks that fit a worker, one at a time). Each block costs a pass over the corpus, never a join."""
    rows = tests.select(F.col(test_id).alias("t"), F.col(vector).alias("v")).where("t is not null and v is not null")
    size = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    blocks = math.ceil(size[0] * (size[1] or 0) / BLOCK_NUMBERS)

    def each() -> Iterator[tuple[list, np.ndarray]]:
        for b in range(blocks):
            part = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).orderBy("t").collect()
            if part:
                yield [r["t"] for r in part], _matrix(r["v"] for r in part)

    return blocks, each()


class Fold:
    """What a task makes of its scores: step takes (ids of the tests, ids of the corpus rows, scores) of each batch and may yield a frame,
    end yields what is left. A fold is made anew in each task, from what is set here."""

    columns = ""

    def begin(self, names: np.ndarray) -> None:
        self.names = names

    def step(self, theirs: np.ndarray, scores: np.ndarray) -> Iterator[pd.DataFrame]:
        raise NotImplementedError

    def end(self) -> Iterator[pd.DataFrame]:
        return iter(())


def folded(tests: DataFrame, corpus: DataFrame, make: Callable[[], Fold], test_id: str = "test_id", corpus_id: str = "corpus_id", vector: str = "embedding") -> DataFrame:
    """The rows of the folds of all tasks. In the fold's columns, {t} and {c} are the types of the ids.

    Test vectors of more than one block are searched for block by block: a block's rows are written before the next is sent."""
    source = spread(corpus.select(F.col(corpus_id).alias("c"), F.col(vector).alias("v")).where("c is not null and v is not null"))
    kinds = make().columns.format(t=tests.schema[test_id].dataType.simpleString(), c=source.schema["c"].dataType.simpleString())
    spark = corpus.sparkSession
    blocks, each = _blocks(tests, test_id, vector)
    out = None
    for ids, matrix in each:
        shared = spark.sparkContext.broadcast((np.array(ids), matrix))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, left = shared.value
            fold = make()
            fold.begin(names)
            for batch in batches:
                if len(batch):
                    batch = batch.sort_values("c", kind="stable")
                    yield from fold.step(batch["c"].to_numpy(), left @ _matrix(batch["v"]).T)
            yield from fold.end()

        part = source.mapInPandas(search, kinds)
        if blocks > 1:
            part = materialize(part)
            shared.destroy()
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], kinds)


class Every(Fold):
    """Every score: for small corpora and tests only."""

    columns = "test_id {t}, corpus_id {c}, score double"

    def step(self, theirs, scores):
        n = scores.shape[1]
        yield pd.DataFrame({"test_id": np.repeat(self.names, n), "corpus_id": np.tile(theirs, len(self.names)), "score": scores.ravel()})


class Best(Fold):
    """The k best of each test in all batches of a task, ties by the corpus row's id."""

    columns = Every.columns

    def __init__(self, k: int, places: int | None):
        self.k, self.places = k, 12 if places is None else places

    def begin(self, names):
        super().begin(names)
        self.scores, self.theirs = None, None

    def step(self, theirs, scores):
        theirs = np.broadcast_to(theirs, scores.shape)
        if self.scores is not None:
            theirs, scores = np.concatenate([self.theirs, theirs], axis=1), np.concatenate([self.scores, scores], axis=1)
        if scores.shape[1] > self.k:
            key = np.round(scores, self.places)
            # what a partial sort leaves at the edge may tie with what it drops: ties go by id
            edge = np.partition(key, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k, None]
            rows, places = np.nonzero(key >= edge)
            order = np.lexsort((theirs[rows, places], -key[rows, places], rows))
            rows, places = rows[order], places[order]
            first = np.searchsorted(rows, np.arange(len(scores)))
            pick = places[first[:, None] + np.arange(self.k)]
            theirs, scores = np.take_along_axis(theirs, pick, 1), np.take_along_axis(scores, pick, 1)
        self.theirs, self.scores = theirs, scores
        yield from ()

    def end(self):
        if self.scores is not None:
            n = self.scores.shape[1]
            yield pd.DataFrame({"test_id": np.repeat(self.names, n), "corpus_id": self.theirs.ravel(), "score": self.scores.ravel()})


class Summed(Fold):
    """Frames of sums that are added up whenever they have grown long."""

    keys, sums, limit = ["t"], {"n": "sum"}, 1_000_000

    def begin(self, names):
        super().begin(names)
        self.held, self.rows = [], 0

    def added(self) -> pd.DataFrame:
        return pd.concat(self.held).groupby(self.keys, as_index=False).agg(self.sums)

    def hold(self, frame: pd.DataFrame) -> None:
        self.held.append(frame)
        self.rows += len(frame)
        if self.rows > self.limit:
            self.held = [self.added()]
            self.rows = len(self.held[0]) // 2

    def end(self):
        if self.held:
            done = self.added()
            done.insert(0, "test_id", self.names[done.pop("t").to_numpy()])
            yield done


class Binned(Summed):
    columns = "test_id {t}, bin int, n long, total double, squares double, least double, most double"
    keys, sums = ["t", "bin"], {"n": "sum", "total": "sum", "squares": "sum", "least": "min", "most": "max"}

    def __init__(self, low: float, high: float, bins: int, clip: bool, places: int):
        self.low, self.high, self.bins, self.clip, self.places = low, high, bins, clip, places

    def bin_of(self, scores: np.ndarray) -> np.ndarray:
        place = np.floor((scores - self.low) / ((self.high - self.low) / self.bins)).astype(np.int32)
        return np.clip(place, 0, self.bins - 1) if self.clip else np.where((scores < self.low) | (scores > self.high), -1, np.minimum(place, self.bins - 1)).astype(np.int32)

    def step(self, theirs, scores):
        scores = np.round(scores, self.places)
        flat = pd.DataFrame({"t": np.repeat(np.arange(len(self.names)), scores.shape[1]), "bin": self.bin_of(scores).ravel(), "s": scores.ravel()})
        flat["q"] = flat["s"] ** 2
        self.hold(flat.groupby(["t", "bin"], as_index=False).agg(n=("s", "size"), total=("s", "sum"), squares=("q", "sum"), least=("s", "min"), most=("s", "max")))
        yield from ()


class Counted(Binned):
    """How often each rounded score occurs in the bins that are wanted of its test."""

    columns = "test_id {t}, score double, n long"
    keys, sums = ["t", "score"], {"n": "sum"}

    def __init__(self, wanted: dict, *binning):
        super().__init__(*binning)
        self.wanted = wanted

    def begin(self, names):
        super().begin(names)
        self.mask = np.zeros((len(names), self.bins), dtype=bool)
        for k, name in enumerate(names.tolist()):
            self.mask[k, self.wanted.get(name, [])] = True

    def step(self, theirs, scores):
        scores = np.round(scores, self.places)
        place = self.bin_of(scores)
        t, c = np.nonzero(self.mask[np.arange(len(scores))[:, None], place] & (place >= 0))
        if len(t):
            self.hold(pd.DataFrame({"t": t, "score": scores[t, c], "n": 1}).groupby(["t", "score"], as_index=False).agg(n=("n", "sum")))
        yield from ()


class Reached(Fold):
    """How many scores of each test are at or over each level."""

    columns = "test_id {t}, n long, reached array<bigint>"

    def __init__(self, levels: tuple[float, ...], places: int):
        self.levels, self.places = levels, places

    def begin(self, names):
        super().begin(names)
        self.n, self.reached = 0, np.zeros((len(names), len(self.levels)), dtype=np.int64)

    def step(self, theirs, scores):
        scores = np.round(scores, self.places)
        self.n += scores.shape[1]
        for i, level in enumerate(self.levels):
            self.reached[:, i] += (scores >= level).sum(axis=1)
        yield from ()

    def end(self):
        yield pd.DataFrame({"test_id": self.names, "n": self.n, "reached": list(self.reached)})


class Below(Fold):
    """How many scores of the tests of a group are strictly below each value that is asked for in the group."""

    columns = "grp string, value double, below long, n long"

    def __init__(self, group_of: dict, asked: dict[str, list[float]], places: int):
        self.group_of, self.asked, self.places = group_of, {g: np.array(sorted(set(v))) for g, v in asked.items()}, places

    def begin(self, names):
        super().begin(names)
        groups = [self.group_of.get(name) for name in names.tolist()]
        self.rows = {g: np.flatnonzero([x == g for x in groups]) for g in self.asked}
        self.places_of = {g: np.zeros(len(v) + 1, dtype=np.int64) for g, v in self.asked.items()}

    def step(self, theirs, scores):
        scores = np.round(scores, self.places)
        for g, rows in self.rows.items():
            if len(rows):
                self.places_of[g] += np.bincount(np.searchsorted(self.asked[g], scores[rows].ravel(), side="right"), minlength=len(self.asked[g]) + 1)
        yield from ()

    def end(self):
        for g, counts in self.places_of.items():
            if counts.sum():
                # a score before the first value or on one isn't below it
                yield pd.DataFrame({"grp": g, "value": self.asked[g], "below": counts.cumsum()[:-1], "n": counts.sum()})


class Drawn(Fold):
    """Of each test's scores at or over its cut the n with the least seeded keys, md5 of seed, test and corpus row."""

    columns = "test_id {t}, corpus_id {c}, score double, key string"

    def __init__(self, n: int, cuts: dict | None, seed: int | str, places: int):
        self.n, self.cuts, self.seed, self.places = n, cuts, seed, places

    def begin(self, names):
        super().begin(names)
        self.kept: list[list[tuple]] = [[] for _ in names]
        self.least = np.array([-np.inf if self.cuts is None else self.cuts.get(name, np.inf) for name in names.tolist()])

    def step(self, theirs, scores):
        scores = np.round(scores, self.places)
        named = theirs.astype(str)
        for t, name in enumerate(self.names.tolist()):
            begun = hashlib.md5(f"{self.seed}:{name}:".encode())
            found = self.kept[t]
            for c in np.flatnonzero(scores[t] >= self.least[t]).tolist():
                key = begun.copy()
                key.update(named[c].encode())
                found.append((key.hexdigest(), theirs[c], scores[t, c]))
            if len(found) > self.n:
                self.kept[t] = heapq.nsmallest(self.n, found, key=lambda x: x[:2])
        yield from ()

    def end(self):
        rows = [(name, c, s, key) for name, kept in zip(self.names.tolist(), self.kept, strict=True) for key, c, s in kept]
        if rows:
            yield pd.DataFrame(rows, columns=["test_id", "corpus_id", "score", "key"])


def scored(tests: DataFrame, corpus: DataFrame, k: int | None = None, places: int | None = None, **names) -> DataFrame:
    """(test_id, corpus_id, score) of every test against every corpus vector; with k, of each task the k best a test (rounded to places), ties by corpus_id."""
    return folded(tests, corpus, Every if k is None else lambda: Best(k, places), **names)


def score_partials(tests: DataFrame, corpus: DataFrame, low: float = -1.0, high: float = 1.0, bins: int = 10_000, clip: bool = False, places: int = 6, **names) -> DataFrame:
    """(test_id, bin, n, total, squares, least, most): sums of all scores of a test in each bin of equal width.

    No score leaves its task: each adds its batches up and sends a row a test and bin that occurs, so that what is shuffled
    depends on tests and bins, not on the corpus. Outside scores go to the edge bins with clip, else to bin -1. Histograms, moments, rates and
    thresholds over any number of comparisons come from these rows."""
    parts = folded(tests, corpus, lambda: Binned(low, high, bins, clip, places), **names)
    return parts.groupBy("test_id", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("squares").alias("squares"), F.min("least").alias("least"), F.max("most").alias("most"))


def score_quantiles(tests: DataFrame, corpus: DataFrame, percents: dict[str, float], places: int = 6, bins: int = 2_000, partials: DataFrame | None = None, **names) -> DataFrame:
    """(test_id, a column for each named percent): exact quantiles with interpolation of each test's scores, rounded to places.

    Two passes: bins tell in which of them the ranks at both sides of a quantile lie, then only the distinct scores in those bins are counted, of which there
    are as many as a bin's width holds. What is shuffled and sent to the driver depends on tests and percents, not on the corpus."""
    partials = materialize(score_partials(tests, corpus, bins=bins, clip=True, places=places, **names)) if partials is None else partials
    upto = F.sum("n").over(Window.partitionBy("test_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    running = partials.select("test_id", "bin", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(Window.partitionBy("test_id")).alias("m"))
    at = lambda p: (F.col("m") - 1) * F.lit(p / 100)
    ranks = F.array(*(x for p in percents.values() for x in (F.floor(at(p)), F.ceil(at(p)))))
    held = running.where(F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("upto"))))
    held = held.select("test_id", "bin", "before", "m")
    rows = held.collect()  # two bins a test and percent at most
    held = partials.sparkSession.createDataFrame(rows, held.schema)
    wanted: dict = {}
    for r in rows:
        wanted.setdefault(r["test_id"], []).append(r["bin"])
    counts = folded(tests, corpus, lambda: Counted(wanted, -1.0, 1.0, bins, True, places), **names)
    place = F.floor((F.col("score") + 1.0) / F.lit(2.0 / bins))
    counts = counts.groupBy("test_id", "score").agg(F.sum("n").alias("n")).withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
    within = F.sum("n").over(Window.partitionBy("test_id", "bin").orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.join(held, ["test_id", "bin"]).withColumn("last", F.col("before") + within - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    value = lambda rank: F.max(F.when((rank >= F.col("first")) & (rank <= F.col("last")), F.col("score")))
    got = []
    for name, p in percents.items():
        low, high = value(F.floor(at(p))), value(F.ceil(at(p)))
        over = F.max(at(p) - F.floor(at(p)))
        got.append(F.when(over == 0, low).otherwise((F.max(F.ceil(at(p)) - at(p))) * low + over * high).alias(name))
    return ranked.groupBy("test_id").agg(*got)


def score_rates(tests: DataFrame, corpus: DataFrame, levels: tuple[float, ...], places: int = 6, **names) -> DataFrame:
    """(test_id, n_<level>, pct_<level>): how many of a test's scores reach each level, and their share in percent."""
    parts = folded(tests, corpus, lambda: Reached(levels, places), **names)
    summed = parts.groupBy("test_id").agg(F.sum("n").alias("n"), *(F.sum(F.col("reached")[i]).alias(f"n_{round(level * 100)}") for i, level in enumerate(levels)))
    return summed.select("test_id", *(c for level in levels for c in (F.col(f"n_{round(level * 100)}"), (F.col(f"n_{round(level * 100)}") * 100 / F.col("n")).alias(f"pct_{round(level * 100)}"))))


def score_cdf(tests: DataFrame, corpus: DataFrame, groups: DataFrame, group: str, places: int = 2, **names) -> DataFrame:
    """(group, score, cdf) over the scores, rounded to places, of all tests of a group. groups: test_id, group."""
    bins = 2 * 10**places + 1
    half = 0.5 / 10**places
    # each bin holds one rounded score
    partials = score_partials(tests, corpus, -1 - half, 1 + half, bins, True, places, **names)
    counts = partials.join(groups, "test_id").groupBy(group, F.col("most").alias("score")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy(group)
    upto = F.sum("n").over(w.orderBy("score").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(group, "score", (upto / F.sum("n").over(w)).alias("cdf"))


def best_percentiles(tests: DataFrame, corpus: DataFrame, groups: DataFrame, group: str, places: int = 6, **names) -> DataFrame:
    """(group, test_id, best, pct): each test's best score, and the share in percent of all scores of its group's tests that are strictly below it."""
    best = materialize(score_partials(tests, corpus, bins=1, clip=True, places=places, **names).groupBy("test_id").agg(F.max("most").alias("best")).join(groups, "test_id"))
    rows = best.select("test_id", F.col(group).cast("string").alias("g"), "best").collect()
    asked: dict[str, list[float]] = {}
    for r in rows:
        asked.setdefault(r["g"], []).append(r["best"])
    group_of = {r["test_id"]: r["g"] for r in rows}
    parts = folded(tests, corpus, lambda: Below(group_of, asked, places), **names)
    summed = parts.groupBy("grp", "value").agg(F.sum("below").alias("below"), F.sum("n").alias("n"))
    met = best.join(summed, F.col(group).cast("string").eqNullSafe(F.col("grp")) & (F.col("best") == F.col("value")))
    return met.select(group, "test_id", "best", (100 * F.col("below") / F.col("n")).alias("pct"))


def score_sample(tests: DataFrame, corpus: DataFrame, n: int, cuts: DataFrame | None = None, seed: int | str = 0, places: int = 6, **names) -> DataFrame:
    """(test_id, corpus_id, score, key, pick): of each test up to n of its scores in seeded order, with cuts (test_id, cut) of those at or over its cut."""
    least = None if cuts is None else {r["test_id"]: r["cut"] for r in cuts.select("test_id", "cut").collect()}
    drawn = folded(tests, corpus, lambda: Drawn(n, least, seed, places), **names)
    order = Window.partitionBy("test_id").orderBy("key", "corpus_id")
    return drawn.withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= n)


def moments(partials: DataFrame, group: str = "test_id") -> DataFrame:
    """Greatest, least, mean and population deviation of a test's scores, and their number."""
    s = partials.groupBy(group).agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("squares").alias("q"), F.min("least").alias("min_score"), F.max("most").alias("max_score"))
    mean = F.col("t") / F.col("n")
    return s.select(group, "max_score", "min_score", mean.alias("mean_score"), F.sqrt(F.greatest(F.lit(0.0), F.col("q") / F.col("n") - mean * mean)).alias("std_score"), "n")


def top_matches(tests: DataFrame, corpus: DataFrame, k: int = 1000, places: int | None = 6, least: float | None = None, **names) -> DataFrame:
    """The k best corpus vectors of each test by score, then corpus_id: test_id, rank, corpus_id, score. Scores are rounded
    before they are ranked, so that equal vectors tie. least drops scores under it."""
    found = scored(tests, corpus, k=k, places=places, **names)
    if places is not None:
        found = found.withColumn("score", F.round("score", places))
    if least is not None:
        found = found.where(F.col("score") >= least)
    order = Window.partitionBy("test_id").orderBy(F.col("score").desc(), F.col("corpus_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("test_id", "rank", "corpus_id", "score")


def drop_similar(corpus: DataFrame, tests: DataFrame, threshold: float = 0.75, corpus_id: str = "corpus_id", vector: str = "embedding", test_id: str = "test_id") -> DataFrame:
    """Corpus rows whose greatest cosine with any test vector is under the threshold. One flag a row leaves the scan; nothing is joined."""
    def greatest_with(shared) -> Column:
        @F.pandas_udf("double")
        def greatest(vectors: pd.Series) -> pd.Series:
            known = vectors.notna()
            best = np.full(len(vectors), np.nan)
            if known.any():
                best[known.to_numpy()] = (_matrix(vectors[known]) @ shared.value.T).max(axis=1)
            return pd.Series(best)

        return F.coalesce(greatest(F.col(vector)), F.lit(-1.0))

    out = corpus
    blocks, each = _blocks(tests, test_id, vector)
    for _, matrix in each:
        shared = corpus.sparkSession.sparkContext.broadcast(matrix)
        out = out.where(greatest_with(shared) < threshold)
        if blocks > 1:
            out = materialize(out)
            shared.destroy()
    return out
