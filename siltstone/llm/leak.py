"""Problem 6: passages of evaluation items inside corpus texts.

Windows of a fixed number of words are embedded by a CGK random walk: at each step (three times as many as words, or
with edits as many as samples are taken from) the walk writes the word it stands on and moves on or stays by a random bit of step and word. Windows at a small edit
distance so become strings at a small Hamming distance, and bit sampling (the words at a few sampled steps, as a
key) brings them together. As many samples are drawn as the target recall needs for the worst mix of edits; then the
words are compared.
Items are a bounded index that every task holds, a block at a time: it is made, searched for and let go before the next. The corpus is read once a
block and not shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.words import WordCodes, mix, run_codes, word_code, words
from siltstone.operators.ranking import running_offsets
from siltstone.runtime import materialize, spread

#: Words of items that one index holds; more items go through in blocks of about so many words.
BLOCK_WORDS = 2_000_000
#: Steps that a sample takes, and windows embedded at once; fewer in an exact search, where a common run meets many windows of the index.
SAMPLED, SAMPLED_WITH_EDITS = 10, 12
AT_ONCE, AT_ONCE_EXACT = 16_384, 1024
#: Samples of one walk, and the most walks.
SAMPLES_A_WALK, MOST_WALKS = 6, 40
_STEP = np.uint64(0x9E3779B97F4A7C15)


def walk_bits(codes: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """[step, symbol]: whether the walk moves on. Symbol 0 is any word that no item has; the last one is the end of the window."""
    at = (np.arange(steps, dtype=np.uint64) + np.uint64(seed * 1000 + 1)) * _STEP
    bits = (mix(codes[None, :] ^ at[:, None]) >> np.uint64(17)) & np.uint64(1)
    bits[:, -1] = 0
    return bits.astype(np.int32)


def embed(symbols: np.ndarray, starts: np.ndarray, window: int, bits: np.ndarray, end: int) -> np.ndarray:
    """[step, window]: the walk's output for the windows that begin at starts."""
    out = np.empty((len(bits), len(starts)), dtype=np.int32)
    place = starts.astype(np.int64).copy()
    stop = place + window
    last = len(symbols) - 1
    for step in range(len(bits)):
        row = symbols[np.minimum(place, last)]
        row[place >= stop] = end
        out[step] = row
        place += bits[step][row]
    return out


def sample_key(embedded: np.ndarray, steps: np.ndarray) -> np.ndarray:
    key = np.zeros(embedded.shape[1], dtype=np.uint64)
    for step in steps:
        key = (key + embedded[step].astype(np.uint64)) * _STEP
        key ^= key >> np.uint64(29)
    return key


def edit_distance(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For each row, the least edit distance of the words in one to any beginning of those in two (-1: no word)."""
    n, width = two.shape
    row = np.tile(np.arange(width + 1, dtype=np.int16), (n, 1))
    for i in range(one.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        for j in range(width):
            differ = ((one[:, i] != two[:, j]) | (two[:, j] < 0)).astype(np.int16)
            new[:, j + 1] = np.minimum(np.minimum(row[:, j + 1], new[:, j]) + 1, row[:, j] + differ)
        row = new
    return row.min(axis=1)


@dataclass
class Sample:
    """Steps of a walk whose words form a key, and the index's windows by their keys."""

    steps: np.ndarray
    keys: np.ndarray | None = None
    order: np.ndarray | None = None
    filled: np.ndarray | None = None


class Index:
    """The windows of a block of items that aren't wording shared with other items."""

    def __init__(self, items: list[tuple[str, str, list[int]]], window: int, shared_run: int, max_edits: int, recall: float, exact: bool = False, seed: int = 11):
        self.window, self.max_edits, self.runs, self.parts = window, max_edits, None, None
        self.exact = exact and max_edits > 0
        self.ids = [item for item, _, _ in items]
        token_lists = [words(text) for _, text, _ in items]
        vocabulary = sorted({w for tokens in token_lists for w in tokens})
        self.symbol = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.end = len(vocabulary) + 1
        self.codes = np.array([0, *map(word_code, vocabulary), 0], dtype=np.uint64)
        symbols, starts, owner, at = [np.empty(0, dtype=np.int32)], [], [], 0
        for k, (tokens, (_, _, shared)) in enumerate(zip(token_lists, items, strict=True)):
            symbols.append(np.array([self.symbol[w] for w in tokens] + [-1], dtype=np.int32))
            common = np.zeros(len(tokens) + 1, dtype=np.int64)
            common[np.array(shared, dtype=np.int64)] = 1
            ahead = np.concatenate([[0], np.cumsum(common)])
            for p in range(len(tokens) - window + 1):
                if ahead[p + window - shared_run + 1] == ahead[p]:  # none of its runs is another item's
                    starts.append(at + p)
                    owner.append(k)
            at += len(tokens) + 1
        self.symbols, self.starts, self.owner = np.concatenate(symbols), np.array(starts, dtype=np.int64), np.array(owner, dtype=np.int64)
        self.recall, self.recalls = 1.0, {}
        self.walks = [] if self.exact else self.enough_walks(recall, np.random.default_rng(seed), seed)

    def __getstate__(self) -> dict:
        """Without the tables, which a worker makes in less time than they take to send."""
        bare = [(bits, [Sample(sample.steps) for sample in samples]) for bits, samples in self.walks]
        return self.__dict__ | {"walks": bare, "runs": None, "parts": None}

    def build(self) -> None:
        """Sort the index's windows by the keys of each sample, once in a process."""
        for bits, samples in self.walks if len(self.starts) else []:
            if samples[0].keys is not None:
                continue
            embedded = embed(self.symbols, self.starts, self.window, bits, self.end)
            for sample in samples:
                keys = sample_key(embedded, sample.steps)
                sample.order = np.argsort(keys, kind="stable").astype(np.int32)
                sample.keys = keys[sample.order]
                sample.filled = np.zeros(1 << 20, dtype=bool)
                sample.filled[(keys >> np.uint64(44)).astype(np.int64)] = True

    def edited(self, kinds: tuple[int, ...], trials: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        """(starts, rows) of random windows and of texts that begin with them after edits of these kinds (0 deletion, 1 insertion, 2 substitution)
        at places of their own. What follows is the item's own next words, or random ones behind its end, so a row is never short of words.
        Rows at a smaller distance, as where edits cancel, are drawn anew; where that doesn't help, there is no such row.
        """
        wide = self.window + self.max_edits
        starts, rows = draw.choice(self.starts, trials), np.zeros((trials, wide), dtype=np.int32)
        span, again = np.arange(self.window), np.arange(trials)
        for _ in range(20):
            starts[again] = draw.choice(self.starts, len(again))
            for r in again:
                row = self.symbols[starts[r] : starts[r] + wide + self.max_edits].tolist()
                row = row[: row.index(-1)] if -1 in row else row
                for where, kind in zip(np.sort(draw.choice(self.window, len(kinds), replace=False))[::-1], draw.permutation(kinds), strict=True):
                    row[where : where + (kind != 1)] = [] if kind == 0 else [int(draw.integers(self.end))]
                row += draw.integers(self.end, size=max(0, wide - len(row))).tolist()
                rows[r] = row[:wide]
            again = again[edit_distance(self.symbols[starts[again][:, None] + span], rows[again]) < len(kinds)]
            if not len(again):
                break
        kept = np.setdiff1d(np.arange(trials), again)
        return starts[kept], rows[kept]

    def enough_walks(self, recall: float, draw: np.random.Generator, seed: int, trials: int = 2000) -> list[tuple[np.ndarray, list[Sample]]]:
        """Walks with their samples, added until of every mix of max_edits kinds of edits the share recall of edited windows meets its origin.

        Windows without an edit meet it in any sample, so then one is enough. self.recalls are the shares reached, self.recall the least.
        Samples take steps from those after which half of the walks are still in words that deletions leave: behind, a text has
        the next words where the window has its end.
        """
        sampled = SAMPLED if not self.max_edits else SAMPLED_WITH_EDITS
        steps = 3 * self.window if not self.max_edits else max(sampled, 2 * (self.window - self.max_edits))
        new = lambda: Sample(np.sort(draw.choice(steps, sampled, replace=False)))
        if not self.max_edits or not len(self.starts):
            return [(walk_bits(self.codes, steps, seed), [new()])]
        cases = {kinds: self.edited(kinds, trials, draw) for kinds in combinations_with_replacement(range(3), self.max_edits)}
        cases = {kinds: (*case, np.zeros(len(case[0]), dtype=bool)) for kinds, case in cases.items() if len(case[0])}
        walks: list[tuple[np.ndarray, list[Sample]]] = []
        self.recall = 0.0 if cases else 1.0
        while self.recall < recall or not walks:
            if len(walks) == MOST_WALKS:
                raise ValueError(f"{MOST_WALKS} walks find {self.recall:.3f} of the windows with edits of the worst kind, not {recall}")
            bits, samples = walk_bits(self.codes, steps, seed + len(walks)), [new() for _ in range(SAMPLES_A_WALK)]
            walks.append((bits, samples))
            for kinds, (pick, rows, met) in cases.items():
                one = embed(self.symbols, pick, self.window, bits, self.end)
                two = embed(rows.ravel(), np.arange(len(rows)) * rows.shape[1], self.window, bits, self.end)
                for sample in samples:
                    met |= (one[sample.steps] == two[sample.steps]).all(axis=0)
                self.recalls[kinds] = float(met.mean())
            self.recall = min(self.recalls.values(), default=1.0)
        return walks

    def may_match(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Which windows have as many runs of words of the index's windows as k edits leave. An edit changes q runs of q words at most, so of
        a window's window - q + 1 runs all but k * q are unchanged in a text within k edits, and none is lost.
        """
        most = self.window // (self.max_edits + 1)
        if self.runs is None:
            self.runs = {}
            for run in range(max(1, most - 1), most + 1):
                inner = np.unique((self.starts[:, None] + np.arange(self.window - run + 1)).ravel())
                self.runs[run] = np.unique(run_codes(self.symbols.astype(np.uint64), run)[inner])
        maybe = np.ones(len(starts), dtype=bool)
        for run, known in self.runs.items():
            own = run_codes(symbols.astype(np.int64).astype(np.uint64), run)
            at = np.minimum(np.searchsorted(known, own), len(known) - 1)
            ahead = np.concatenate([[0], np.cumsum(known[at] == own)])
            last = np.minimum(starts + self.window + self.max_edits - run + 1, len(own))
            maybe &= ahead[last] - ahead[np.minimum(starts, len(own))] >= self.window - run + 1 - self.max_edits * run
        return maybe

    def met_by_parts(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in starts, window of the index) of all that may be within max_edits. Of a window cut into max_edits + 1 parts, an edited text
        has one part unchanged, moved by max_edits words at most; so no pair is lost."""
        if self.parts is None:
            bounds = np.linspace(0, self.window, self.max_edits + 2).astype(int)
            self.parts = []
            for a, b in zip(bounds, bounds[1:]):
                codes = run_codes(self.symbols.astype(np.uint64), b - a)[self.starts + a]
                order = np.argsort(codes, kind="stable")
                self.parts.append((a, b - a, codes[order], order))
        places, theirs = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for a, size, known, order in self.parts:
            own = run_codes(symbols.astype(np.int64).astype(np.uint64), size)
            for move in range(-self.max_edits, self.max_edits + 1):
                at = starts + a + move
                inside = np.flatnonzero((at >= starts) & (at < len(own)))
                codes = own[at[inside]]
                low, high = np.searchsorted(known, codes), np.searchsorted(known, codes, side="right")
                count = high - low
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                places.append(np.repeat(inside, count))
                theirs.append(order[np.repeat(low, count) + offset])
        return np.concatenate(places), np.concatenate(theirs)

    def hits(self, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in starts, item, edits) of every window that is within max_edits of an item's window and met it in a sample (or in a part, if the search is exact)."""
        self.build()
        places, theirs = [], []
        if self.exact:
            place, their = self.met_by_parts(symbols, starts)
            places, theirs = [place, place[:0]], [their, their[:0]]
        for bits, samples in self.walks:
            embedded = embed(symbols, starts, self.window, bits, self.end)
            for sample in samples:
                own = sample_key(embedded, sample.steps)
                near = np.flatnonzero(sample.filled[(own >> np.uint64(44)).astype(np.int64)])
                low, high = np.searchsorted(sample.keys, own[near]), np.searchsorted(sample.keys, own[near], side="right")
                count = high - low
                near, low, count = near[count > 0], low[count > 0], count[count > 0]
                # all windows of the index under the key
                offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                places.append(np.repeat(near, count))
                theirs.append(sample.order[np.repeat(low, count) + offset])
        place, their = np.concatenate(places), np.concatenate(theirs)
        if len(places) > 1 and len(place):
            place, their = np.divmod(np.unique(place * len(self.starts) + their), len(self.starts))
        found = []
        span, wide = np.arange(self.window), np.arange(self.window + self.max_edits)
        for at in range(0, len(place), AT_ONCE):
            p, t = place[at : at + AT_ONCE], their[at : at + AT_ONCE]
            one = self.symbols[self.starts[t][:, None] + span]
            two = symbols[np.minimum(starts[p][:, None] + wide, len(symbols) - 1)]
            if self.max_edits:
                # words behind the text's end match nothing
                two = np.where(np.logical_or.accumulate(two < 0, axis=1), -1, two)
                edits = edit_distance(one, two)
            else:
                edits = np.where((one == two).all(axis=1), 0, 1)
            ok = edits <= self.max_edits
            found.append((p[ok], self.owner[t[ok]], edits[ok].astype(np.int64)))
        if not found:
            none = np.empty(0, dtype=np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def items_with_shared_runs(items: DataFrame, item: str, text: str, run: int) -> DataFrame:
    """(item, text, shared): shared are the places where a run of words begins that another item has too."""
    source = items.select(F.col(f"`{item}`").alias("item"), F.col(f"`{text}`").alias("text")).where("item is not null and text is not null")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = WordCodes()
        for batch in batches:
            names, places, found = [], [np.empty(0, dtype=np.int32)], [np.empty(0, dtype=np.uint64)]
            for name, t in zip(batch["item"], batch["text"], strict=True):
                at = run_codes(np.array([codes[w] for w in words(t)], dtype=np.uint64), run)
                names += [name] * len(at)
                places.append(np.arange(len(at), dtype=np.int32))
                found.append(at)
            yield pd.DataFrame({"item": pd.Series(names, dtype=object), "place": np.concatenate(places), "code": np.concatenate(found).astype(np.int64)})

    placed = source.mapInPandas(runs, "item string, place int, code long")
    several = placed.groupBy("code").agg(F.min("item").alias("least"), F.max("item").alias("most")).where("least <> most").select("code")
    shared = placed.join(several, "code").groupBy("item").agg(F.collect_set("place").alias("shared"))
    return source.join(shared, "item", "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<int>")))


def in_segments(known: DataFrame, window: int, most: int) -> DataFrame:
    """(item, segment, text, shared, n): items of more than most words as several segments, which share window - 1 words, so that each window is in one."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item, text, shared in zip(batch["item"], batch["text"], batch["shared"], strict=True):
                line, places = words(text), np.sort(np.array(shared, dtype=np.int64))
                for k, at in enumerate(range(0, max(1, len(line) - window + 1), most)):
                    part = line[at : at + most + window - 1]
                    rows.append((item, k, " ".join(part), (places[(places >= at) & (places < at + len(part))] - at).tolist(), len(part)))
            if rows:
                yield pd.DataFrame(rows, columns=["item", "segment", "text", "shared", "n"])

    return known.mapInPandas(cut, f"item {known.schema['item'].dataType.simpleString()}, segment int, text string, shared array<int>, n long")


class LeakSearch:
    """found: (key, item, edits, windows, extra...); recall: the least share of edited windows that an index was measured to find, 1 for an exact search."""

    def __init__(
        self, corpus: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str,
        window: int = 13, shared_run: int = 8, max_edits: int = 0, recall: float = 0.95, exact: bool = False, extra: list[str] | None = None, block_words: int = BLOCK_WORDS,
    ):
        extra = extra or []
        renamed = [F.col(f"`{c}`").alias(f"x{i}") for i, c in enumerate(extra)]
        kept = ["key", *(f"x{i}" for i in range(len(extra)))]
        source = spread(corpus.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), *renamed).where("key is not null and text is not null"))
        if max_edits:  # many walks a text: a key's text is searched once, which is worth a shuffle of the texts
            source = source.groupBy("key").agg(F.first("text").alias("text"), *(F.min(c).alias(c) for c in kept[1:]))
        known = materialize(in_segments(items_with_shared_runs(items, item, item_text, shared_run), window, block_words))
        total = known.agg(F.sum("n")).first()[0] or 0
        blocks = max(1, math.ceil(total / block_words))
        # blocks by running numbers of words, so that none has more than twice block_words
        placed = known.withColumn("block", F.lit(0)) if blocks == 1 else materialize(running_offsets(known, ["item", "segment"], "n").withColumn("block", F.floor(F.col("start") / block_words).cast("int")))
        spark = corpus.sparkSession
        self.recall, parts = 1.0, []
        for b in range(blocks):
            rows = placed.where(F.col("block") == b).orderBy("item", "segment").select("item", "text", "shared").collect()
            index = Index([tuple(r) for r in rows], window, shared_run, max_edits, recall, exact)
            self.recall = min(self.recall, index.recall)
            shared = spark.sparkContext.broadcast(index)
            part = self.searched(source, kept, shared)
            if blocks > 1:  # a block's index is let go before the next is made
                part = materialize(part)
                shared.destroy()
            parts.append(part)
        found = reduce(DataFrame.union, parts)
        least = [F.min(f"x{i}").alias(c) for i, c in enumerate(extra)]
        # an item's windows may be in several blocks, and a place of a text meet some of each
        per_item = found.groupBy("key", "row", "item").agg(F.min("edits").alias("edits"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), *(F.min(c).alias(c) for c in kept[1:])) if blocks > 1 else found
        self.found = per_item.withColumn("windows", F.size("places").cast("long")).groupBy(F.col("key").alias(key), F.col("item").alias(item)).agg(F.min("edits").alias("edits"), F.max("windows").alias("windows"), *least)

    @staticmethod
    def searched(source: DataFrame, kept: list[str], index) -> DataFrame:
        """(kept, row, item, edits, places) of each text and item that met: the words at which its windows begin. row is a digest of the text."""
        kinds = ", ".join(f"{c} {source.schema[c].dataType.simpleString()}" for c in kept)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ix: Index = index.value
            get, gap = ix.symbol.get, ix.window + ix.max_edits
            for batch in batches:
                pieces, firsts, rows, at = [], [], [], 0
                base = np.zeros(len(batch), dtype=np.int64)
                for r, t in enumerate(batch["text"]):
                    line = [get(w, 0) for w in words(t)]
                    if len(line) >= ix.window:
                        pieces.append(np.array(line + [-1] * gap, dtype=np.int32))
                        n, base[r] = len(line) - ix.window + 1, at
                        firsts.append(np.arange(at, at + n))
                        rows.append(np.full(n, r))
                        at += len(line) + gap
                if not pieces or not len(ix.starts):
                    continue
                symbols, starts, row_of = np.concatenate(pieces), np.concatenate(firsts), np.concatenate(rows)
                if ix.max_edits:
                    maybe = ix.may_match(symbols, starts)
                    starts, row_of = starts[maybe], row_of[maybe]
                    if not len(starts):
                        continue
                step = AT_ONCE_EXACT if ix.exact else AT_ONCE
                got = [(a, *ix.hits(symbols, starts[a : a + step])) for a in range(0, len(starts), step)]
                place = np.concatenate([a + p for a, p, _, _ in got])
                if not len(place):
                    continue
                found = pd.DataFrame({"row": row_of[place], "item": np.concatenate([i for _, _, i, _ in got]), "edits": np.concatenate([e for _, _, _, e in got]), "place": starts[place] - base[row_of[place]]})
                found["item"] = [ix.ids[i] for i in found["item"]]  # segments of an item are one item
                best = found.groupby(["row", "item"], as_index=False).agg(edits=("edits", "min"), places=("place", "unique"))
                out = batch.iloc[best["row"].to_numpy(dtype=np.int64)][kept].reset_index(drop=True)
                out["row"] = [hashlib.blake2b(batch["text"].iloc[r].encode("utf-8", "surrogatepass"), digest_size=16).digest() for r in best["row"]]
                out["item"], out["edits"], out["places"] = best["item"], best["edits"].astype("int32"), best["places"]
                yield out

        return source.mapInPandas(search, f"{kinds}, row binary, item string, edits int, places array<bigint>")


def leaked_items(corpus: DataFrame, items: DataFrame, key: str, text: str, item: str, item_text: str, **settings) -> DataFrame:
    """(key, item, edits, windows, *extra): the items of which a corpus text holds a window of words within max_edits.

    Only windows count of which no run of shared_run words occurs in another item. edits is the least of all
    windows that matched, windows their number on the row where it is greatest; extra columns are the least value of
    the key's rows. Without edits every match is found; with edits about the share recall of single windows with the
    worst mix of max_edits edits, and other windows and a passage of several windows more surely; with exact=True all of them, by parts
    that the edits leave in place of walks, at a cost that grows with how common the items' wording is.

    Null keys and texts, and texts shorter than a window, hold nothing; a key on several rows counts once; ties don't
    arise; very long texts go through in blocks of windows, very long items in segments; empty tables give an empty result; other columns are ignored.
    """
    return LeakSearch(corpus, items, key, text, item, item_text, **settings).found
