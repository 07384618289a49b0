"""Problem 8: mixing sources to target weights of size, with capped repeats.

Each record of a source gets the same expected number of copies: the source's tokens wanted over those it has. Whole
copies are certain; the fraction left is rounded by pivotal sampling: two fractions are paired and mass moves between
them at random, in the ratio of their sizes, until one is 0 or 1. So the expected copies and the sum of the tokens are
both kept. Buckets of records are rounded apart; what one leaves open, one record a mix and source, goes up a tree of
bounded fan-in until one record is left, which is drawn.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.runtime import materialize, spread

#: Records that a bucket rounds in one go, and buckets that meet at a node of the tree.
BUCKET, FAN_IN = 20_000, 64


def source_name(column: str) -> Column:
    """Lower case, without outer white space, hyphens as underscores."""
    return F.regexp_replace(F.lower(F.regexp_replace(F.col(f"`{column}`"), r"^\s+|\s+$", "")), "-", "_")


def allotted(sources: pd.DataFrame) -> pd.DataFrame:
    """Tokens wanted of each source of one mix: its budget by weight; what a source can't give (capped at its tokens times
    max_repeats) is shared out among the others by weight, until all is given or every source is at its cap."""
    out = sources.copy()
    budget = float(out["budget"].iloc[0])
    cap = (out["tokens"] * out["max_repeats"].clip(lower=0)).to_numpy(dtype=float)
    weight = out["weight"].clip(lower=0).fillna(0).to_numpy(dtype=float)
    wanted, open_, left = np.zeros(len(out)), weight > 0, budget
    while open_.any() and left > 0:
        share = np.where(open_, weight, 0) / weight[open_].sum() * left
        full = open_ & (share >= cap)
        if not full.any():
            wanted[open_] = share[open_]
            break
        wanted[full] = cap[full]
        left -= cap[full].sum()
        open_ &= ~full
    out["target"] = np.where(weight.sum() > 0, weight / max(weight.sum(), 1e-300), 0.0) * budget
    out["wanted"] = wanted
    return out


def pivot(chance: np.ndarray, size: np.ndarray, draw: np.random.Generator) -> np.ndarray:
    """Round fractions in turn; all but at most one come out as 0 or 1. The sum of chance*size and each expectation are kept."""
    out = chance.astype(float).copy()
    luck = draw.random(len(out))
    held = -1
    for i in range(len(out)):
        if out[i] <= 0.0 or out[i] >= 1.0:
            continue
        if held < 0:
            held = i
            continue
        p, q, ratio = out[held], out[i], size[held] / size[i]
        # up: held gains and i loses until one is integral; down: the other way
        up = min(1.0 - p, q / ratio)
        down = min(p, (1.0 - q) / ratio)
        if luck[i] * (up + down) < down:
            p, q = (1.0, q - ratio * up) if up == 1.0 - p else (p + up, 0.0)
        else:
            p, q = (0.0, q + ratio * down) if down == p else (p - down, 1.0)
        p, q = (0.0 if p < 1e-12 else 1.0 if p > 1 - 1e-12 else p), (0.0 if q < 1e-12 else 1.0 if q > 1 - 1e-12 else q)
        out[held], out[i] = p, q
        if 0.0 < p < 1.0:
            continue
        held = i if 0.0 < q < 1.0 else -1
    return out


def rounded(rows: DataFrame, seed: int, last: bool = False) -> DataFrame:
    """rows (mix, source, key, tokens, whole, chance, bucket), partitioned by bucket and sorted: chance comes out as 0 or 1, but for one row of each mix, source and bucket; if last, that one is drawn."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        first = part.iloc[0]
        code = [seed, int(first["bucket"]), *np.frombuffer(f"{first['mix']}\0{first['source']}".encode(), dtype=np.uint8).tolist()]
        draw = np.random.default_rng(code)
        part = part.sort_values("key", kind="stable").reset_index(drop=True)
        order = draw.permutation(len(part))
        chance = np.empty(len(part))
        chance[order] = pivot(part["chance"].to_numpy()[order], part["tokens"].to_numpy(dtype=float)[order], draw)
        if last:
            chance = np.where((chance > 0) & (chance < 1), (draw.random(len(part)) < chance).astype(float), chance)
        part["chance"] = chance
        return part

    return rows.groupBy("mix", "source", "bucket").applyInPandas(one, rows.schema)


class Mixture:
    """copies: mix_name, source, key, n_tokens, copies (one or more) of each record taken.
    shares: one row a mix and source, with the share wanted and the share reached."""

    def __init__(self, df: DataFrame, targets: DataFrame, key: str, source: str, tokens: Column, seed: int = 0, bucket: int = BUCKET, fan_in: int = FAN_IN):
        self.key, self.seed = key, seed
        sized = spread(df.select(F.col(f"`{key}`").alias("key"), source_name(source).alias("source"), tokens.alias("tokens")))
        self.sized = materialize(sized)
        per_source = self.sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n"))
        n, total = self.sized.agg(F.count(F.lit(1)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
        goals = targets.select(F.col("mix_name").alias("mix"), source_name("source").alias("source"), F.coalesce("weight", F.lit(0.0)).alias("weight"), F.coalesce("max_repeats", F.lit(1)).cast("long").alias("max_repeats"), F.col("budget_share"))
        known = goals.join(per_source, "source", "left").select("mix", "source", "weight", "max_repeats", F.coalesce("tokens", F.lit(0)).alias("tokens"), (F.col("budget_share") * F.lit(total)).alias("budget"))
        schema = T.StructType([*known.schema.fields, T.StructField("target", T.DoubleType()), T.StructField("wanted", T.DoubleType())])
        self.plan = materialize(known.groupBy("mix").applyInPandas(allotted, schema))
        self.taken = self._taken(max(1, math.ceil(n / bucket)), fan_in)

    def _taken(self, buckets: int, fan_in: int) -> DataFrame:
        rates = self.plan.where("wanted > 0 and tokens > 0").select("mix", "source", F.least(F.col("wanted") / F.col("tokens"), F.col("max_repeats").cast("double")).alias("rate"))
        rows = self.sized.where("tokens > 0 and key is not null").join(rates, "source")
        rows = rows.select("mix", "source", "key", "tokens", F.floor("rate").cast("long").alias("whole"), (F.col("rate") - F.floor("rate")).alias("chance"), F.pmod(F.xxhash64("key", F.lit(self.seed)), F.lit(buckets)).cast("int").alias("bucket"))
        level = materialize(rounded(rows, self.seed))
        done = level.where("chance = 0 or chance = 1")
        depth = 1
        while buckets > 1:
            buckets = math.ceil(buckets / fan_in)
            left = level.where("chance > 0 and chance < 1").withColumn("bucket", F.floor(F.col("bucket") / fan_in).cast("int"))
            level = materialize(rounded(left, self.seed + depth))
            done = done.union(level.where("chance = 0 or chance = 1"))
            depth += 1
        last = rounded(level.where("chance > 0 and chance < 1"), self.seed + depth, last=True)
        every = done.union(last)
        return materialize(every.select("mix", "source", "key", "tokens", (F.col("whole") + F.col("chance").cast("long")).alias("copies")).where("copies > 0"))

    def copies(self) -> DataFrame:
        return self.taken.select(F.col("mix").alias("mix_name"), "source", F.col("key").alias(self.key), F.col("tokens").alias("n_tokens"), "copies")

    def shares(self) -> DataFrame:
        reached = self.taken.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count(F.lit(1)).alias("records"), F.max("copies").alias("most_copies"))
        whole = reached.groupBy("mix").agg(F.sum("reached_tokens").alias("mix_tokens"))
        joined = self.plan.join(reached, ["mix", "source"], "left").join(whole, "mix", "left")
        zero = F.lit(0)
        return joined.select(
            F.col("mix").alias("mix_name"), "source", "weight", "max_repeats", F.col("tokens").alias("available_tokens"), F.col("budget").alias("budget_tokens"), F.col("target").alias("target_tokens"), F.col("wanted").alias("allotted_tokens"),
            F.coalesce("reached_tokens", zero).alias("reached_tokens"), F.coalesce("records", zero).alias("records"), F.coalesce("most_copies", zero).alias("most_copies"),
            F.when(F.col("budget") > 0, F.col("target") / F.col("budget")).alias("target_share"), F.when(F.col("mix_tokens") > 0, F.coalesce("reached_tokens", zero) / F.col("mix_tokens")).alias("reached_share"),
        )


def mixture(df: DataFrame, targets: DataFrame, key: str, source: str, tokens: Column, seed: int = 0, **settings) -> Mixture:
    """Mix the records of df for each mix of targets (mix_name, source, weight, max_repeats, budget_share).

    A mix's size is budget_share of the tokens of all records. Null keys and records without tokens are never taken,
    a null source belongs to no mix; a source that is absent or too small gives what it has, and the rest is shared out by
    weight; null or negative weights count as 0; keys are taken as unique, and repeated rows as records of their
    own; equal records are told apart by a seeded hash; empty tables give an empty result; other columns are ignored.
    The same input and seed give the same mixture, however the input is partitioned.
    """
    return Mixture(df, targets, key, source, tokens, seed, **settings)
