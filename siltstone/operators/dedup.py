"""Exact and key-based removal of duplicates, and set operations on keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key by order. One pre-aggregating pass: of a hot key, each task sends one row."""
    ordered = F.struct(*(F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)))
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*(F.col(c) for c in df.columns)), ordered).alias("__row"))
    return picked.select("__row.*")


def digest(*columns: str | Column) -> Column:
    """128 bits by which rows of equal values meet, in place of the values themselves: long texts needn't be shuffled."""
    got = F.to_json(F.struct(*(F.col(c).alias(f"c{i}") if isinstance(c, str) else c.alias(f"c{i}") for i, c in enumerate(columns))))
    return F.unhex(F.md5(got))


def first_keys(df: DataFrame, value: str | Column, key: str) -> DataFrame:
    """(key) of the first row of each distinct value. A digest and the least key are all that is shuffled."""
    return df.groupBy(digest(value).alias("__d")).agg(F.min(key).alias(key)).select(key)


def merge_unseen(known: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """known, and of new the rows with keys that known lacks, once each."""
    fresh = keep_first(new, keys, order).join(known.select(*keys).distinct(), keys, "left_anti")
    return known.unionByName(fresh, allowMissingColumns=True)


def without_done(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that weren't processed yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def overlaps(sets: dict[str, DataFrame], key: str) -> DataFrame:
    """(a, b, size_a, size_b, common, pct_of_smaller) of every two of a few named sets.

    Each key becomes one row with a flag a set, and all counts come from one aggregation: no set meets another in a join.
    """
    names = sorted(sets)
    tagged = reduce(DataFrame.unionByName, (sets[n].select(F.col(key).alias("k")).distinct().withColumn("s", F.lit(n)) for n in names))
    flags = tagged.groupBy("k").agg(*(F.max(F.when(F.col("s") == n, 1).otherwise(0)).alias(f"f{i}") for i, n in enumerate(names)))
    sizes = [F.sum(f"f{i}").alias(f"n{i}") for i in range(len(names))]
    common = [F.sum(F.col(f"f{i}") * F.col(f"f{j}")).alias(f"c{i}_{j}") for i in range(len(names)) for j in range(i + 1, len(names))]
    row = flags.agg(*sizes, *common)
    made = [
        F.struct(F.lit(names[i]).alias("a"), F.lit(names[j]).alias("b"), F.coalesce(F.col(f"n{i}"), F.lit(0)).alias("size_a"), F.coalesce(F.col(f"n{j}"), F.lit(0)).alias("size_b"), F.coalesce(F.col(f"c{i}_{j}"), F.lit(0)).alias("common"))
        for i in range(len(names))
        for j in range(i + 1, len(names))
    ]
    out = row.select(F.explode(F.array(*made)).alias("x")).select("x.*")
    smaller = F.least("size_a", "size_b")
    return out.withColumn("pct_of_smaller", F.when(smaller > 0, 100 * F.col("common") / smaller).otherwise(0.0))
