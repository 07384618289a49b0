"""Pairs of the members of classes, made block by block: neither a class nor a pair of classes is one task, however many members it has."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.runtime import small_side

#: Members of a class in one block.
BLOCK = 512


def in_blocks(members: DataFrame, block: int = BLOCK) -> DataFrame:
    """members (cls, key, ...) with m, the class's members, blk, the member's block, and blks, the class's blocks. Counted by pre-aggregation."""
    sizes = members.groupBy("cls").agg(F.count(F.lit(1)).alias("m"))
    large = sizes.where(F.col("m") > block).withColumn("blks", F.ceil(F.col("m") / block).cast("int")).select("cls", "blks")
    # few classes are large; where their list is small, no member is shuffled
    known = members.join(small_side(large), "cls", "left").withColumn("blks", F.coalesce("blks", F.lit(1)))
    return known.withColumn("blk", F.when(F.col("blks") == 1, 0).otherwise(F.pmod(F.xxhash64("key"), F.col("blks").cast("long"))).cast("int"))


def pairs_within(placed: DataFrame) -> DataFrame:
    """(ka, kb), ka < kb, of every two keys of a class. placed: members in blocks, each key once in a class."""
    several = placed.groupBy("cls").agg(F.count(F.lit(1)).alias("m"), F.first("blks").alias("blks")).where("m > 1")
    number = lambda upto: F.explode(F.sequence(F.lit(0), upto))
    grid = several.select("cls", "blks", number(F.col("blks") - 1).alias("x")).select("cls", "x", number(F.col("x")).alias("y"))
    left = placed.select("cls", F.col("blk").alias("x"), F.col("key").alias("p"))
    right = placed.select("cls", F.col("blk").alias("y"), F.col("key").alias("q"))
    met = grid.join(left, ["cls", "x"]).join(right, ["cls", "y"]).where((F.col("x") != F.col("y")) | (F.col("p") < F.col("q")))
    return met.select(F.least("p", "q").alias("ka"), F.greatest("p", "q").alias("kb"))


def pairs_across(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(ka, kb, rest of links), ka < kb, of every key of one class with every key of the other. links: a, b, two different classes, once; placed: members in blocks."""
    rest = [c for c in links.columns if c not in ("a", "b")]
    sizes = placed.groupBy("cls").agg(F.first("blks").alias("blks"))
    number = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    sized = links.join(sizes.select(F.col("cls").alias("a"), F.col("blks").alias("na")), "a").join(sizes.select(F.col("cls").alias("b"), F.col("blks").alias("nb")), "b")
    grid = sized.select("a", "b", *rest, "nb", number("na").alias("x")).select("a", "b", *rest, "x", number("nb").alias("y"))
    left = placed.select(F.col("cls").alias("a"), F.col("blk").alias("x"), F.col("key").alias("p"))
    right = placed.select(F.col("cls").alias("b"), F.col("blk").alias("y"), F.col("key").alias("q"))
    met = grid.join(left, ["a", "x"]).join(right, ["b", "y"])
    return met.select(F.least("p", "q").alias("ka"), F.greatest("p", "q").alias("kb"), *rest)
