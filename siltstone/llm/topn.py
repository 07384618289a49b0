"""Problem 1: the N highest-scoring items of every group, in one settled order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clean_key(column: str | Column) -> Column:
    """Outer white space removed, lower case."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.regexp_replace(c, r"^[\s ]+|[\s ]+$", ""))


def top_n_per_group(df: DataFrame, groups: list[str], item: str, score: str, n: int = 10, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """The first n items of each group by score descending, then item ascending, as groups + item, score and rank.

    An item counts once in its group, with its highest score: an aggregation with a map-side part, on the whole
    key, so that a group of any size is spread. row_number <= n then plans as a group limit before and after
    the exchange: of a hot group, each task sends n rows.

    Null, NaN or out-of-range scores and null items don't count; null group keys form a group of their own;
    repeated rows count once; equal scores are ordered by item; an empty table gives an empty result; other columns are ignored.
    """
    keys = [F.col(f"`{g}`").alias(g) for g in groups]
    usable = df.select(*keys, F.col(f"`{item}`").alias("__item"), F.col(f"`{score}`").cast("double").alias("__score")).where(
        F.col("__item").isNotNull() & F.col("__score").isNotNull() & ~F.isnan("__score") & F.col("__score").between(low, high)
    )
    best = usable.groupBy(*groups, "__item").agg(F.max("__score").alias("__score"))
    order = Window.partitionBy(*groups).orderBy(F.col("__score").desc(), F.col("__item").asc())
    ranked = best.withColumn("__rank", F.row_number().over(order)).where(F.col("__rank") <= n)
    return ranked.select(*groups, F.col("__item").alias(item), F.col("__score").alias(score), F.col("__rank").alias("rank"))
