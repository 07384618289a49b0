"""Running sums and ranks that no single task makes: rows are sorted in ranges, and each range starts at the sum of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.runtime import materialize


def running_offsets(df: DataFrame, order: str | list[str | Column], size: str | Column, group: str | None = None) -> DataFrame:
    """df with start: the sizes before each row in order, within its group.

    Ranges are cut by group and order, so that a group of any size is spread. Their sums are a row a range and group; the
    rows are written once, since both the sums and the offsets read them."""
    order = order if isinstance(order, list) else [order]
    keys = [group] if group else []
    named = {f"__o{i}": F.col(o) if isinstance(o, str) else o for i, o in enumerate(order)}
    columns = df.columns
    parts = df.withColumns(named | {"__size": F.col(size) if isinstance(size, str) else size})
    parts = materialize(parts.repartitionByRange(*keys, *named).withColumn("__part", F.spark_partition_id()))
    sums = parts.groupBy("__part", *keys).agg(F.sum("__size").alias("__s"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__part", *keys, F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__before"))
    if keys:  # a null group meets itself
        offsets = offsets.withColumnRenamed(group, "__group")
    within = Window.partitionBy("__part", *keys).orderBy(*named).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.withColumn("__within", F.coalesce(F.sum("__size").over(within), F.lit(0)))
    meets = (summed["__part"] == offsets["__part"]) & (summed[group].eqNullSafe(offsets["__group"]) if keys else F.lit(True))
    return summed.join(offsets, meets).select(*(summed[c] for c in columns), (F.col("__before") + F.col("__within")).alias("start"))


def ranked(df: DataFrame, order: list[str | Column], group: str | None = None, name: str = "rank") -> DataFrame:
    """df with its place from 1 on in the order, within its group. The order must be total."""
    return running_offsets(df, order, F.lit(1), group).withColumn(name, (F.col("start") + 1).cast("long")).drop("start")


def pick_until_budget(df: DataFrame, order: str, size: str, budget: int, group: str | None = None) -> DataFrame:
    """Rows in order while the sizes before them stay under the budget."""
    return running_offsets(df, order, size, group).where(F.col("start") < budget)
