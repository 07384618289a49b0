"""Statistics of scores: moments, histograms, thresholds, distribution functions and samples above them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERCENTS = (50.0, 75.0, 90.0, 95.0, 99.0, 99.9)
LEVELS = (0.7, 0.8, 0.9, 0.95, 0.99)


def seeded_order(seed: int | str, *ids: str) -> Column:
    """A key for a pseudo-random order that any engine can recompute: md5 of the seed and the ids."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(i).cast("string") for i in ids)))


def seeded_uniform(seed: int | str, *ids: str) -> Column:
    """A number in [0, 1) from the first 28 bits of the key."""
    return F.conv(F.substring(seeded_order(seed, *ids), 1, 7), 16, 10).cast("double") / F.lit(float(1 << 28))


def score_stats(df: DataFrame, group: str, score: str = "score") -> DataFrame:
    s = F.col(score)
    return df.groupBy(group).agg(
        F.max(s).alias("max_score"), F.min(s).alias("min_score"), F.avg(s).alias("mean_score"),
        F.stddev_pop(s).alias("std_score"), F.percentile(s, F.lit(0.5)).alias("median_score"), F.count(s).alias("n"),
    )


def cut_scores(ranked: DataFrame, group: str, cuts: tuple[int, ...] = (1, 10, 50, 100), rank: str = "rank", score: str = "score") -> DataFrame:
    """The score at each rank of cuts; null where a group has fewer."""
    return ranked.groupBy(group).agg(*(F.max(F.when(F.col(rank) == k, F.col(score))).alias(f"top_{k}") for k in cuts))


def percentiles(df: DataFrame, group: str, score: str = "score", percents: tuple[float, ...] = PERCENTS) -> DataFrame:
    names = [f"p{str(p).rstrip('0').rstrip('.').replace('.', '_')}" for p in percents]
    got = df.groupBy(group).agg(F.percentile(score, F.array(*(F.lit(p / 100) for p in percents))).alias("p"))
    return got.select(group, *(F.col("p")[i].alias(n) for i, n in enumerate(names)))


def level_rates(df: DataFrame, group: str, score: str = "score", levels: tuple[float, ...] = LEVELS) -> DataFrame:
    n = F.count(F.lit(1)).cast("double")
    cols = []
    for level in levels:
        name = f"{round(level * 100)}"
        hits = F.count_if(F.col(score) >= level)
        cols += [hits.alias(f"n_{name}"), (hits * 100 / n).alias(f"pct_{name}")]
    return df.groupBy(group).agg(*cols)


def histogram(df: DataFrame, score: str, low: float, high: float, bins: int, group: str | None = None, clip: bool = True, weight: float = 1.0) -> DataFrame:
    """(group, bin, n, weighted): equal widths, the last bin closed. Outside values go to the edge bins, or are left out."""
    width = (high - low) / bins
    place = F.floor((F.col(score) - low) / width)
    kept = df if clip else df.where(F.col(score).between(low, high))
    numbered = kept.withColumn("bin", F.least(F.greatest(place, F.lit(0)), F.lit(bins - 1)).cast("int"))
    keys = [group, "bin"] if group else ["bin"]
    return numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("weighted", F.col("n") * F.lit(weight))


def histogram_threshold(df: DataFrame, group: str, score: str, percent: float, low: float = -1.0, high: float = 1.0, bins: int = 10_000) -> DataFrame:
    """Middle of the highest bin at which the counts from above reach the share above percent: (group, total, wanted, threshold).
    Values outside count in the total only."""
    total = df.groupBy(group).agg(F.count(F.lit(1)).alias("total"))
    counts = histogram(df, score, low, high, bins, group, clip=False)
    return counts_threshold(counts, total, group, percent, low, high, bins)


def counts_threshold(counts: DataFrame, total: DataFrame, group: str, percent: float, low: float, high: float, bins: int) -> DataFrame:
    """The same from counts (group, bin, n) and totals (group, total)."""
    above = Window.partitionBy(group).orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    summed = counts.withColumn("above", F.sum("n").over(above)).join(total, group)
    wanted = F.floor(F.col("total") * F.lit(1 - percent / 100)).cast("long")
    reached = summed.where(F.col("above") >= wanted).groupBy(group, "total").agg(F.max("bin").alias("bin"))
    width = (high - low) / bins
    return reached.select(group, "total", wanted.alias("wanted"), (F.lit(low) + (F.col("bin") + 0.5) * width).alias("threshold"))


def empirical_cdf(df: DataFrame, score: str, group: str) -> DataFrame:
    """(group, score, cdf): for each distinct score the share at or under it. Counts are aggregated before the running sum."""
    counts = df.groupBy(group, score).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    upto = F.sum("n").over(w.orderBy(score).rowsBetween(Window.unboundedPreceding, 0))
    return counts.select(group, score, (upto / F.sum("n").over(w)).alias("cdf"))


def sample_above(df: DataFrame, group: str, item: str, score: str, n: int, percent: float | None = 99.0, fixed: float | None = None, seed: int = 0) -> DataFrame:
    """Up to n rows of each group at or above its percentile (or a fixed score), in seeded order."""
    if fixed is None:
        cut = df.groupBy(group).agg(F.percentile(score, F.lit(percent / 100)).alias("cut"))
        kept = df.join(cut, group).where(F.col(score) >= F.col("cut"))
    else:
        kept = df.where(F.col(score) >= fixed).withColumn("cut", F.lit(fixed))
    w = Window.partitionBy(group).orderBy(seeded_order(seed, group, item), F.col(item))
    return kept.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def percentile_of(values: DataFrame, background: DataFrame, value: str, score: str, group: str) -> DataFrame:
    """values with pct: the share in percent of the group's background strictly below value; NaN isn't counted; 0 where there is none.

    The background becomes counts of distinct scores with running sums; each value is then looked up by rank in the
    union of both, which is one sort a group and no join of all pairs."""
    clean = background.where(F.col(score).isNotNull() & ~F.isnan(score))
    counts = clean.groupBy(group, F.col(score).alias("__x")).agg(F.count(F.lit(1)).alias("__n")).withColumn("__own", F.lit(None).cast("string"))
    asked = values.select(group, F.col(value).alias("__x"), F.lit(0).cast("long").alias("__n"), F.to_json(F.struct(*values.columns)).alias("__own"))
    # of one score, the values asked for come before the background
    w = Window.partitionBy(group).orderBy(F.col("__x"), F.col("__own").isNull())
    below = F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("__n").over(Window.partitionBy(group))
    seen = counts.unionByName(asked).withColumn("pct", F.when(total > 0, 100 * below / total).otherwise(0.0)).where(F.col("__own").isNotNull())
    return seen.select(F.from_json("__own", values.schema).alias("v"), "pct").select("v.*", "pct")
