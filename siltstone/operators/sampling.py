"""Seeded samples, splits and mixes. The order is md5 of seed and id, so that each draw can be made again by any engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.distribution import seeded_order, seeded_uniform
from siltstone.operators.ranking import ranked

#: Rows up to which a sorted limit takes a sample; it brings them to one task.
SMALL_SAMPLE = 100_000
#: Ranks up to which the optimiser limits groups before the exchange.
GROUP_LIMIT = 1000


def uniform_sample(df: DataFrame, item: str, n: int, seed: int = 0) -> DataFrame:
    """n rows of all. A sorted limit keeps n rows a task, then n at the end; for a large n, ranks are made in ranges."""
    if n <= SMALL_SAMPLE:
        return df.orderBy(seeded_order(seed, item), item).limit(n)
    return ranked(df, [seeded_order(seed, item), item], name="__rank").where(F.col("__rank") <= n).drop("__rank")


def per_group_sample(df: DataFrame, groups: list[str], item: str, n: int | Column, seed: int = 0) -> DataFrame:
    """Up to n rows of each group."""
    w = Window.partitionBy(*groups).orderBy(seeded_order(seed, item), F.col(item))
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def stratified_sample(df: DataFrame, category: str, item: str, share: float | None = None, total: int | None = None, seed: int = 0) -> DataFrame:
    """Each category's floor of its share of the target; the target is a share of all rows or a number."""
    counts = df.groupBy(category).agg(F.count(F.lit(1)).alias("__n"))
    whole = df.count()
    target = total if total is not None else int(whole * share)
    quota = counts.select(F.col(category).alias("__c"), F.floor(F.lit(target) * F.col("__n") / max(whole, 1)).alias("__quota"))
    # large categories have large quotas: ranks are made in ranges
    ranks = ranked(df, [seeded_order(seed, item), item], category, "pick")
    return ranks.join(quota, F.col(category).eqNullSafe(F.col("__c"))).where(F.col("pick") <= F.col("__quota")).select(*df.columns, "pick")


def weighted_sample(df: DataFrame, groups: list[str], item: str, weight: str, n: int, seed: int = 0) -> DataFrame:
    """Up to n rows of each group without replacement, by weight (ln u / w, the greatest first). Rows of no weight come last."""
    u = (seeded_uniform(seed, item) * (1 << 28) + 1) / F.lit(float((1 << 28) + 1))
    key = F.when(F.col(weight) > 0, F.round(F.log(u) / F.col(weight), 9)).otherwise(F.lit(-1e300))
    w = Window.partitionBy(*groups).orderBy(key.desc(), F.col(item))
    return df.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= n)


def quotas(counts: dict[str, int], n: int, kinds: list[str]) -> dict[str, int]:
    """How many of each kind for n in all: equal shares, what a kind lacks shared out among the others."""
    given, open_ = dict.fromkeys(kinds, 0), list(kinds)
    while open_ and (left := n - sum(given.values())) > 0:
        share, more = divmod(left, len(open_))
        still = []
        for i, kind in enumerate(open_):
            ask = share + (i < more)
            take = min(ask, counts.get(kind, 0) - given[kind])
            given[kind] += take
            if take == ask and counts.get(kind, 0) > given[kind]:
                still.append(kind)
        if still == open_:
            break
        open_ = still
    return given


def balanced_sample(df: DataFrame, kind: str, item: str, n: int, kinds: list[str], seed: int = 0) -> DataFrame:
    """n rows balanced over a few kinds. Only the kinds' counts come to the driver."""
    counts = {r[0]: r[1] for r in df.where(F.col(kind).isin(kinds)).groupBy(kind).count().collect()}
    given = quotas(counts, n, kinds)
    quota = F.coalesce(*(F.when(F.col(kind) == k, F.lit(v)) for k, v in given.items()))
    most = max(given.values(), default=0)
    if most <= GROUP_LIMIT:  # a constant limit prunes before the exchange: of a kind of any size, each task sends so many rows
        return per_group_sample(df.where(F.col(kind).isin(kinds)), [kind], item, most, seed).where(F.col("pick") <= quota)
    # ranks made in ranges, so that no kind is sorted in one task
    return ranked(df.where(F.col(kind).isin(kinds)), [seeded_order(seed, item), item], kind, "pick").where(F.col("pick") <= quota)


def replicated_sample(df: DataFrame, category: str, item: str, n: int, seed: int = 0) -> DataFrame:
    """Exactly n rows of each category, its rows in turn again where it has fewer: df's columns, pick, copy."""
    w = Window.partitionBy(category)
    ranked = df.withColumn("pick", F.row_number().over(w.orderBy(seeded_order(seed, item), F.col(item)))).where(F.col("pick") <= n)
    sized = ranked.withColumn("__n", F.count(F.lit(1)).over(w))
    copies = F.floor((n - F.col("pick")) / F.col("__n")) + 1
    return sized.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), copies))).drop("__n")


def train_val_split(df: DataFrame, flag: str, item: str, share: float = 0.2, val_ratio: int = 3, train_ratio: int = 10, seed: int = 0) -> DataFrame:
    """df with part: val has the share of the flagged rows (one at least) and up to val_ratio times as many others, but a fifth of
    them at most; train has the other flagged rows and up to train_ratio times as many others; the rest is unused."""
    flagged, others = df.agg(F.count_if(F.col(flag)), F.count_if(~F.col(flag))).first()
    val_flagged = max(1, int(flagged * share)) if flagged else 0
    val_others = min(val_flagged * val_ratio, others // 5)
    train_others = (flagged - val_flagged) * train_ratio
    part = F.when(F.col(flag), F.when(F.col("pick") <= val_flagged, "val").otherwise("train")).otherwise(
        F.when(F.col("pick") <= val_others, "val").when(F.col("pick") <= val_others + train_others, "train").otherwise("unused")
    )
    return ranked(df, [seeded_order(seed, item), item], flag, "pick").withColumn("part", part).drop("pick")


def class_ratio_downsample(df: DataFrame, flag: str, item: str, ratio: float, seed: int = 0) -> DataFrame:
    """All flagged rows and up to ratio times as many others."""
    most = int(df.agg(F.count_if(F.col(flag))).first()[0] * ratio)
    ranks = ranked(df, [seeded_order(seed, item), item], flag, "pick")
    return ranks.where(F.col(flag) | (F.col("pick") <= most)).drop("pick")


def half_split(df: DataFrame, item: str, size: int, seed: int = 66) -> DataFrame:
    """Distinct items with half: first for the first size in seeded order, else second."""
    chosen = uniform_sample(df.select(item).distinct(), item, size, seed).withColumn("__c", F.lit(True))
    return df.select(item).distinct().join(chosen, item, "left").select(item, F.when(F.col("__c"), "first").otherwise("second").alias("half"))


def interleaved(few: DataFrame, many: DataFrame, item: str, ratio: int, seed: int = 0) -> DataFrame:
    """All of few and ratio times as many of many, in seeded order: (part, item, order)."""
    cut = uniform_sample(many.select(item), item, few.count() * ratio, seed)
    both = few.select(F.lit("few").alias("part"), F.col(item)).unionByName(cut.select(F.lit("many").alias("part"), F.col(item)))
    return both.withColumn("order", seeded_order(seed + 1, "part", item))


def exact_copies(df: DataFrame, task: str, prefer: str, order: str, n: int) -> DataFrame:
    """One row a task, those that prefer holds for first, n times over: df's columns and copy."""
    from siltstone.operators.dedup import keep_first

    ranked = df.withColumn("__p", F.when(F.col(prefer), 0).otherwise(1))
    return keep_first(ranked, [task], ["__p", order]).drop("__p").withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(n))))
