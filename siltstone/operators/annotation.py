"""Analytics of labelled pairs: rates with intervals, bins, occurrence, depth, agreement, verdicts and validation."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.statistics import t_two_sided

# Kinds of match, those that count as semantic and as strong duplicates.
MATCH_TYPES = ("exact", "equivalent", "subset", "superset", "related", "unrelated")
SEMANTIC = ("equivalent", "subset", "superset")
STRONG = ("exact", *SEMANTIC)
Z = 1.96
ERROR_BLANK = "coalesce(trim(error), '') = ''"


def as_boolean(c: Column) -> Column:
    """Whether a value, as text without outer blanks, is true."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))) == "true", F.lit(False))


def tidy(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(F.trim(c))


def semantic_flags(df: DataFrame, flag: str, kind: str) -> DataFrame:
    """The flag kept as <flag>_with_exact, and narrowed to semantic kinds."""
    return df.withColumn(f"{flag}_with_exact", F.col(flag)).withColumn(flag, F.coalesce(F.col(flag) & F.col(kind).isin(*SEMANTIC), F.lit(False)))


def one(flag: str | Column) -> Column:
    return F.coalesce((F.col(flag) if isinstance(flag, str) else flag).cast("int"), F.lit(0))


def duplicate_rate(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(one(flag)).alias("dups"), (F.sum(one(flag)) / F.count(F.lit(1))).alias("rate"))


def box_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    cut = F.percentile(value, F.array(*map(F.lit, (0.05, 0.25, 0.5, 0.75, 0.95))))
    got = df.groupBy(key).agg(F.avg(value).alias("mean"), cut.alias("c"), F.count(value).alias("n"))
    return got.select(key, "n", "mean", *(F.col("c")[i].alias(p) for i, p in enumerate(("p5", "q1", "median", "q3", "p95"))))


def with_normal_interval(df: DataFrame, hits: str, n: str, clip: bool = False) -> DataFrame:
    rate = F.col(hits) / F.col(n)
    half = Z * F.sqrt(rate * (1 - rate) / F.col(n))
    low, high = rate - half, rate + half
    if clip:
        low, high = F.greatest(F.lit(0.0), low), F.least(F.lit(1.0), high)
    return df.withColumns({"rate": rate, "low": low, "high": high})


def wilson(hits: Column, n: Column) -> tuple[Column, Column]:
    """Wilson's interval within [0, 1]; both ends 0 without trials."""
    p = hits / n
    middle = (p + Z * Z / (2 * n)) / (1 + Z * Z / n)
    half = Z * F.sqrt(p * (1 - p) / n + Z * Z / (4 * n * n)) / (1 + Z * Z / n)
    ends = (F.greatest(F.lit(0.0), middle - half), F.least(F.lit(1.0), middle + half))
    return tuple(F.when(n == 0, 0.0).otherwise(e) for e in ends)


def equal_width_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """df with bin from 1 on and its middle: right-closed bins between the least and the greatest value, which is read in a pass of its own and never shuffles df."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.withColumns({"bin": F.lit(None).cast("int"), "middle": F.lit(None).cast("double")})
    width = (high - low) / bins
    number = F.lit(1) if width == 0 else F.least(F.lit(bins), F.greatest(F.lit(1), F.ceil((F.col(value) - low) / width)))
    numbered = df.withColumn("bin", F.when(F.col(value).isNotNull(), number).cast("int"))
    return numbered.withColumn("middle", F.lit(low) + (F.col("bin") - 0.5) * F.lit(width))


def fixed_bins(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """df with bin 1 to bins of right-closed equal widths; values outside are dropped."""
    width = (high - low) / bins
    return df.withColumn("bin", F.ceil((F.col(value) - low) / width).cast("int")).where(F.col("bin").between(1, bins))


def binned_rate(df: DataFrame, flag: str, clip: bool = False, *keys: str) -> DataFrame:
    return with_normal_interval(df.groupBy("bin", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(one(flag)).alias("dups")), "dups", "n", clip)


def occurrence_rate(df: DataFrame, group: str, item: str, flag: str) -> DataFrame:
    """Share of the group's items with at least one flagged row."""
    items = df.groupBy(group, item).agg(F.max(one(flag)).alias("has"))
    return with_normal_interval(items.groupBy(group).agg(F.count(F.lit(1)).alias("items"), F.sum("has").alias("with_dup")), "with_dup", "items", True)


def depth_scaling(df: DataFrame, group: str, item: str, score: str, flag: str, order: str, depths: tuple[int, ...] = (1, 10, 100, 500)) -> DataFrame:
    """For each depth d, the share of items with a flagged row among their d best, with Wilson's interval.

    Only the rank of each item's first flagged row is needed. Ranks need the whole item in one task, so items beyond the
    deepest cut are first limited to it by the group limit before and after the exchange."""
    w = Window.partitionBy(group, item).orderBy(F.col(score).desc(), F.col(order))
    ranked = df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= max(depths))
    first = ranked.groupBy(group, item).agg(F.min(F.when(F.col(flag), F.col("__rank"))).alias("first"))
    each = first.withColumn("depth", F.explode(F.array(*map(F.lit, depths))))
    got = each.groupBy(group, "depth").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("first") <= F.col("depth")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("items"))
    return got.withColumns({"rate": F.col("hits") / F.col("items"), "low": low, "high": high})


def regression(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row: slope, intercept, correlation with its two-sided p by the t distribution, and rows. p is null for fewer than three rows or without spread."""
    fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.try_divide(F.covar_pop(x, y), F.stddev_pop(F.when(F.col(y).isNotNull(), F.col(x))) * F.stddev_pop(F.when(F.col(x).isNotNull(), F.col(y)))).alias("r"), F.count(F.lit(1)).alias("n"))

    @F.pandas_udf("double")
    def two_sided(r: pd.Series, n: pd.Series) -> pd.Series:
        t = [math.inf if abs(a) >= 1 else abs(a) * math.sqrt((m - 2) / (1 - a * a)) for a, m in zip(r, n, strict=True)]
        return pd.Series([0.0 if math.isinf(v) else t_two_sided(v, m - 2) for v, m in zip(t, n, strict=True)], dtype="float64")

    usable = F.col("r").isNotNull() & ~F.isnan("r") & (F.col("n") > 2)
    return fit.withColumn("p", F.when(usable, two_sided(F.coalesce("r", F.lit(0.0)), F.greatest("n", F.lit(3)))))


def demoted(df: DataFrame, flag: str, reason: Column) -> DataFrame:
    """df with refine_reason, and the flag taken back where there is a reason; demoted tells which rows lost it."""
    told = df.withColumn("refine_reason", reason)
    lost = F.coalesce(F.col(flag), F.lit(False)) & (F.col("refine_reason") != "")
    return told.withColumn("demoted", lost).withColumn(flag, F.coalesce(F.col(flag), F.lit(False)) & ~lost)


def readable_pairs(df: DataFrame, kind: str, first: str, second: str) -> DataFrame:
    """Rows of any kind but unrelated of which both texts say something."""
    said = lambda c: F.coalesce(F.trim(F.regexp_replace(F.col(c), r"(?U)\s+", " ")) != "", F.lit(False))
    return df.where((tidy(kind) != "unrelated") & said(first) & said(second))


def of_stages(df: DataFrame, stage: str, stages: list[str], order: str = "stage_order") -> DataFrame:
    """Rows of the stages listed, with the place of each in the list, so that reports keep its order."""
    place = F.array_position(F.array(*map(F.lit, stages)), F.col(stage)).cast("int")
    return df.where(F.col(stage).isin(stages)).withColumn(order, place)


def grid_complexity(rows: Column, cols: Column) -> Column:
    """Order of grids: by their cells."""
    return rows * cols


def export_statistics(df: DataFrame) -> DataFrame:
    """One row: successes, duplicates, tests affected, range of confidence (of those over 0) and score. Denominators are 1 at least."""
    ok = F.col("success")
    dup = ok & F.coalesce(F.col("is_sd"), F.lit(False))
    sure = F.when(ok & (F.col("confidence") > 0), F.col("confidence"))
    score = F.when(ok & ~F.isnan("score"), F.col("score"))
    return df.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("succeeded"), F.count_if(~ok).alias("failed"), F.count_if(dup).alias("duplicates"),
        (F.count_if(dup) / F.greatest(F.count_if(ok), F.lit(1))).alias("dup_rate"), F.countDistinct(F.when(dup, F.col("test_id"))).alias("tests_affected"),
        F.avg(sure).alias("mean_confidence"), F.min(sure).alias("min_confidence"), F.max(sure).alias("max_confidence"), F.min(score).alias("min_score"), F.max(score).alias("max_score"),
    )


def type_counts(df: DataFrame, group: str, kind: str, kinds: tuple[str, ...] = MATCH_TYPES) -> DataFrame:
    """Rows of each kind as columns, 0 where there are none, and the share that isn't unrelated."""
    counted = df.groupBy(group).agg(*(F.count_if(F.col(kind) == k).alias(k) for k in kinds), F.count(kind).alias("n"))
    return counted.withColumn("sd_rate", (F.col("n") - F.col("unrelated")) / F.greatest(F.col("n"), F.lit(1)))


def label_counts(df: DataFrame, item: str, label: str) -> DataFrame:
    return df.groupBy(item, label).agg(F.count(F.lit(1)).alias("c"))


def fleiss_kappa(counts: DataFrame, item: str, label: str, raters: int) -> DataFrame:
    """Fleiss' kappa over the items with exactly this many labels; null for fewer than two raters or where chance agreement is whole."""
    full = counts.groupBy(item).agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("sq")).where(F.col("m") == raters)
    agreed = full.agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("sq") - raters) / F.lit(float(max(1, raters * (raters - 1))))).alias("observed"))
    shares = counts.join(full.select(item), item, "left_semi").groupBy(label).agg(F.sum("c").alias("c"))
    chance = shares.agg(F.sum(F.col("c") * F.col("c")).alias("sq"), F.sum("c").alias("all"))
    both = agreed.withColumn("k", F.lit(1)).join(chance.withColumn("k", F.lit(1)), "k")
    expected = F.col("sq") / (F.col("all") * F.col("all")).cast("double")
    return both.select("items", "observed", expected.alias("expected"), F.when((F.lit(raters) >= 2) & (expected < 1), (F.col("observed") - expected) / (1 - expected)).alias("kappa"))


def modal_agreement(counts: DataFrame, item: str, label: str) -> DataFrame:
    """Most frequent label of each item (of equals the first in order), its share, distinct labels, the distribution as text, and the share of agreeing pairs."""
    listed = counts.groupBy(item).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("labels"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.sort_array(F.collect_list(F.struct((-F.col("c")).alias("c"), F.col(label).alias("l")))).alias("d"))
    text = F.array_join(F.transform("d", lambda x: F.concat(x["l"], F.lit(":"), (-x["c"]).cast("string"))), ",")
    pairs = F.when(F.col("n") > 1, F.col("same") / (F.col("n") * (F.col("n") - 1)))
    return listed.select(item, F.col("d")[0]["l"].alias("mode"), (-F.col("d")[0]["c"] / F.col("n")).alias("mode_share"), "labels", "n", text.alias("distribution"), pairs.alias("pair_agreement"))


def coalesced_verdicts(rows: DataFrame, first: DataFrame, second: DataFrame, keys: list[str], verdict: str, kind: str, keep: tuple[str, ...] = ("exact",), refine: tuple[str, ...] = SEMANTIC, override: bool = False) -> DataFrame:
    """rows with final: true for the kinds kept as they are; for those refined the first verdict, else the second, else false;
    false for any other. With override any row that has a verdict takes it."""
    a = first.groupBy(*keys).agg(F.max(verdict).alias("__a"))
    b = second.groupBy(*keys).agg(F.max(verdict).alias("__b"))
    both = rows.join(a, keys, "left").join(b, keys, "left")
    said = F.coalesce("__a", "__b")
    final = F.when(F.col(kind).isin(*keep), True).when(F.col(kind).isin(*refine), F.coalesce(said, F.lit(False))).otherwise(False)
    if override:
        final = F.coalesce(said, final)
    return both.withColumn("final", final).drop("__a", "__b")


def label_agreement(a: DataFrame, b: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Rows that both sets label, how many agree, and conflicts each way."""
    both = a.select(*keys, F.col(label).alias("x")).join(b.select(*keys, F.col(label).alias("y")), keys)
    return both.agg(F.count(F.lit(1)).alias("overlap"), F.count_if(F.col("x") == F.col("y")).alias("agree"), F.count_if(F.col("x") & ~F.col("y")).alias("only_first"), F.count_if(~F.col("x") & F.col("y")).alias("only_second"))


def validation_issues(df: DataFrame, kinds: tuple[str, ...] = MATCH_TYPES) -> DataFrame:
    """(issue, n): failures of each rule over all rows; a row may break several."""
    kind = tidy("match_type")
    rules = {
        "confidence_out_of_range": F.coalesce(~F.col("confidence").between(0, 1), F.lit(False)),
        "score_out_of_range": F.coalesce(F.isnan("score") | ~F.col("score").between(0, 1), F.lit(False)),
        "missing_score": F.col("score").isNull(),
        "missing_label": F.col("success") & F.col("is_sd").isNull(),
        "unknown_match_type": F.coalesce(~kind.isin(*kinds), F.lit(False)),
        "missing_test_text": F.coalesce(F.trim("test_text") == "", F.lit(True)),
        "failed_without_error": ~F.col("success") & (F.coalesce(F.trim("error"), F.lit("")) == ""),
        "contradicting_flag": F.coalesce(F.col("is_sd") != (kind != "unrelated"), F.lit(False)),
    }
    broken = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    single = df.select(F.explode(broken).alias("issue"))
    keys = df.groupBy("dataset", "test_id", "corpus_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select(F.lit("duplicate_key").alias("issue"))
    return single.union(keys).groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
