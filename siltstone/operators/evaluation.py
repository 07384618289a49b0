"""Statistics of evaluations: pass rates, classification, paired comparison of arms and significance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import statistics as st


def pass_rates(df: DataFrame, keys: list[str], correct: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(F.col(correct).cast("double")).alias("pass_rate"), F.sum(F.col(correct).cast("int")).alias("n_correct"), F.count(correct).alias("n_samples"))


def pass_at_k(df: DataFrame, arm: str, task: str, correct: str) -> DataFrame:
    """Share of tasks with any and with only correct trials."""
    tasks = df.groupBy(arm, task).agg(F.max(F.col(correct).cast("int")).alias("any"), F.min(F.col(correct).cast("int")).alias("all"))
    return tasks.groupBy(arm).agg(F.avg("any").alias("pass_any"), F.avg("all").alias("pass_all"), F.count(F.lit(1)).alias("tasks"))


def binomial_se(p: Column, n: Column) -> Column:
    return F.when(n > 0, F.sqrt(p * (1 - p) / n))


def split_scores(rates: DataFrame, arm: str, split: str, rate: str, baseline: str) -> DataFrame:
    """Mean rate of each arm and split with its standard error, and the difference to the baseline arm with its own."""
    scored = rates.groupBy(arm, split).agg(F.avg(rate).alias("mean"), F.count(F.lit(1)).alias("n")).withColumn("se", binomial_se(F.col("mean"), F.col("n")))
    base = scored.where(F.col(arm) == baseline).select(split, F.col("mean").alias("__m"), F.col("se").alias("__s"))
    joined = scored.join(F.broadcast(base), split, "left")  # one row a split
    return joined.withColumns({"delta": F.col("mean") - F.col("__m"), "delta_se": F.sqrt(F.col("se") ** 2 + F.col("__s") ** 2)}).drop("__m", "__s")


def classification(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion counts and the measures on them; 0 where a denominator is."""
    t, p = F.col(truth), F.col(predicted)
    counts = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    c = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn")}
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    precision, recall = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    other_precision, other_recall = ratio(c["tn"], c["tn"] + c["fn"]), ratio(c["tn"], c["tn"] + c["fp"])
    f1, other_f1 = ratio(2 * precision * recall, precision + recall), ratio(2 * other_precision * other_recall, other_precision + other_recall)
    mcc = ratio(c["tp"] * c["tn"] - c["fp"] * c["fn"], F.sqrt((c["tp"] + c["fp"]) * (c["tp"] + c["fn"]) * (c["tn"] + c["fp"]) * (c["tn"] + c["fn"])))
    accuracy = ratio(c["tp"] + c["tn"], c["tp"] + c["fp"] + c["fn"] + c["tn"])
    return counts.select("tp", "fp", "fn", "tn", accuracy.alias("accuracy"), ((recall + other_recall) / 2).alias("balanced_accuracy"), precision.alias("precision_1"), recall.alias("recall_1"), f1.alias("f1_1"), other_precision.alias("precision_0"), other_recall.alias("recall_0"), other_f1.alias("f1_0"), ((f1 + other_f1) / 2).alias("macro_f1"), mcc.alias("mcc"))


def paired(df: DataFrame, arm: str, sample: str, value: str, a: str, b: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, sample, a, b) of the samples that both arms have. One aggregation, no join of the arms."""
    got = df.where(F.col(arm).isin(a, b)).groupBy(*keys, sample).agg(F.max(F.when(F.col(arm) == a, F.col(value))).alias("a"), F.max(F.when(F.col(arm) == b, F.col(value))).alias("b"))
    return got.where("a is not null and b is not null")


def paired_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Differences' mean, deviation and t statistic, in the JVM."""
    d = F.col("a") - F.col("b")
    out = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg(d).alias("diff"), F.stddev_samp(d).alias("sd"))
    return out.withColumn("t", F.when(F.col("sd") > 0, F.col("diff") / (F.col("sd") / F.sqrt("n"))))


def signed_ranks(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums of the ranks of positive and negative differences, average ranks for ties, zeros left out. Ranks come from counts of
    equal sizes, so that the window sees a row a distinct size, not a row a pair."""
    d = F.round(F.col("a") - F.col("b"), 12)
    sized = pairs.select(*keys, d.alias("d")).where("d <> 0").groupBy(*keys, F.abs("d").alias("size")).agg(F.count(F.lit(1)).alias("c"), F.count_if(F.col("d") > 0).alias("plus"))
    w = Window.partitionBy(*keys).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sized.withColumn("rank", F.coalesce(F.sum("c").over(w), F.lit(0)) + (F.col("c") + 1) / 2)
    return ranked.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("rank") * F.col("plus")).alias("w_plus"), F.sum(F.col("rank") * (F.col("c") - F.col("plus"))).alias("w_minus"))


def significance_stars(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p), "").when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def epoch_of(checkpoint: str, step: int = 167, final: int | Column | None = None) -> Column:
    """Epoch of a checkpoint column: a number, alone or behind `checkpoint-`, over step, halves to even. `final` is the epoch given for it, else null as any other name."""
    number = F.expr(f"try_cast(regexp_extract(`{checkpoint}`, '^(?:checkpoint-)?([0-9]+(?:[.][0-9]+)?)$', 1) as double)")
    epoch = F.bround(number / step).cast("int")
    return F.when(F.col(checkpoint) == "final", final).otherwise(epoch) if final is not None else epoch


def with_epochs(df: DataFrame, checkpoint: str, step: int = 167, name: str = "epoch") -> DataFrame:
    """df with the epoch of its checkpoints; `final` comes one after the greatest of all. That one is an aggregation, so that no window gathers all rows."""
    greatest = df.agg(F.max(epoch_of(checkpoint, step))).first()[0]
    return df.withColumn(name, epoch_of(checkpoint, step, F.lit(greatest).cast("int") + 1))


def expanded_trials(rates: DataFrame, sample: str, rate: str, n: str) -> DataFrame:
    """A pass rate as its single trials: k = rate times n, halves to even, are 1."""
    k = F.bround(F.col(rate) * F.col(n)).cast("int")
    return rates.select("*", F.explode(F.sequence(F.lit(1), F.col(n).cast("int"))).alias("run")).withColumn("correct", (F.col("run") <= k).cast("int"))


TESTS = "n long, diff double, low double, high double, p double, t_p double, w double, w_p double, shapiro_w double, shapiro_p double, skew double, kurtosis double"


def paired_tests(pairs: DataFrame, key: str, times: int = 10_000, seed: int = 42) -> DataFrame:
    """Bootstrap, t, Wilcoxon and normality of the paired differences of each key, all of them in every measure. A key's pairs are one evaluation set;
    its resampling needs them in one task. shapiro_p is null beyond 5000 pairs, where Royston's approximation of it doesn't hold; shapiro_w is not."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample", kind="stable")
        a, b = part["a"].to_numpy(float), part["b"].to_numpy(float)
        diff, low, high, p = st.paired_bootstrap(a, b, times, seed=seed)
        w, w_p = st.wilcoxon(a, b)
        shapiro_w, shapiro_p = st.shapiro(a - b)
        skew, kurtosis = st.skew_kurtosis(a - b)
        return pd.DataFrame([[part[key].iloc[0], len(part), diff, low, high, p, st.paired_t(a, b)[1], w, w_p, shapiro_w, shapiro_p, skew, kurtosis]], columns=[key, *(x.split(" ")[0] for x in TESTS.split(", "))])

    kind = pairs.schema[key].dataType.simpleString()
    tested = pairs.groupBy(key).applyInPandas(test, f"{key} {kind}, {TESTS}")
    return tested.select(key, *(F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in tested.dtypes if c != key))


def clustered_tests(counts: DataFrame, key: str, times: int = 10_000, seed: int = 42) -> DataFrame:
    """Clustered bootstrap, GEE and binomial mixed model (mixed, mixed_p) of two arms; counts: key, sample, hits_a, trials_a, hits_b, trials_b. With a separated arm, the GEE gives way to Wilcoxon's test."""

    def test(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("sample", kind="stable")
        cols = [part[c].to_numpy(float) for c in ("hits_a", "trials_a", "hits_b", "trials_b")]
        diff, low, high, p = st.clustered_bootstrap(*cols, times, seed=seed)
        ya, yb = ([np.repeat([1.0, 0.0], [int(h), int(t - h)]) for h, t in zip(hits, trials, strict=True)] for hits, trials in ((cols[0], cols[1]), (cols[2], cols[3])))
        y = np.concatenate([*ya, *yb])
        arm = np.repeat([1.0, 0.0], [cols[1].sum().astype(int), cols[3].sum().astype(int)])
        cluster = np.concatenate([np.repeat(np.arange(len(part)), cols[1].astype(int)), np.repeat(np.arange(len(part)), cols[3].astype(int))])
        if st.separated(np.concatenate(ya), np.concatenate(yb)):
            effect, effect_p, method = float("nan"), st.wilcoxon(cols[0] / cols[1], cols[2] / cols[3])[1], "wilcoxon"
            mixed, mixed_p = float("nan"), float("nan")
        else:
            effect, _, effect_p = st.gee_exchangeable(y, arm, cluster)
            method = "gee"
            mixed, _, mixed_p, _ = st.mixed_logistic(np.stack([cols[0], cols[2]], axis=1), np.stack([cols[1], cols[3]], axis=1))
        return pd.DataFrame([[part[key].iloc[0], len(part), diff, low, high, p, effect, effect_p, method, mixed, mixed_p]], columns=[key, "n", "diff", "low", "high", "p", "effect", "effect_p", "method", "mixed", "mixed_p"])

    kind = counts.schema[key].dataType.simpleString()
    return counts.groupBy(key).applyInPandas(test, f"{key} {kind}, n long, diff double, low double, high double, p double, effect double, effect_p double, method string, mixed double, mixed_p double")
