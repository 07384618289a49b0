"""Problem 3: consensus of several annotators, their agreement and their reliability.

Iteratively reweighted voting. A verdict's weight is the log-odds of its annotator's accuracy. The accuracy is
measured against the weighted vote of the others on each item (leave-one-out), smoothed, and corrected for how sure
those others are: with the others right with probability q, an annotator of accuracy a agrees with them with
probability a*q + (1-a)*(1-q)/(k-1). Both steps alternate until no accuracy moves.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.ranking import ranked
from siltstone.runtime import materialize, small_side

#: Labels whose numbers are given in the driver; more are numbered in ranges.
LISTED_LABELS = 10_000
#: Smoothing: so many verdicts' worth of an accuracy of START; accuracies stay within the bounds.
PRIOR, START, LOWEST, HIGHEST = 4.0, 0.7, 0.02, 0.98
#: The move of an accuracy under which all have settled, and the rounds after which not to have settled is an error.
SETTLED, ROUNDS = 1e-12, 1000
#: Verdicts of patterns, times labels, that one task may hold; its rounds are arithmetic on arrays. More go through rounds of aggregations, with the same result.
TASK_VERDICTS = 4_000_000


@dataclass
class Consensus:
    items: DataFrame  #: item, label (null: undecided), n, agreement (share of verdicts for the label), posterior
    annotators: DataFrame  #: annotator, n, accuracy
    agreement: DataFrame  #: one row: items with two verdicts or more, their verdicts, observed and expected disagreement, alpha


def one_verdict_each(df: DataFrame, item: str, annotator: str, label: str, order: Column | None = None) -> DataFrame:
    """(item, annotator, label) without nulls, one row for each item and annotator: the last by order, else the greatest label."""
    kept = df.select(F.col(f"`{item}`").alias("item"), F.col(f"`{annotator}`").cast("string").alias("annotator"), F.col(f"`{label}`").cast("string").alias("label"), (order if order is not None else F.lit(0)).alias("at"))
    kept = kept.where("item is not null and annotator is not null and label is not null")
    return kept.groupBy("item", "annotator").agg(F.max(F.struct("at", "label")).getField("label").alias("label"))


def numbered(votes: DataFrame) -> tuple[DataFrame, int]:
    """(label, code) with codes from 0 in the labels' order, and how many there are."""
    labels = votes.select("label").distinct()
    few = [r[0] for r in labels.limit(LISTED_LABELS + 1).collect()]
    if len(few) > LISTED_LABELS:
        codes = materialize(ranked(labels, ["label"], name="code").select("label", (F.col("code") - 1).cast("int").alias("code")))
        return codes, codes.count()
    return votes.sparkSession.createDataFrame([(x, i) for i, x in enumerate(sorted(few))], "label string, code int"), len(few)


def weight(labels: int) -> Column:
    return F.log(F.col("accuracy") * (labels - 1) / (1 - F.col("accuracy")))


def patterns(votes: DataFrame) -> DataFrame:
    """Votes of one item for each pattern of votes that occurs, with n, the items of the pattern. An item with one vote tells nothing of its annotator and is left out."""
    prints = votes.groupBy("item").agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("annotator", "code")).alias("p"), F.bit_xor(F.xxhash64(F.lit(1), "code", "annotator")).alias("q"))
    kinds = prints.where("m > 1").groupBy("m", "p", "q").agg(F.min("item").alias("item"), F.count(F.lit(1)).alias("n"))
    return votes.join(kinds.select("item", "n"), "item")


def fit(items: np.ndarray, annotators: np.ndarray, codes: np.ndarray, n: np.ndarray, labels: int, settled: float, most_rounds: int) -> np.ndarray:
    """The accuracy of each annotator, from verdicts given by the numbers of their item, annotator and label."""
    accuracy = np.full(annotators.max(initial=-1) + 1, START)
    flat, count, at = items * labels + codes, items.max(initial=-1) + 1, np.arange(len(items))
    for _ in range(most_rounds):
        w = np.log(accuracy * (labels - 1) / (1 - accuracy))[annotators]
        others = np.bincount(flat, w, count * labels).reshape(count, labels)[items]
        others[at, codes] -= w
        top = others.max(axis=1, keepdims=True)
        q = 1 / np.exp(others - top).sum(axis=1)
        chance = (1 - q) / (labels - 1)
        slope, agrees = q - chance, others.argmax(axis=1) == codes
        up, down = np.bincount(annotators, n * slope * (agrees - chance), len(accuracy)), np.bincount(annotators, n * slope * slope, len(accuracy))
        before, accuracy = accuracy, np.clip((up + PRIOR * START) / (down + PRIOR), LOWEST, HIGHEST)
        if not len(accuracy) or np.abs(accuracy - before).max() < settled:
            return accuracy
    raise RuntimeError(f"accuracies still move by {np.abs(accuracy - before).max():.1e} after {most_rounds} rounds")


def fitted_in_a_task(told: DataFrame, labels: int) -> DataFrame:
    """(annotator, accuracy) by rounds within one task, for verdicts of a checked number."""
    settled, most_rounds = SETTLED, ROUNDS

    def rounds(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = [b for b in batches if len(b)]
        if parts:
            votes = pd.concat(parts).sort_values(["item", "annotator"], kind="stable")  # the same sums whatever the partitions
            names, annotators = np.unique(votes["annotator"].to_numpy(dtype=object), return_inverse=True)
            items = np.unique(votes["item"].to_numpy(), return_inverse=True)[1]
            yield pd.DataFrame({"annotator": names, "accuracy": fit(items, annotators, votes["code"].to_numpy(), votes["n"].to_numpy(dtype=float), labels, settled, most_rounds)})

    return told.select("item", "annotator", "code", "n").coalesce(1).mapInPandas(rounds, "annotator string, accuracy double")


def by_label(weighted: DataFrame) -> DataFrame:
    """(item, code, s, c): weight and number of each label's verdicts. Pre-aggregates, so that an item of any size is spread."""
    return weighted.groupBy("item", "code").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("c"))


def by_item(sums: DataFrame, labels: int) -> DataFrame:
    """Of each item: m verdicts, the greatest weights of two labels with the first label of each, how many labels reach the greatest, and z, the
    sum of exp(weight - greatest) over all labels. A label without verdicts weighs 0."""
    first = F.struct(F.col("s").alias("s"), (-F.col("code")).alias("k"))
    tops = sums.groupBy("item").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("present"), F.sum("code").alias("codes"), F.max(first).alias("a"), F.max_by(F.struct("s", "code"), first).alias("x"))
    kept = sums.join(tops, "item")
    greatest = F.when(F.col("present") < labels, F.greatest(F.col("a.s"), F.lit(0.0))).otherwise(F.col("a.s"))
    kept = kept.withColumn("top", greatest)
    rest = kept.groupBy("item").agg(
        F.first("m").alias("m"), F.first("present").alias("present"), F.first("codes").alias("codes"), F.first("top").alias("top"), F.first("a").alias("a"),
        F.max(F.when(F.col("code") != -F.col("a.k"), first)).alias("b"), F.count_if(F.col("s") == F.col("top")).alias("ties"), F.sum(F.exp(F.col("s") - F.col("top"))).alias("z"),
    )
    absent = labels - F.col("present")
    return rest.withColumns({"z": F.col("z") + absent * F.exp(-F.col("top")), "ties": F.col("ties") + F.when(F.col("top") == 0, absent).otherwise(0), "absent": absent})


def fitted_by_rounds(told: DataFrame, labels: int) -> DataFrame:
    """(annotator, accuracy) by rounds of aggregations, each written to the shared folder."""
    known = materialize(told.select("annotator").distinct().withColumn("accuracy", F.lit(START)))
    for _ in range(ROUNDS):
        weighted = told.join(small_side(known), "annotator").withColumn("w", weight(labels))
        sums = by_label(weighted)
        # whether all labels up to the own one have verdicts: then no label without any comes before it
        upto = F.row_number().over(Window.partitionBy("item").orderBy("code")) if labels > 2 else F.lit(0)
        seen = weighted.join(sums.select("item", "code", "s", (upto == F.col("code") + 1).alias("full")), ["item", "code"]).join(by_item(sums, labels), "item")
        own = F.col("s") - F.col("w")
        other = F.when(F.col("code") == -F.col("a.k"), F.col("b")).otherwise(F.col("a"))
        # a label without verdicts weighs 0
        best = F.greatest(F.coalesce(other["s"], F.lit(float("-inf"))), F.when(F.col("absent") > 0, 0.0).otherwise(float("-inf")))
        top = F.greatest(own, best)
        z = (F.col("z") - F.exp(F.col("s") - F.col("top")) + F.exp(own - F.col("top"))) * F.exp(F.col("top") - top)
        q = 1 / z
        # of equal weights the first label counts
        before_other = F.coalesce((other["s"] != own) | (F.col("code") < -other["k"]), F.lit(True))
        agrees = F.when((own > best) | ((own == best) & before_other & ((F.col("absent") == 0) | (own != 0) | F.col("full"))), 1.0).otherwise(0.0)
        chance = (1 - q) / (labels - 1)
        slope = q - chance
        new = seen.groupBy("annotator").agg(F.sum(F.col("n") * slope * (agrees - chance)).alias("up"), F.sum(F.col("n") * slope * slope).alias("down"))
        moved = F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), (F.col("up") + PRIOR * START) / (F.col("down") + PRIOR)))
        after = materialize(known.withColumnRenamed("accuracy", "before").join(new, "annotator").select("annotator", moved.alias("accuracy"), "before"))
        change = after.agg(F.max(F.abs(F.col("accuracy") - F.col("before")))).first()[0]
        known = after.select("annotator", "accuracy")
        if change is None or change < SETTLED:
            return known
    raise RuntimeError(f"accuracies still move by {change:.1e} after {ROUNDS} rounds")


def reweighted(votes: DataFrame, labels: int, task_verdicts: int = TASK_VERDICTS) -> DataFrame:
    """(annotator, accuracy) after the rounds have settled; annotators that are only alone on their items keep the start."""
    told = materialize(patterns(votes))
    found = fitted_in_a_task(told, labels) if told.count() * labels <= task_verdicts else fitted_by_rounds(told, labels)
    every = votes.groupBy("annotator").agg(F.count(F.lit(1)).alias("n"))
    return materialize(every.join(found, "annotator", "left").select("annotator", "n", F.coalesce("accuracy", F.lit(START)).alias("accuracy")))


def alpha(votes: DataFrame) -> DataFrame:
    """Krippendorff's alpha of nominal labels: agreement beyond chance where items lack ratings. Null where only one label or no item with two verdicts occurs."""
    counts = votes.groupBy("item", "label").agg(F.count(F.lit(1)).alias("c"))
    items = counts.groupBy("item").agg(F.sum("c").alias("m"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same"), F.min("label").alias("only"))
    rated = items.where("m > 1")
    sums = rated.agg(F.count(F.lit(1)).alias("items"), F.coalesce(F.sum("m"), F.lit(0)).alias("verdicts"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("d"))
    alone = items.where("m = 1").groupBy(F.col("only").alias("label")).agg(F.count(F.lit(1)).alias("alone"))
    totals = votes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(alone, "label", "left")
    squares = totals.agg(F.sum((F.col("n") - F.coalesce("alone", F.lit(0))).cast("double") ** 2).alias("squares"))
    n = F.col("verdicts").cast("double")
    # both are one row
    out = sums.withColumn("k", F.lit(1)).join(squares.withColumn("k", F.lit(1)), "k").select("items", "verdicts", F.when(n > 0, F.col("d") / n).alias("observed"), F.when(n > 1, (n * n - F.col("squares")) / (n * (n - 1))).alias("expected"))
    return out.withColumn("alpha", F.when(F.col("expected") > 0, 1 - F.col("observed") / F.col("expected")))


def consensus(df: DataFrame, item: str, annotator: str, label: str, order: Column | None = None, task_verdicts: int = TASK_VERDICTS) -> Consensus:
    """Consensus label per item, agreement over all items, accuracy per annotator.

    Null items, annotators or labels are no verdict; of repeated rows of an item and annotator the last by order counts;
    a tie of the weights leaves the item undecided (null label); an item with one verdict follows it (or, of an
    annotator that is more often wrong than right, its opposite where there are two labels); labels may be any number; accuracies that don't settle
    are an error; an empty table gives empty items and annotators and an agreement of nulls; other columns are ignored.
    """
    named = one_verdict_each(df, item, annotator, label, order)
    named = materialize(named)
    codes, n = numbered(named)
    k = max(2, n)
    votes = named.join(small_side(codes), "label")
    fitted = reweighted(votes, k, task_verdicts)
    sums = by_label(votes.join(small_side(fitted.select("annotator", "accuracy")), "annotator").withColumn("w", weight(k)))
    sums = materialize(sums)
    # of labels that all weigh less than nothing, one without verdicts stands out if it is the only one
    chosen = F.when(F.col("ties") != 1, None).when(F.col("a.s") == F.col("top"), -F.col("a.k")).otherwise(F.lit(n * (n - 1) // 2) - F.col("codes"))
    decided = by_item(sums, max(1, n)).select("item", F.col("m").alias("n"), (1 / F.col("z")).alias("posterior"), chosen.cast("int").alias("code"))
    counted = decided.join(sums.select("item", "code", "c"), ["item", "code"], "left").join(small_side(codes), "code", "left")
    items = counted.select("item", "label", "n", (F.coalesce("c", F.lit(0)) / F.col("n")).alias("agreement"), "posterior")
    return Consensus(items, fitted, alpha(votes))


# Spellings of yes and no.
YES, NO = ["true", "t", "yes", "y", "1"], ["false", "f", "no", "n", "0"]


def pair_verdicts(annotation: DataFrame, rater_label: DataFrame) -> DataFrame:
    """(pair_id, annotator, label) of annotation's two verdicts and of each rater's latest row without an error."""

    def named(flag: Column) -> Column:
        return F.when(flag, "duplicate").when(~flag, "distinct")

    given = annotation.groupBy("pair_id").agg(F.max_by("is_sd", F.when(F.col("is_sd").isNotNull(), F.col("annotation_id"))).alias("label"), F.max_by("checker_is_sd", F.when(F.col("checker_is_sd").isNotNull(), F.col("annotation_id"))).alias("checker"))
    both = F.explode(F.array(F.struct(F.lit("label").alias("annotator"), named(F.col("label")).alias("label")), F.struct(F.lit("checker").alias("annotator"), named(F.col("checker")).alias("label"))))
    first = given.select("pair_id", both.alias("v")).select("pair_id", "v.annotator", "v.label").where("label is not null")
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    sound = rater_label.where(clean("error") == "")
    latest = sound.groupBy("pair_id", "rater_id").agg(F.max(F.struct("labelled_at", "label_id", "is_sd", "match_type")).alias("r"))
    flag, kind = clean("r.is_sd"), clean("r.match_type")
    said = F.when(flag.isin(YES), "duplicate").when(flag.isin(NO), "distinct").when((flag == "") & (kind != ""), F.when(kind == "unrelated", "distinct").otherwise("duplicate"))
    second = latest.select("pair_id", F.concat(F.lit("rater "), F.col("rater_id").cast("string")).alias("annotator"), said.alias("label")).where("label is not null")
    return first.union(second).where("pair_id is not null")
