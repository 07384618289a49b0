"""Queries on evaluation trials: events as trials (sample = user, arm = event type, correct = value over 40), and labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.functions import parsing
from siltstone.operators import evaluation as ev
from siltstone.operators import ranking
from siltstone.plans.annotations import pairs
from siltstone.plans.similarity import rounded
from siltstone.runtime import table

ARM_A, ARM_B = "click", "view"


def trials(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return rows.select("event_id", F.col("user_id").alias("sample"), F.col("event_type").alias("arm"), (F.col("value") > 40).alias("correct"))


def arm_pairs(spark, sf_dir) -> DataFrame:
    rates = ev.pass_rates(trials(spark, sf_dir), ["sample", "arm"], "correct")
    return ev.paired(rates, "arm", "sample", "pass_rate", ARM_A, ARM_B).withColumn("split", F.when(F.col("sample") % 2 == 0, "eval").otherwise("train"))


def pass_rates(spark, sf_dir):
    return rounded(ev.pass_rates(trials(spark, sf_dir), ["arm", "sample"], "correct"))


def pass_at_k(spark, sf_dir):
    return rounded(ev.pass_at_k(trials(spark, sf_dir), "arm", "sample", "correct"))


def split_scores(spark, sf_dir):
    rates = ev.pass_rates(trials(spark, sf_dir), ["arm", "sample"], "correct").withColumn("split", F.when(F.col("sample") % 2 == 0, "eval").otherwise("train"))
    return rounded(ev.split_scores(rates, "arm", "split", "pass_rate", ARM_B))


def classification_metrics(spark, sf_dir):
    rows = pairs(spark, sf_dir).where("checker_is_sd is not null")
    return rounded(ev.classification(rows, "checker_is_sd", "dup"))


def paired_diff_t(spark, sf_dir):
    return rounded(ev.paired_summary(arm_pairs(spark, sf_dir), ["split"]))


def wilcoxon_statistic(spark, sf_dir):
    return rounded(ev.signed_ranks(arm_pairs(spark, sf_dir), ["split"]))


def trial_numbers(spark, sf_dir):
    rows = trials(spark, sf_dir).withColumn("key", F.struct("sample", "arm"))
    return ranking.ranked(rows, ["event_id"], "key").select("event_id", F.col("rank").cast("int").alias("run"))


def expanded_trials(spark, sf_dir):
    rates = ev.pass_rates(trials(spark, sf_dir), ["arm", "sample"], "correct")
    return ev.expanded_trials(rates, "sample", "pass_rate", "n_samples").groupBy("arm").agg(F.sum("correct").alias("correct"), F.count(F.lit(1)).alias("trials"))


def checkpoint_epochs(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id").select("event_id", F.when(F.col("event_id") % 100 == 0, "final").otherwise(F.col("event_id").cast("string")).alias("checkpoint"))
    return ev.with_epochs(rows, "checkpoint").select("event_id", "epoch")


def significance_marks(spark, sf_dir):
    rows = table(spark, sf_dir, "events", "event_id", "value")
    return rows.select("event_id", ev.significance_stars(F.col("value") / 1000).alias("mark"))


def puzzle_cell_accuracy(spark, sf_dir):
    """Predicted against true solutions: rows of nation as a puzzle of houses, with every third cell changed in case and every seventh wrong."""
    rows = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    house = F.concat(F.lit("House "), F.col("n_nationkey").cast("string"))
    true = F.create_map(F.lit("name"), F.col("n_name"))
    said = F.create_map(F.lit("name"), F.when(F.col("n_nationkey") % 7 == 0, "wrong").when(F.col("n_nationkey") % 3 == 0, F.lower("n_name")).otherwise(F.col("n_name")))
    both = rows.groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct(house, true))).alias("t"), F.map_from_entries(F.collect_list(F.struct(house, said))).alias("p"))
    return both.select("n_regionkey", parsing.cell_accuracy(F.col("p"), F.col("t")).alias("c")).select("n_regionkey", "c.correct", "c.total")


def paired_tests(spark, sf_dir):
    return ev.paired_tests(arm_pairs(spark, sf_dir), "split")


def clustered_tests(spark, sf_dir):
    rates = ev.pass_rates(trials(spark, sf_dir), ["sample", "arm"], "correct")
    a = ev.paired(rates, "arm", "sample", "n_correct", ARM_A, ARM_B).withColumnsRenamed({"a": "hits_a", "b": "hits_b"})
    b = ev.paired(rates, "arm", "sample", "n_samples", ARM_A, ARM_B).withColumnsRenamed({"a": "trials_a", "b": "trials_b"})
    return ev.clustered_tests(a.join(b, "sample").withColumn("split", F.when(F.col("sample") % 2 == 0, "eval").otherwise("train")), "split")


_T = "WITH t AS (SELECT event_id, user_id AS sample, event_type AS arm, (value > 40)::INT AS ok FROM events), r AS (SELECT arm, sample, avg(ok) AS rate, sum(ok) AS k, count(*) AS n FROM t GROUP BY 1, 2) "
_PAIR = _T + ", p AS (SELECT sample, CASE WHEN sample % 2 = 0 THEN 'eval' ELSE 'train' END AS split, max(CASE WHEN arm = 'click' THEN rate END) AS a, max(CASE WHEN arm = 'view' THEN rate END) AS b FROM r GROUP BY 1 HAVING a IS NOT NULL AND b IS NOT NULL) "

ORACLE = {
    "pass_rates": _T + "SELECT arm, sample, round(rate, 6) AS pass_rate, CAST(k AS BIGINT) AS n_correct, n AS n_samples FROM r",
    "pass_at_k": _T + ", m AS (SELECT arm, sample, max(ok) AS a, min(ok) AS b FROM t GROUP BY 1, 2) SELECT arm, round(avg(a), 6) AS pass_any, round(avg(b), 6) AS pass_all, count(*) AS tasks FROM m GROUP BY 1",
    "split_scores": _T + ", s AS (SELECT arm, CASE WHEN sample % 2 = 0 THEN 'eval' ELSE 'train' END AS split, avg(rate) AS mean, count(*) AS n FROM r GROUP BY 1, 2), e AS (SELECT *, sqrt(mean * (1 - mean) / n) AS se FROM s) SELECT e.arm, e.split, round(e.mean, 6) AS mean, e.n, round(e.se, 6) AS se, round(e.mean - b.mean, 6) AS delta, round(sqrt(e.se * e.se + b.se * b.se), 6) AS delta_se FROM e JOIN e b ON b.split = e.split AND b.arm = 'view'",
    "classification_metrics": "WITH c AS (SELECT count_if(t AND p)::DOUBLE AS tp, count_if(NOT t AND p)::DOUBLE AS fp, count_if(t AND NOT p)::DOUBLE AS fn, count_if(NOT t AND NOT p)::DOUBLE AS tn FROM (SELECT checker_is_sd AS t, is_sd AS p FROM annotation WHERE is_sd IS NOT NULL AND checker_is_sd IS NOT NULL AND score IS NOT NULL AND NOT isnan(score))), m AS (SELECT *, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1, tn / (tn + fn) AS p0, tn / (tn + fp) AS r0 FROM c) SELECT CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round((r1 + r0) / 2, 6) AS balanced_accuracy, round(p1, 6) AS precision_1, round(r1, 6) AS recall_1, round(2 * p1 * r1 / (p1 + r1), 6) AS f1_1, round(p0, 6) AS precision_0, round(r0, 6) AS recall_0, round(2 * p0 * r0 / (p0 + r0), 6) AS f1_0, round((2 * p1 * r1 / (p1 + r1) + 2 * p0 * r0 / (p0 + r0)) / 2, 6) AS macro_f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc FROM m",
    "paired_diff_t": _PAIR + "SELECT split, count(*) AS n, round(avg(a), 6) AS mean_a, round(avg(b), 6) AS mean_b, round(avg(a - b), 6) AS diff, round(stddev_samp(a - b), 6) AS sd, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 6) AS t FROM p GROUP BY 1",
    "wilcoxon_statistic": _PAIR + ", d AS (SELECT split, round(a - b, 12) AS d FROM p WHERE round(a - b, 12) <> 0), k AS (SELECT *, rank() OVER (PARTITION BY split ORDER BY abs(d)) + (count(*) OVER (PARTITION BY split, abs(d)) - 1) / 2.0::DOUBLE AS rk FROM d) SELECT split, count(*) AS n, round(coalesce(sum(rk) FILTER (d > 0), 0), 6) AS w_plus, round(coalesce(sum(rk) FILTER (d < 0), 0), 6) AS w_minus FROM k GROUP BY 1",
    "trial_numbers": "SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS INTEGER) AS run FROM events",
    "expanded_trials": _T + "SELECT arm, CAST(sum(ok) AS BIGINT) AS correct, count(*) AS trials FROM t GROUP BY 1",
    "checkpoint_epochs": "WITH e AS (SELECT event_id, CAST(CASE WHEN event_id % 100 <> 0 THEN round_even(event_id / 167.0::DOUBLE, 0) END AS INTEGER) AS epoch FROM events) SELECT event_id, CAST(coalesce(epoch, (SELECT max(epoch) + 1 FROM e)) AS INTEGER) AS epoch FROM e",
    "significance_marks": "SELECT event_id, CASE WHEN value / 1000 < 0.001 THEN '***' WHEN value / 1000 < 0.01 THEN '**' WHEN value / 1000 < 0.05 THEN '*' ELSE '' END AS mark FROM events",
    "puzzle_cell_accuracy": "SELECT n_regionkey, CAST(count_if(n_nationkey % 7 <> 0) AS INTEGER) AS correct, CAST(count(*) AS INTEGER) AS total FROM nation GROUP BY 1",
}
UNCHECKED = ["paired_tests", "clustered_tests"]
QUERIES = {name: globals()[name] for name in [*ORACLE, *UNCHECKED]}
