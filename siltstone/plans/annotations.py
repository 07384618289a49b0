"""Queries on labelled pairs and raters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import records
from siltstone.operators import annotation as ann
from siltstone.operators import dedup, ranking
from siltstone.plans.similarity import rounded
from siltstone.runtime import table


def pairs(spark, sf_dir) -> DataFrame:
    """Labelled rows: stage, test, score, flag and kind in tidy form. Rows without a usable score or label are left out."""
    rows = table(spark, sf_dir, "annotation", "annotation_id", "dataset", "benchmark", "test_id", "corpus_id", "score", "is_sd", "match_type", "checker_is_sd")
    good = rows.where("is_sd is not null and score is not null and not isnan(score)")
    return good.select("annotation_id", ann.tidy("dataset").alias("stage"), "benchmark", "test_id", "corpus_id", "score", F.col("is_sd").alias("dup"), ann.tidy("match_type").alias("kind"), "checker_is_sd")


def difficulty(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark_item", "test_id", "elo_bin", "rating", "global_idx")


def duplicate_rate(spark, sf_dir):
    return rounded(ann.duplicate_rate(pairs(spark, sf_dir), ["stage", "test_id"], "dup"))


def box_summary(spark, sf_dir):
    rates = ann.duplicate_rate(pairs(spark, sf_dir), ["stage", "test_id"], "dup")
    return rounded(ann.box_summary(rates, "stage", "rate"))


def semantic_filter(spark, sf_dir):
    rows = ann.semantic_flags(pairs(spark, sf_dir), "dup", "kind")
    return rows.groupBy("stage").agg(F.count_if("dup").alias("semantic"), F.count_if("dup_with_exact").alias("with_exact"), F.count_if(F.col("kind").isin(*ann.STRONG)).alias("strong"))


def binned_rate(spark, sf_dir):
    return rounded(ann.binned_rate(ann.equal_width_bins(pairs(spark, sf_dir).where("score between 0 and 1").withColumn("score", F.round("score", 4)), "score", 30), "dup", False, "middle"))


def fixed_bin_rate(spark, sf_dir):
    return rounded(ann.binned_rate(ann.fixed_bins(pairs(spark, sf_dir), "score", 0.25, 1.0, 25), "dup", True))


def occurrence_rate(spark, sf_dir):
    return rounded(ann.occurrence_rate(pairs(spark, sf_dir), "stage", "test_id", "dup"))


def occurrence_by_difficulty(spark, sf_dir):
    """Tests and duplicates by rating bin of 400."""
    rows = pairs(spark, sf_dir).join(difficulty(spark, sf_dir).where("rating is not null"), "test_id")
    items = rows.groupBy("test_id", (F.floor(F.col("rating") / 400) * 400).cast("int").alias("bin")).agg(F.max(ann.one("dup")).alias("has"), F.sum(ann.one("dup")).alias("dups"))
    return rounded(items.groupBy("bin").agg(F.countDistinct("test_id").alias("tests"), F.sum("has").alias("with_dup"), F.avg("dups").alias("mean_dups"), F.stddev_samp("dups").alias("std_dups"), (F.stddev_samp("dups") / F.sqrt(F.count(F.lit(1)))).alias("se_dups")))


def difficulty_regression(spark, sf_dir):
    rows = pairs(spark, sf_dir).join(difficulty(spark, sf_dir).where("rating is not null"), "test_id")
    rates = rows.groupBy("test_id", "rating").agg((F.sum(ann.one("dup")) / F.count(F.lit(1))).alias("rate"))
    return rounded(ann.regression(rates.withColumn("rating", F.col("rating").cast("double")), "rating", "rate"))


def depth_scaling(spark, sf_dir):
    rows = ann.semantic_flags(pairs(spark, sf_dir), "dup", "kind")
    return rounded(ann.depth_scaling(rows, "stage", "test_id", "score", "dup", "annotation_id"))


def wilson_intervals(spark, sf_dir):
    rates = ann.duplicate_rate(pairs(spark, sf_dir), ["benchmark"], "dup")
    low, high = ann.wilson(F.col("dups"), F.col("n"))
    return rounded(rates.withColumns({"low": low, "high": high}))


def annotation_export_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "success", "is_sd", "confidence", "score", "test_id")
    return rounded(ann.export_statistics(rows))


def match_type_pivot(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "dataset", "match_type").select(ann.tidy("dataset").alias("stage"), ann.tidy("match_type").alias("kind"))
    return rounded(ann.type_counts(rows, "stage", "kind"))


def stage_grid_heatmap(spark, sf_dir):
    rows = pairs(spark, sf_dir).where("benchmark = 'zebralogic'")
    a, b = records.grid_size(F.col("test_id"))
    cells = rows.select("stage", a.alias("grid_rows"), b.alias("grid_cols"), "dup")
    return rounded(ann.duplicate_rate(cells, ["stage", "grid_rows", "grid_cols"], "dup").where("n >= 30"))


def contaminated_grids(spark, sf_dir):
    a, b = records.grid_size(F.col("test_id"))
    every = table(spark, sf_dir, "benchmark_item", "test_id", "benchmark").where("benchmark = 'zebralogic'").groupBy(a.alias("grid_rows"), b.alias("grid_cols")).agg(F.count(F.lit(1)).alias("tests"))
    hit = pairs(spark, sf_dir).where("dup and benchmark = 'zebralogic'").groupBy(a.alias("grid_rows"), b.alias("grid_cols")).agg(F.countDistinct("test_id").alias("hit"))
    return every.join(hit, ["grid_rows", "grid_cols"], "left").select("grid_rows", "grid_cols", "tests", F.coalesce("hit", F.lit(0)).alias("hit"))


def usable_labels(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "rater_label", "label_id", "pair_id", "rater_id", "match_type", "is_sd", "error", "labelled_at", "confidence")
    return rows.where(ann.ERROR_BLANK).where("match_type is not null").withColumn("kind", ann.tidy("match_type"))


def fleiss_kappa(spark, sf_dir):
    return rounded(ann.fleiss_kappa(ann.label_counts(usable_labels(spark, sf_dir), "pair_id", "kind"), "pair_id", "kind", 5))


def modal_agreement(spark, sf_dir):
    return rounded(ann.modal_agreement(ann.label_counts(usable_labels(spark, sf_dir), "pair_id", "kind"), "pair_id", "kind"))


def pairwise_agreement(spark, sf_dir):
    counts = ann.label_counts(usable_labels(spark, sf_dir), "pair_id", "kind")
    per = counts.groupBy("pair_id").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    return rounded(per.agg((F.sum("same") / F.sum(F.col("n") * (F.col("n") - 1))).alias("agreement"), F.count_if(F.col("same") == F.col("n") * (F.col("n") - 1)).alias("unanimous"), F.count_if(F.col("same") < F.col("n") * (F.col("n") - 1)).alias("split")))


def self_consistency(spark, sf_dir):
    rows = usable_labels(spark, sf_dir)
    dup = F.count_if(F.col("kind") != "unrelated") / F.count(F.lit(1))
    return rounded(rows.groupBy("pair_id").agg(F.count(F.lit(1)).alias("runs"), dup.alias("dup_share"), F.avg("confidence").alias("mean_confidence")))


def coalesced_verdicts(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    keys = ["test_id", "corpus_id"]
    first = rows.where("checker_is_sd is not null").withColumn("v", F.col("checker_is_sd"))
    rated = usable_labels(spark, sf_dir).join(table(spark, sf_dir, "annotation", "pair_id", "test_id", "corpus_id").distinct(), "pair_id")
    second = rated.select(*keys, (F.col("kind") != "unrelated").alias("v"))
    done = ann.coalesced_verdicts(rows, first, second, keys, "v", "kind")
    return done.groupBy("stage").agg(F.count_if("final").alias("final_dups"), F.count_if("dup").alias("dups"), F.count(F.lit(1)).alias("n"))


def label_agreement(spark, sf_dir):
    a = pairs(spark, sf_dir).groupBy("stage", "test_id", "corpus_id").agg(F.max("dup").alias("dup"))
    b = pairs(spark, sf_dir).where("checker_is_sd is not null").groupBy("stage", "test_id", "corpus_id").agg(F.max("checker_is_sd").alias("dup"))
    return ann.label_agreement(a, b, ["stage", "test_id", "corpus_id"], "dup")


def validation_issues(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "dataset", "test_id", "corpus_id", "score", "confidence", "success", "is_sd", "match_type", "error", "test_text")
    return ann.validation_issues(rows)


def merge_new_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "annotation_id", "benchmark", "test_id", "corpus_id")
    keys = ["benchmark", "test_id", "corpus_id"]
    known = dedup.keep_first(rows.where("annotation_id % 3 = 0"), keys, ["annotation_id"])
    return dedup.merge_unseen(known, rows.where("annotation_id % 3 <> 0"), keys, ["annotation_id"]).select("annotation_id")


def resume_anti_join(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "annotation_id", "pair_id")
    return dedup.without_done(rows, rows.where("annotation_id % 2 = 0"), ["pair_id"]).select("annotation_id")


def set_overlaps(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "test_id", "corpus_id", "dataset", "is_sd")
    key = F.concat_ws("|", "test_id", "corpus_id").alias("k")
    sets = {"annotated": rows.select(key), "duplicate": rows.where("is_sd").select(key), "forum": rows.where("lower(trim(dataset)) like 'forum%'").select(key)}
    return rounded(dedup.overlaps(sets, "k"))


def cost_estimate(spark, sf_dir):
    """Cost of annotating, from the tokens that go in and a fixed answer of 200 tokens, at the published prices a million."""
    rows = table(spark, sf_dir, "annotation", "dataset", "tokens_input")
    cost = (F.sum("tokens_input") * F.lit(0.5) + F.count(F.lit(1)) * F.lit(200 * 3.0)) / F.lit(1e6)
    return rounded(rows.groupBy(ann.tidy("dataset").alias("stage")).agg(cost.alias("cost"), F.count(F.lit(1)).alias("n")))


def running_index(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "annotation_id", "test_id")
    return ranking.ranked(rows, ["annotation_id"], "test_id").select("annotation_id", (F.col("rank") - 1).cast("int").alias("index"))


def top_percent_by_weight(spark, sf_dir):
    rows = pairs(spark, sf_dir).select("stage", "annotation_id", (F.col("score") * F.col("score")).alias("weight"))
    most = rows.groupBy("stage").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 5 / 100)).alias("most"))
    ranks = ranking.ranked(rows, [-F.col("weight"), "annotation_id"], "stage")
    return ranks.join(most, "stage").where("rank <= most").select("annotation_id")


def above_group_mean(spark, sf_dir):
    rows = pairs(spark, sf_dir)
    mean = rows.groupBy("stage").agg(F.avg(F.round("score", 5)).alias("mean"))
    return rows.join(mean, "stage").where(F.round("score", 5) > F.round("mean", 9)).select("annotation_id")


def summary_statistics(spark, sf_dir):
    """Pairs and duplicates overall and by stage, with each kind's share of the stage."""
    rows = pairs(spark, sf_dir)
    counts = rows.groupBy("stage", "kind").agg(F.count(F.lit(1)).alias("n"))
    return rounded(counts.withColumn("pct", 100 * F.col("n") / F.sum("n").over(Window.partitionBy("stage"))))


_P = "WITH p AS (SELECT annotation_id, lower(trim(dataset)) AS stage, benchmark, test_id, corpus_id, score, is_sd AS dup, lower(trim(match_type)) AS kind, checker_is_sd FROM annotation WHERE is_sd IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)) "
_CI = "round({h} / n::DOUBLE, 6) AS rate, round({lo}{h} / n::DOUBLE - 1.96 * sqrt(({h} / n::DOUBLE) * (1 - {h} / n::DOUBLE) / n){lc}, 6) AS low, round({hi}{h} / n::DOUBLE + 1.96 * sqrt(({h} / n::DOUBLE) * (1 - {h} / n::DOUBLE) / n){lc}, 6) AS high"


def _ci(hits: str, clip: bool) -> str:
    return _CI.format(h=hits, lo="greatest(0.0, " if clip else "", hi="least(1.0, " if clip else "", lc=")" if clip else "")


def _wilson(h: str, n: str) -> str:
    middle = f"(({h} / {n}::DOUBLE) + 1.96 * 1.96 / (2 * {n})) / (1 + 1.96 * 1.96 / {n})"
    half = f"1.96 * sqrt(({h} / {n}::DOUBLE) * (1 - {h} / {n}::DOUBLE) / {n} + 1.96 * 1.96 / (4 * {n} * {n})) / (1 + 1.96 * 1.96 / {n})"
    return f"round(greatest(0.0, {middle} - {half}), 6) AS low, round(least(1.0, {middle} + {half}), 6) AS high"


_U = "WITH u AS (SELECT *, lower(trim(match_type)) AS kind FROM rater_label WHERE coalesce(trim(error), '') = '' AND match_type IS NOT NULL), c AS (SELECT pair_id, kind, count(*) AS c FROM u GROUP BY 1, 2) "
_GRID = r"CAST(coalesce(nullif(regexp_extract(test_id, '(\d+)x(\d+)', 1), ''), '0') AS INTEGER) AS grid_rows, CAST(coalesce(nullif(regexp_extract(test_id, '(\d+)x(\d+)', 2), ''), '0') AS INTEGER) AS grid_cols"

# Two-sided p of a correlation: the density of t integrated by Simpson's rule.
_T = "(abs(corr(x, y)) * sqrt((count(*) - 2) / (1 - corr(x, y) * corr(x, y))))"
_V = "(count(*) - 2)"
_DENSITY = f"list_sum([(CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow({_T} * i / 2000, 2) / {_V}, -({_V} + 1) / 2.0::DOUBLE) FOR i IN range(0, 2001)])"
_P_VALUE = f"round(1 - 2 * exp(lgamma(({_V} + 1) / 2.0::DOUBLE) - lgamma({_V} / 2.0::DOUBLE)) / sqrt({_V} * pi()) * {_T} / 6000 * {_DENSITY}, 6)"

ORACLE = {
    "duplicate_rate": _P + "SELECT stage, test_id, count(*) AS n, CAST(sum(dup::INT) AS BIGINT) AS dups, round(avg(dup::INT), 6) AS rate FROM p GROUP BY 1, 2",
    "box_summary": _P + ", r AS (SELECT stage, test_id, sum(dup::INT) / count(*)::DOUBLE AS rate FROM p GROUP BY 1, 2) SELECT stage, count(*) AS n, round(avg(rate), 6) AS mean, round(quantile_cont(rate, 0.05), 6) AS p5, round(quantile_cont(rate, 0.25), 6) AS q1, round(quantile_cont(rate, 0.5), 6) AS median, round(quantile_cont(rate, 0.75), 6) AS q3, round(quantile_cont(rate, 0.95), 6) AS p95 FROM r GROUP BY 1",
    "semantic_filter": _P + "SELECT stage, count_if(dup AND kind IN ('equivalent', 'subset', 'superset')) AS semantic, count_if(dup) AS with_exact, count_if(kind IN ('exact', 'equivalent', 'subset', 'superset')) AS strong FROM p GROUP BY 1",
    "binned_rate": _P + ", q AS (SELECT round(score, 4) AS score, dup FROM p WHERE score BETWEEN 0 AND 1), m AS (SELECT min(score) AS lo, max(score) AS hi FROM q), b AS (SELECT CAST(least(30, greatest(1, ceil((score - lo) / ((hi - lo) / 30)))) AS INTEGER) AS bin, dup, lo, (hi - lo) / 30 AS w FROM q, m), g AS (SELECT bin, lo + (bin - 0.5) * w AS middle, count(*) AS n, CAST(sum(dup::INT) AS BIGINT) AS dups FROM b GROUP BY ALL) SELECT bin, round(middle, 6) AS middle, n, dups, " + _ci("dups", False) + " FROM g",
    "fixed_bin_rate": _P + ", b AS (SELECT CAST(ceil((score - 0.25::DOUBLE) / 0.03::DOUBLE) AS INTEGER) AS bin, dup FROM p), g AS (SELECT bin, count(*) AS n, CAST(sum(dup::INT) AS BIGINT) AS dups FROM b WHERE bin BETWEEN 1 AND 25 GROUP BY 1) SELECT bin, n, dups, " + _ci("dups", True) + " FROM g",
    "occurrence_rate": _P + ", i AS (SELECT stage, test_id, max(dup::INT) AS has FROM p GROUP BY 1, 2), g AS (SELECT stage, count(*) AS n, CAST(sum(has) AS BIGINT) AS with_dup FROM i GROUP BY 1) SELECT stage, n AS items, with_dup, " + _ci("with_dup", True) + " FROM g",
    "occurrence_by_difficulty": _P + ", i AS (SELECT p.test_id, CAST(floor(rating / 400) * 400 AS INTEGER) AS bin, max(dup::INT) AS has, sum(dup::INT) AS dups FROM p JOIN benchmark_item b ON b.test_id = p.test_id WHERE rating IS NOT NULL GROUP BY 1, 2) SELECT bin, count(DISTINCT test_id) AS tests, CAST(sum(has) AS BIGINT) AS with_dup, round(avg(dups), 6) AS mean_dups, round(stddev_samp(dups), 6) AS std_dups, round(stddev_samp(dups) / sqrt(count(*)), 6) AS se_dups FROM i GROUP BY 1",
    "difficulty_regression": _P + ", r AS (SELECT p.test_id, rating::DOUBLE AS x, sum(dup::INT) / count(*)::DOUBLE AS y FROM p JOIN benchmark_item b ON b.test_id = p.test_id WHERE rating IS NOT NULL GROUP BY 1, 2) SELECT round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(corr(x, y), 6) AS r, count(*) AS n, " + _P_VALUE + " AS p FROM r",
    "depth_scaling": _P + ", k AS (SELECT stage, test_id, dup AND kind IN ('equivalent', 'subset', 'superset') AS dup, row_number() OVER (PARTITION BY stage, test_id ORDER BY score DESC, annotation_id) AS rk FROM p), f AS (SELECT stage, test_id, min(CASE WHEN dup THEN rk END) AS first FROM k GROUP BY 1, 2), d AS (SELECT *, unnest([1, 10, 100, 500]) AS depth FROM f), g AS (SELECT stage, depth, count(*) AS items, count_if(first <= depth) AS hits FROM d GROUP BY 1, 2) SELECT stage, depth, items, hits, round(hits / items::DOUBLE, 6) AS rate, " + _wilson("hits", "items") + " FROM g",
    "wilson_intervals": _P + ", g AS (SELECT benchmark, count(*) AS n, CAST(sum(dup::INT) AS BIGINT) AS dups FROM p GROUP BY 1) SELECT benchmark, n, dups, round(dups / n::DOUBLE, 6) AS rate, " + _wilson("dups", "n") + " FROM g",
    "annotation_export_stats": "SELECT count(*) AS total, count_if(success) AS succeeded, count_if(NOT success) AS failed, count_if(success AND is_sd) AS duplicates, round(count_if(success AND is_sd) / greatest(count_if(success), 1)::DOUBLE, 6) AS dup_rate, count(DISTINCT CASE WHEN success AND is_sd THEN test_id END) AS tests_affected, round(avg(CASE WHEN success AND confidence > 0 THEN confidence END), 6) AS mean_confidence, round(min(CASE WHEN success AND confidence > 0 THEN confidence END), 6) AS min_confidence, round(max(CASE WHEN success AND confidence > 0 THEN confidence END), 6) AS max_confidence, round(min(CASE WHEN success AND NOT isnan(score) THEN score END), 6) AS min_score, round(max(CASE WHEN success AND NOT isnan(score) THEN score END), 6) AS max_score FROM annotation",
    "match_type_pivot": "WITH r AS (SELECT lower(trim(dataset)) AS stage, lower(trim(match_type)) AS kind FROM annotation) SELECT stage, " + ", ".join(f"count_if(kind = '{k}') AS {k}" for k in ann.MATCH_TYPES) + ", count(kind) AS n, round((count(kind) - count_if(kind = 'unrelated')) / greatest(count(kind), 1)::DOUBLE, 6) AS sd_rate FROM r GROUP BY 1",
    "stage_grid_heatmap": _P + f"SELECT stage, {_GRID}, count(*) AS n, CAST(sum(dup::INT) AS BIGINT) AS dups, round(avg(dup::INT), 6) AS rate FROM p WHERE benchmark = 'zebralogic' GROUP BY 1, 2, 3 HAVING count(*) >= 30",
    "contaminated_grids": _P + f", e AS (SELECT {_GRID}, count(*) AS tests FROM benchmark_item WHERE benchmark = 'zebralogic' GROUP BY 1, 2), h AS (SELECT {_GRID}, count(DISTINCT test_id) AS hit FROM p WHERE dup AND benchmark = 'zebralogic' GROUP BY 1, 2) SELECT e.grid_rows, e.grid_cols, tests, coalesce(hit, 0) AS hit FROM e LEFT JOIN h USING (grid_rows, grid_cols)",
    "fleiss_kappa": _U + ", f AS (SELECT pair_id, sum(c * c) AS sq FROM c GROUP BY 1 HAVING sum(c) = 5), o AS (SELECT count(*) AS items, avg((sq - 5) / 20.0::DOUBLE) AS observed FROM f), s AS (SELECT kind, sum(c) AS c FROM c WHERE pair_id IN (SELECT pair_id FROM f) GROUP BY 1), e AS (SELECT (sum(c * c) / (sum(c) * sum(c))::DOUBLE) AS expected FROM s) SELECT items, round(observed, 6) AS observed, round(expected, 6) AS expected, round((observed - expected) / (1 - expected), 6) AS kappa FROM o, e",
    "modal_agreement": _U + "SELECT pair_id, arg_min(kind, {'a': -c, 'b': kind}) AS mode, round(max(c) / sum(c)::DOUBLE, 6) AS mode_share, count(*) AS labels, CAST(sum(c) AS BIGINT) AS n, string_agg(kind || ':' || c, ',' ORDER BY c DESC, kind) AS distribution, round(CASE WHEN sum(c) > 1 THEN sum(c * (c - 1)) / (sum(c) * (sum(c) - 1))::DOUBLE END, 6) AS pair_agreement FROM c GROUP BY 1",
    "pairwise_agreement": _U + ", q AS (SELECT pair_id, sum(c) AS n, sum(c * (c - 1)) AS same FROM c GROUP BY 1 HAVING sum(c) > 1) SELECT round(sum(same) / sum(n * (n - 1))::DOUBLE, 6) AS agreement, count_if(same = n * (n - 1)) AS unanimous, count_if(same < n * (n - 1)) AS split FROM q",
    "self_consistency": _U + "SELECT pair_id, count(*) AS runs, round(count_if(kind <> 'unrelated') / count(*)::DOUBLE, 6) AS dup_share, round(avg(confidence), 6) AS mean_confidence FROM u GROUP BY 1",
    "coalesced_verdicts": _P + ", u AS (SELECT DISTINCT a.test_id, a.corpus_id, lower(trim(r.match_type)) <> 'unrelated' AS v FROM rater_label r JOIN annotation a USING (pair_id) WHERE coalesce(trim(r.error), '') = '' AND r.match_type IS NOT NULL), x AS (SELECT test_id, corpus_id, max(checker_is_sd) AS a FROM p WHERE checker_is_sd IS NOT NULL GROUP BY 1, 2), y AS (SELECT test_id, corpus_id, max(v) AS b FROM u GROUP BY 1, 2), f AS (SELECT stage, dup, CASE WHEN kind = 'exact' THEN true WHEN kind IN ('equivalent', 'subset', 'superset') THEN coalesce(a, b, false) ELSE false END AS final FROM p LEFT JOIN x USING (test_id, corpus_id) LEFT JOIN y USING (test_id, corpus_id)) SELECT stage, count_if(final) AS final_dups, count_if(dup) AS dups, count(*) AS n FROM f GROUP BY 1",
    "label_agreement": _P + ", a AS (SELECT stage, test_id, corpus_id, max(dup) AS x FROM p GROUP BY 1, 2, 3), b AS (SELECT stage, test_id, corpus_id, max(checker_is_sd) AS y FROM p WHERE checker_is_sd IS NOT NULL GROUP BY 1, 2, 3) SELECT count(*) AS overlap, count_if(x = y) AS agree, count_if(x AND NOT y) AS only_first, count_if(NOT x AND y) AS only_second FROM a JOIN b USING (stage, test_id, corpus_id)",
    "validation_issues": "WITH r AS (SELECT *, lower(trim(match_type)) AS kind FROM annotation), i AS (SELECT 'confidence_out_of_range' AS issue FROM r WHERE NOT confidence BETWEEN 0 AND 1 UNION ALL SELECT 'score_out_of_range' FROM r WHERE isnan(score) OR NOT score BETWEEN 0 AND 1 UNION ALL SELECT 'missing_score' FROM r WHERE score IS NULL UNION ALL SELECT 'missing_label' FROM r WHERE success AND is_sd IS NULL UNION ALL SELECT 'unknown_match_type' FROM r WHERE kind NOT IN (" + ", ".join(f"'{k}'" for k in ann.MATCH_TYPES) + ") UNION ALL SELECT 'missing_test_text' FROM r WHERE coalesce(trim(test_text), '') = '' UNION ALL SELECT 'failed_without_error' FROM r WHERE NOT success AND coalesce(trim(error), '') = '' UNION ALL SELECT 'contradicting_flag' FROM r WHERE is_sd <> (kind <> 'unrelated') UNION ALL SELECT 'duplicate_key' FROM (SELECT 1 FROM annotation GROUP BY dataset, test_id, corpus_id HAVING count(*) > 1)) SELECT issue, count(*) AS n FROM i GROUP BY 1",
    "merge_new_keys": "WITH a AS (SELECT min(annotation_id) AS id, benchmark, test_id, corpus_id FROM annotation WHERE annotation_id % 3 = 0 GROUP BY ALL), b AS (SELECT min(annotation_id) AS id, benchmark, test_id, corpus_id FROM annotation WHERE annotation_id % 3 <> 0 GROUP BY ALL) SELECT id AS annotation_id FROM a UNION ALL SELECT id FROM b ANTI JOIN a USING (benchmark, test_id, corpus_id)",
    "resume_anti_join": "SELECT annotation_id FROM annotation WHERE pair_id NOT IN (SELECT pair_id FROM annotation WHERE annotation_id % 2 = 0)",
    "set_overlaps": "WITH k AS (SELECT DISTINCT test_id || '|' || corpus_id AS k, is_sd, lower(trim(dataset)) LIKE 'forum%' AS fo FROM annotation), f AS (SELECT k, 1 AS a, max(coalesce(is_sd, false)::INT) AS d, max(fo::INT) AS f FROM k GROUP BY 1), s AS (SELECT count(*) AS na, sum(d) AS nd, sum(f) AS nf, sum(d * f) AS df FROM f), o AS (SELECT 'annotated' AS a, 'duplicate' AS b, na AS size_a, nd AS size_b, nd AS common FROM s UNION ALL SELECT 'annotated', 'forum', na, nf, nf FROM s UNION ALL SELECT 'duplicate', 'forum', nd, nf, df FROM s) SELECT a, b, CAST(size_a AS BIGINT) AS size_a, CAST(size_b AS BIGINT) AS size_b, CAST(common AS BIGINT) AS common, round(CASE WHEN least(size_a, size_b) > 0 THEN 100 * common / least(size_a, size_b)::DOUBLE ELSE 0.0 END, 6) AS pct_of_smaller FROM o",
    "cost_estimate": "SELECT lower(trim(dataset)) AS stage, round((sum(tokens_input) * 0.5::DOUBLE + count(*) * 600.0::DOUBLE) / 1000000::DOUBLE, 6) AS cost, count(*) AS n FROM annotation GROUP BY 1",
    "running_index": "SELECT annotation_id, CAST(row_number() OVER (PARTITION BY test_id ORDER BY annotation_id) - 1 AS INTEGER) AS index FROM annotation",
    "top_percent_by_weight": _P + ", r AS (SELECT annotation_id, row_number() OVER (PARTITION BY stage ORDER BY score * score DESC, annotation_id) AS rank, count(*) OVER (PARTITION BY stage) AS n FROM p) SELECT annotation_id FROM r WHERE rank <= greatest(1, floor(n * 5 / 100))",
    "above_group_mean": _P + ", m AS (SELECT stage, round(avg(round(score, 5)), 9) AS mean FROM p GROUP BY 1) SELECT annotation_id FROM p JOIN m USING (stage) WHERE round(score, 5) > mean",
    "summary_statistics": _P + "SELECT stage, kind, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY stage)::DOUBLE, 6) AS pct FROM p GROUP BY 1, 2",
}
QUERIES = {name: globals()[name] for name in ORACLE}
