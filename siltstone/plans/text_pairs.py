"""Queries on pairs of texts: every annotated pair that has both."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import similarity as sim
from siltstone.plans.similarity import rounded
from siltstone.runtime import spread, table

A, B = "test_text", "corpus_text"


def text_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "annotation", "annotation_id", "test_text", "corpus_text")
    return spread(rows.where("test_text is not null and corpus_text is not null"))


def measured(name, column):
    def query(spark, sf_dir):
        return rounded(text_pairs(spark, sf_dir).select("annotation_id", column().alias("value")))

    query.__name__ = name
    return query


def number_preservation(spark, sf_dir):
    kept, precision, recall = sim.number_preservation(F.col(A), F.col(B))
    return rounded(text_pairs(spark, sf_dir).select("annotation_id", kept.alias("kept"), precision.alias("number_precision"), recall.alias("number_recall")))


def pair_metrics(spark, sf_dir):
    return text_pairs(spark, sf_dir).select("annotation_id", sim.pair_metrics(F.col(A), F.col(B)).alias("m")).select("annotation_id", "m.*").select("*", "overlaps.*").drop("overlaps")


def metric_summary(spark, sf_dir):
    """Distribution of measures for each dataset."""
    rows = table(spark, sf_dir, "annotation", "dataset", "test_text", "corpus_text").where("test_text is not null and corpus_text is not null")
    made = spread(rows).select(F.lower(F.trim("dataset")).alias("dataset"), sim.token_jaccard(F.col(A), F.col(B)).alias("j"), sim.length_ratio(F.col(A), F.col(B)).alias("r"))
    return rounded(made.groupBy("dataset").agg(F.count("j").alias("n"), F.avg("j").alias("mean_jaccard"), F.percentile("j", F.lit(0.5)).alias("median_jaccard"), F.stddev_samp("r").alias("std_ratio")))


_W = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{M}}\p{{N}}_]+')"
_SW = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> '')"
_PAIRS = "(SELECT annotation_id, test_text AS a, corpus_text AS b FROM annotation WHERE test_text IS NOT NULL AND corpus_text IS NOT NULL)"


def _sets(words: str, n: int) -> str:
    """CTE s: for each pair the distinct runs x and y."""
    run = "list_distinct([array_to_string(list_slice({0}, i, i + " + str(n - 1) + "), chr(31)) FOR i IN range(1, len({0}) - " + str(n - 2) + ")])"
    return f"WITH w AS (SELECT annotation_id, {words.format('a')} AS p, {words.format('b')} AS q FROM {_PAIRS}), s AS (SELECT annotation_id, {run.format('p')} AS x, {run.format('q')} AS y FROM w) "


def _chars(n: int, norm: str = "lower({0})") -> str:
    run = "list_distinct([substr({0}, i, " + str(n) + ") FOR i IN range(1, length({0}) - " + str(n - 2) + ")])"
    return f"WITH w AS (SELECT annotation_id, {norm.format('a')} AS p, {norm.format('b')} AS q FROM {_PAIRS}), s AS (SELECT annotation_id, {run.format('p')} AS x, {run.format('q')} AS y FROM w) "


_COMMON = "len(list_intersect(x, y))"
_J = f"CASE WHEN len(x) = 0 AND len(y) = 0 THEN {{0}} WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE {_COMMON} / (len(x) + len(y) - {_COMMON})::DOUBLE END"

MEASURES = {
    "space_ngram_jaccard_3": (lambda: sim.ngram_jaccard(F.col(A), F.col(B), 3), _sets(_SW, 3) + f"SELECT annotation_id, round({_J.format('1.0')}, 6) AS value FROM s"),
    "space_ngram_jaccard_4": (lambda: sim.ngram_jaccard(F.col(A), F.col(B), 4), _sets(_SW, 4) + f"SELECT annotation_id, round({_J.format('1.0')}, 6) AS value FROM s"),
    "ngram_coverage": (lambda: sim.ngram_coverage(F.col(A), F.col(B), 3), _sets(_SW, 3) + f"SELECT annotation_id, round(CASE WHEN len(x) = 0 THEN 1.0 WHEN len(y) = 0 THEN 0.0 ELSE {_COMMON} / len(x)::DOUBLE END, 6) AS value FROM s"),
    "word_ngram_overlap": (lambda: sim.word_overlap(F.col(A), F.col(B), 2), _sets(_W, 2) + f"SELECT annotation_id, round(100 * ({_J.format('0.0')}), 6) AS value FROM s"),
    "char_ngram_overlap": (lambda: sim.char_overlap(F.col(A), F.col(B), 3), _chars(3) + f"SELECT annotation_id, round(100 * ({_J.format('0.0')}), 6) AS value FROM s"),
    "char_ngram_jaccard_5": (lambda: sim.short_safe_char_jaccard(F.col(A), F.col(B), 5), _chars(5, r"trim(regexp_replace(lower({0}), '\s+', ' ', 'g'))") + f"SELECT annotation_id, round({_J.format('0.0')}, 6) AS value FROM s"),
    "token_jaccard": (lambda: sim.token_jaccard(F.col(A), F.col(B)), _sets(_W, 1) + f"SELECT annotation_id, round({_J.format('0.0')}, 6) AS value FROM s"),
    "length_ratio": (lambda: sim.length_ratio(F.col(A), F.col(B)), f"SELECT annotation_id, round(CASE WHEN len({_W.format('a')}) = 0 THEN 0.0 ELSE len({_W.format('b')}) / len({_W.format('a')})::DOUBLE END, 6) AS value FROM {_PAIRS}"),
    "bow_cosine": (lambda: sim.bag_cosine(F.col(A), F.col(B)), f"""
WITH w AS (SELECT annotation_id, {_SW.format('a')} AS p, {_SW.format('b')} AS q FROM {_PAIRS}),
c AS (SELECT annotation_id, t, count_if(side = 0) AS m, count_if(side = 1) AS n FROM (SELECT annotation_id, 0 AS side, unnest(p) AS t FROM w UNION ALL SELECT annotation_id, 1, unnest(q) FROM w) GROUP BY 1, 2)
SELECT annotation_id, round(coalesce(max(CASE WHEN len(p) = 0 AND len(q) = 0 THEN 1.0 WHEN len(p) = 0 OR len(q) = 0 THEN 0.0 END), sum(m * n)::DOUBLE / sqrt(sum(m * m)::DOUBLE * sum(n * n)::DOUBLE)), 6) AS value FROM w LEFT JOIN c USING (annotation_id) GROUP BY 1"""),
    "tfidf_cosine": (lambda: sim.tfidf_cosine(F.col(A), F.col(B)), f"SELECT annotation_id, 0.0::DOUBLE AS value FROM {_PAIRS}"),
}

_N = r"list_distinct(regexp_extract_all({0}, '\b\d+\.?\d*\b'))"
ORACLE = {name: sql for name, (_, sql) in MEASURES.items()} | {
    "number_preservation": f"WITH s AS (SELECT annotation_id, {_N.format('a')} AS x, {_N.format('b')} AS y FROM {_PAIRS}) SELECT annotation_id, len(x) = {_COMMON} AND len(y) = {_COMMON} AS kept, round(CASE WHEN len(y) = 0 THEN 1.0 ELSE {_COMMON} / len(y)::DOUBLE END, 6) AS number_precision, round(CASE WHEN len(x) = 0 THEN 1.0 ELSE {_COMMON} / len(x)::DOUBLE END, 6) AS number_recall FROM s",
    "metric_summary": f"WITH s AS (SELECT lower(trim(dataset)) AS dataset, list_distinct({_W.format('test_text')}) AS x, list_distinct({_W.format('corpus_text')}) AS y, len({_W.format('corpus_text')}) / nullif(len({_W.format('test_text')}), 0)::DOUBLE AS r FROM annotation WHERE test_text IS NOT NULL AND corpus_text IS NOT NULL), j AS (SELECT dataset, {_J.format('0.0')} AS j, coalesce(r, 0) AS r FROM s) SELECT dataset, count(j) AS n, round(avg(j), 6) AS mean_jaccard, round(quantile_cont(j, 0.5), 6) AS median_jaccard, round(stddev_samp(r), 6) AS std_ratio FROM j GROUP BY 1",
}
QUERIES = {name: measured(name, column) for name, (column, _) in MEASURES.items()} | {
    "number_preservation": number_preservation,
    "metric_summary": metric_summary,
    "rouge_l": measured("rouge_l", lambda: sim.rouge_l(F.col(A), F.col(B))),
    "word_edit_distance": measured("word_edit_distance", lambda: sim.word_edit_distance(F.col(A), F.col(B))),
    "pair_metrics": pair_metrics,
}
