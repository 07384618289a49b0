"""Queries on vectors: test vectors are every tenth one, the others are the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.operators import distribution as dist
from siltstone.operators import vectors as vec
from siltstone.runtime import materialize, table
from siltstone.sources.writers import matches_document

K = 10


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    tests = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("test_id"), "embedding", F.col("label").alias("test_label"))
    corpus = rows.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("corpus_id"), "embedding", F.col("label").alias("corpus_label"))
    return tests, corpus


def rounded(df: DataFrame, *keep: str, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes))


def topk_cosine(spark, sf_dir):
    return vec.top_matches(*sides(spark, sf_dir), k=K)


def topk_nonnegative(spark, sf_dir):
    return vec.top_matches(*sides(spark, sf_dir), k=K, least=0.0)


def global_top_matches(spark, sf_dir):
    best = vec.top_matches(*sides(spark, sf_dir), k=K)
    return best.orderBy(F.col("score").desc(), "test_id", "corpus_id").limit(100).select("test_id", "corpus_id", "score")


def matches_with_metadata(spark, sf_dir):
    tests, corpus = sides(spark, sf_dir)
    best = vec.top_matches(tests, corpus, k=K)
    return best.join(tests.select("test_id", "test_label"), "test_id").join(corpus.select("corpus_id", "corpus_label"), "corpus_id", "left")


def per_test_score_stats(spark, sf_dir):
    tests, corpus = sides(spark, sf_dir)
    partials = materialize(vec.score_partials(tests, corpus, bins=2_000, clip=True))
    median = vec.score_quantiles(tests, corpus, {"median_score": 50.0}, partials=partials)
    return rounded(vec.moments(partials).join(median, "test_id"))


def streamed_score_stats(spark, sf_dir):
    """Moments and quantiles from partial sums: no score leaves its task."""
    tests, corpus = sides(spark, sf_dir)
    partials = materialize(vec.score_partials(tests, corpus, bins=2_000, clip=True))
    quantiles = vec.score_quantiles(tests, corpus, {"p50": 50.0, "p90": 90.0, "p95": 95.0, "p99": 99.0}, partials=partials)
    return rounded(vec.moments(partials).join(quantiles, "test_id"))


def aggregate_score_stats(spark, sf_dir):
    per_test = vec.moments(vec.score_partials(*sides(spark, sf_dir), bins=1))
    return rounded(per_test.agg(F.avg("max_score").alias("mean_max"), F.max("max_score").alias("max_max"), F.min("max_score").alias("min_max"), F.avg("mean_score").alias("mean_mean"), F.stddev_pop("max_score").alias("std_max"), F.sum("n").alias("comparisons"), F.count(F.lit(1)).alias("tests")))


def topk_cut_scores(spark, sf_dir):
    best = vec.top_matches(*sides(spark, sf_dir), k=100)
    return dist.cut_scores(best, "test_id")


def max_similarity_per_item(spark, sf_dir):
    partials = vec.score_partials(*sides(spark, sf_dir), bins=1)
    return partials.groupBy("test_id").agg(F.greatest(F.lit(0.0), F.max("most")).alias("max_score"))


def similarity_threshold_rates(spark, sf_dir):
    return rounded(vec.score_rates(*sides(spark, sf_dir), levels=(0.1, 0.2, 0.3, 0.7)))


def similarity_percentiles(spark, sf_dir):
    return rounded(vec.score_quantiles(*sides(spark, sf_dir), percents={f"p{p:g}".replace(".", "_"): p for p in dist.PERCENTS}))


def similarity_histogram(spark, sf_dir):
    partials = vec.score_partials(*sides(spark, sf_dir), bins=200, clip=True)
    return partials.groupBy("bin").agg(F.sum("n").alias("n")).withColumn("weighted", F.col("n") * F.lit(2.0))


def histogram_percentile_threshold(spark, sf_dir):
    partials = vec.score_partials(*sides(spark, sf_dir))
    total = partials.groupBy("test_id").agg(F.sum("n").alias("total"))
    return rounded(dist.counts_threshold(partials.where("bin >= 0").select("test_id", "bin", "n"), total, "test_id", 99.0, -1.0, 1.0, 10_000))


def labels_of(tests: DataFrame) -> DataFrame:
    return tests.select("test_id", F.col("test_label").alias("label"))


def similarity_cdf(spark, sf_dir):
    tests, corpus = sides(spark, sf_dir)
    return rounded(vec.score_cdf(tests, corpus, labels_of(tests), "label"))


def top_percentile_sample(spark, sf_dir):
    tests, corpus = sides(spark, sf_dir)
    cuts = vec.score_quantiles(tests, corpus, {"cut": 95.0})
    return vec.score_sample(tests, corpus, 3, cuts, seed=7).select("test_id", "corpus_id", "score")


def top_and_random_check(spark, sf_dir):
    """Five best and five random others of each test: of ten drawn from all, five at most are among the best."""
    tests, corpus = sides(spark, sf_dir)
    best = materialize(vec.top_matches(tests, corpus, k=5).select("test_id", "corpus_id"))
    others = vec.score_sample(tests, corpus, 10, seed=3).join(best, ["test_id", "corpus_id"], "left_anti")
    order = Window.partitionBy("test_id").orderBy("pick")
    random = others.withColumn("place", F.row_number().over(order)).where("place <= 5")
    return best.withColumn("part", F.lit("best")).unionByName(random.select("test_id", "corpus_id", F.lit("random").alias("part")))


def semantic_dedup(spark, sf_dir):
    tests, corpus = sides(spark, sf_dir)
    return vec.drop_similar(corpus, tests, 0.3).select("corpus_id")


def percentile_rank_vs_background(spark, sf_dir):
    tests, corpus = sides(spark, sf_dir)
    return rounded(vec.best_percentiles(tests, corpus, labels_of(tests), "label"), "best")


def vector_norms(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    unit = rows.select("vec_id", F.round(vec.norm("embedding"), 6).alias("length"), vec.l2_normalized("embedding").alias("unit"))
    return unit.select("vec_id", "length", F.round(F.aggregate("unit", F.lit(0.0), lambda a, x: a + x * x), 6).alias("unit_length"), F.size("unit").alias("dims"))


def verify_stored_scores(spark, sf_dir):
    """Stored against recomputed scores of the best matches, with the tolerance of 0.01."""
    tests, corpus = sides(spark, sf_dir)
    best = vec.top_matches(tests, corpus, k=3).withColumn("stored", F.round("score", 2))
    joined = best.join(tests.select("test_id", F.col("embedding").alias("a")), "test_id").join(corpus.select("corpus_id", F.col("embedding").alias("b")), "corpus_id")
    off = joined.select("test_id", F.abs(F.round(vec.cosine("a", "b"), 6) - F.col("stored")).alias("off"))
    return rounded(off.groupBy("test_id").agg(F.max("off").alias("max_off"), F.avg("off").alias("mean_off"), F.count_if(F.col("off") <= 0.01).alias("within")))


def result_json(spark, sf_dir):
    """One JSON document a test: its matches in order and its statistics."""
    tests, corpus = sides(spark, sf_dir)
    best = vec.top_matches(tests, corpus, k=3).select("test_id", "rank", "score", "corpus_id")
    stats = vec.moments(vec.score_partials(tests, corpus, bins=1, clip=True)).select("test_id", "max_score", "n")
    doc = F.col("document")
    read = matches_document(best, "test_id", stats)
    return read.select("test_id", F.get_json_object(doc, "$.top[0].corpus_id").cast("bigint").alias("first_corpus_id"), F.get_json_object(doc, "$.top[2].rank").cast("int").alias("third_rank"), F.get_json_object(doc, "$.stats.n").cast("bigint").alias("n"))


_SCORED = """
WITH t AS (SELECT vec_id AS test_id, embedding::DOUBLE[] AS a, label AS test_label FROM embeddings WHERE vec_id % 10 = 0),
c AS (SELECT vec_id AS corpus_id, embedding::DOUBLE[] AS b, label AS corpus_label FROM embeddings WHERE vec_id % 10 <> 0),
scored AS (SELECT test_id, corpus_id, test_label, corpus_label, round(list_cosine_similarity(a, b), 6) AS score FROM t, c),
ranked AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY score DESC, corpus_id) AS rank FROM scored)
"""
_MD5 = "md5(concat_ws(':', '{0}', test_id::VARCHAR, corpus_id::VARCHAR))"
_STATS = "max(score) AS max_score, min(score) AS min_score, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, round(quantile_cont(score, 0.5), 6) AS median_score, count(score) AS n"

ORACLE = {
    "topk_cosine": _SCORED + "SELECT test_id, CAST(rank AS INTEGER) AS rank, corpus_id, score FROM ranked WHERE rank <= 10",
    "topk_nonnegative": _SCORED + "SELECT test_id, CAST(rank AS INTEGER) AS rank, corpus_id, score FROM ranked WHERE rank <= 10 AND score >= 0",
    "global_top_matches": _SCORED + "SELECT test_id, corpus_id, score FROM ranked WHERE rank <= 10 ORDER BY score DESC, test_id, corpus_id LIMIT 100",
    "matches_with_metadata": _SCORED + "SELECT test_id, CAST(rank AS INTEGER) AS rank, corpus_id, score, test_label, corpus_label FROM ranked WHERE rank <= 10",
    "per_test_score_stats": _SCORED + f"SELECT test_id, {_STATS} FROM scored GROUP BY test_id",
    "streamed_score_stats": _SCORED + "SELECT test_id, max(score) AS max_score, min(score) AS min_score, round(avg(score), 6) AS mean_score, round(stddev_pop(score), 6) AS std_score, count(*) AS n, " + ", ".join(f"round(quantile_cont(score, {p / 100}), 6) AS p{p}" for p in (50, 90, 95, 99)) + " FROM scored GROUP BY test_id",
    "aggregate_score_stats": _SCORED + ", s AS (SELECT test_id, max(score) AS mx, avg(score) AS av, count(*) AS n FROM scored GROUP BY test_id) SELECT round(avg(mx), 6) AS mean_max, max(mx) AS max_max, min(mx) AS min_max, round(avg(av), 6) AS mean_mean, round(stddev_pop(mx), 6) AS std_max, CAST(sum(n) AS BIGINT) AS comparisons, count(*) AS tests FROM s",
    "topk_cut_scores": _SCORED + "SELECT test_id, " + ", ".join(f"max(CASE WHEN rank = {k} THEN score END) AS top_{k}" for k in (1, 10, 50, 100)) + " FROM ranked GROUP BY test_id",
    "max_similarity_per_item": _SCORED + "SELECT test_id, greatest(0.0, max(score)) AS max_score FROM scored GROUP BY test_id",
    "similarity_threshold_rates": _SCORED + "SELECT test_id, " + ", ".join(f"count_if(score >= {v}) AS n_{round(v * 100)}, round(count_if(score >= {v}) * 100 / count(*)::DOUBLE, 6) AS pct_{round(v * 100)}" for v in (0.1, 0.2, 0.3, 0.7)) + " FROM scored GROUP BY test_id",
    "similarity_percentiles": _SCORED + "SELECT test_id, " + ", ".join(f"round(quantile_cont(score, {p}), 6) AS {n}" for p, n in ((0.5, "p50"), (0.75, "p75"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"), (0.999, "p99_9"))) + " FROM scored GROUP BY test_id",
    "similarity_histogram": _SCORED + "SELECT CAST(least(greatest(floor((score - -1.0) / 0.01), 0), 199) AS INTEGER) AS bin, count(*) AS n, count(*) * 2.0::DOUBLE AS weighted FROM scored GROUP BY 1",
    "histogram_percentile_threshold": _SCORED + """,
b AS (SELECT test_id, least(greatest(floor((score - -1.0) / 0.0002), 0), 9999) AS bin, count(*) AS n FROM scored WHERE score BETWEEN -1 AND 1 GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY test_id ORDER BY bin DESC) AS above FROM b),
tot AS (SELECT test_id, count(*) AS total FROM scored GROUP BY test_id)
SELECT test_id, total, CAST(floor(total * (1 - 99.0::DOUBLE / 100)) AS BIGINT) AS wanted, round(-1.0 + (max(bin) + 0.5) * 0.0002, 6) AS threshold
FROM s JOIN tot USING (test_id) WHERE above >= CAST(floor(total * (1 - 99.0::DOUBLE / 100)) AS BIGINT) GROUP BY ALL""",
    "similarity_cdf": _SCORED + ", r AS (SELECT test_label AS label, round(list_cosine_similarity(a, b), 2) AS score FROM t, c) SELECT DISTINCT label, score, round(cume_dist() OVER (PARTITION BY label ORDER BY score), 6) AS cdf FROM r",
    "top_percentile_sample": _SCORED + f", q AS (SELECT test_id, quantile_cont(score, 0.95) AS cut FROM scored GROUP BY 1), k AS (SELECT scored.*, row_number() OVER (PARTITION BY test_id ORDER BY {_MD5.format(7)}, corpus_id) AS pick FROM scored JOIN q USING (test_id) WHERE score >= cut) SELECT test_id, corpus_id, score FROM k WHERE pick <= 3",
    "top_and_random_check": _SCORED + f", o AS (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY {_MD5.format(3)}, corpus_id) AS pick FROM ranked WHERE rank > 5) SELECT test_id, corpus_id, 'best' AS part FROM ranked WHERE rank <= 5 UNION ALL SELECT test_id, corpus_id, 'random' FROM o WHERE pick <= 5",
    "semantic_dedup": _SCORED + "SELECT corpus_id FROM (SELECT corpus_id, max(list_cosine_similarity(a, b)) AS m FROM t, c GROUP BY 1) WHERE m < 0.3",
    "percentile_rank_vs_background": _SCORED + ", b AS (SELECT test_label AS label, test_id, max(score) AS best FROM scored GROUP BY ALL) SELECT b.label, b.test_id, b.best, round(100.0::DOUBLE * count_if(s.score < b.best) / count(*), 6) AS pct FROM b JOIN scored s ON s.test_label = b.label GROUP BY ALL",
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS length, 1.0::DOUBLE AS unit_length, CAST(len(embedding) AS INTEGER) AS dims FROM embeddings",
    "verify_stored_scores": _SCORED + "SELECT test_id, round(max(abs(score - round(score, 2))), 6) AS max_off, round(avg(abs(score - round(score, 2))), 6) AS mean_off, count_if(abs(score - round(score, 2)) <= 0.01) AS within FROM ranked WHERE rank <= 3 GROUP BY test_id",
    "result_json": _SCORED + "SELECT test_id, max(CASE WHEN rank = 1 THEN corpus_id END) AS first_corpus_id, CAST(3 AS INTEGER) AS third_rank, count(*) AS n FROM ranked GROUP BY test_id",
}

QUERIES = {name: globals()[name] for name in ORACLE}
