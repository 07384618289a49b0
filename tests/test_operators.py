"""Relational operators on small tables."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.functions.statistics import average_ranks
from siltstone.functions.text import refine_reason
from siltstone.operators import annotation, dedup, distribution, evaluation, joins, ranking, sampling, vectors
from siltstone.streaming import incremental


def vectors_of(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} long, embedding array<float>")


def test_top_matches_ties_zero_and_blocks(spark, monkeypatch):
    tests = vectors_of(spark, [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "test_id")
    corpus = vectors_of(spark, [(10, [2.0, 0.0]), (11, [1.0, 0.0]), (12, [0.0, 0.0]), (13, [-1.0, 0.0]), (14, None)], "corpus_id")
    want = [(1, 1, 10, 1.0), (1, 2, 11, 1.0), (2, 1, 10, 0.0), (2, 2, 11, 0.0)]
    assert sorted(tuple(r) for r in vectors.top_matches(tests, corpus, k=2).collect()) == want
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 2)
    assert sorted(tuple(r) for r in vectors.top_matches(tests, corpus, k=2).collect()) == want
    assert vectors.top_matches(tests.limit(0), corpus, k=2).count() == 0 and vectors.top_matches(tests, corpus.limit(0), k=2).count() == 0
    assert sorted(r.corpus_id for r in vectors.drop_similar(corpus, tests, 0.9).collect()) == [12, 13, 14]


def test_cosine_expression(spark):
    df = spark.sql("select array(1f, 2f) as a, array(2f, 4f) as b, array(0f, 0f) as z, array(1f) as s")
    assert df.select(vectors.cosine("a", "b")).first()[0] == pytest.approx(1) and df.select(vectors.cosine("a", "z")).first()[0] == 0
    with pytest.raises(Exception, match="dimension"):
        df.select(vectors.cosine("a", "s")).collect()


def test_bins_edges_and_single_value(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (None,)], "x double")
    assert [r.bin for r in annotation.equal_width_bins(df, "x", 2).orderBy("x").collect()] == [None, 1, 1, 2]
    same = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    assert {r.bin for r in annotation.equal_width_bins(same, "x", 5).collect()} == {1}
    assert annotation.equal_width_bins(df.limit(0), "x", 2).count() == 0
    assert [r.bin for r in annotation.fixed_bins(spark.createDataFrame([(0.3,), (0.31,), (1.0,), (1.1,)], "x double"), "x", 0.3, 1.0, 7).orderBy("x").collect()] == [1, 7]


def test_histogram_threshold_and_outside_values(spark):
    df = spark.createDataFrame([("a", x / 100) for x in range(100)] + [("a", 5.0)], "g string, s double")
    got = distribution.histogram_threshold(df, "g", "s", 90.0, 0.0, 1.0, 100).first()
    assert got.total == 101 and got.wanted == 10 and got.threshold == pytest.approx(0.905)
    assert distribution.histogram(df, "s", 0.0, 1.0, 10, clip=False).agg(F.sum("n")).first()[0] == 100
    assert distribution.histogram(df, "s", 0.0, 1.0, 10).agg(F.sum("n")).first()[0] == 101


def test_percentile_of_strict_ties_and_missing(spark):
    values = spark.createDataFrame([("a", 2.0), ("b", 1.0)], "g string, v double")
    back = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 2.0, 3.0, float("nan"))], "g string, s double")
    assert {r.g: r.pct for r in distribution.percentile_of(values, back, "v", "s", "g").collect()} == {"a": 25.0, "b": 0.0}


@pytest.mark.parametrize("counts, n, want", [({"a": 10, "b": 10}, 7, {"a": 4, "b": 3}), ({"a": 1, "b": 10}, 8, {"a": 1, "b": 7}), ({"a": 1, "b": 1}, 8, {"a": 1, "b": 1}), ({}, 3, {"a": 0, "b": 0})])
def test_quotas(counts, n, want):
    assert sampling.quotas(counts, n, ["a", "b"]) == want


def test_samples(spark):
    df = spark.createDataFrame([(i, "ab"[i % 10 == 0], float(i % 3)) for i in range(200)], "i long, c string, w double")
    assert sampling.uniform_sample(df, "i", 500).count() == 200 and sampling.uniform_sample(df, "i", 7).count() == 7
    got = Counter(r.c for r in sampling.stratified_sample(df, "c", "i", total=50).collect())
    assert got == {"a": 45, "b": 5}
    assert Counter(r.c for r in sampling.replicated_sample(df, "c", "i", 33).collect()) == {"a": 33, "b": 33}
    zero = spark.createDataFrame([(i, 0.0) for i in range(5)], "i long, w double").withColumn("g", F.lit(1))
    assert sampling.weighted_sample(zero, ["g"], "i", "w", 3).count() == 3
    split = Counter((r.f, r.part) for r in sampling.train_val_split(df.withColumn("f", F.col("c") == "b"), "f", "i").collect())
    assert split == {(True, "val"): 4, (True, "train"): 16, (False, "val"): 12, (False, "train"): 160, (False, "unused"): 8}
    assert sampling.class_ratio_downsample(df.withColumn("f", F.col("c") == "b"), "f", "i", 2).count() == 60


def test_weighted_sample_follows_the_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("i"), F.floor(F.col("id") / 2).alias("g"), F.when(F.col("id") % 2 == 0, 3.0).otherwise(1.0).alias("w"))
    heavy = sampling.weighted_sample(df, ["g"], "i", "w", 1).where("w = 3").count()
    assert heavy / 2000 == pytest.approx(0.75, abs=0.03)


def test_keep_first_merge_and_overlaps(spark):
    df = spark.createDataFrame([(1, "x", None), (2, "x", "b"), (3, "y", "c"), (4, None, "d"), (5, None, "e")], "i int, k string, v string")
    assert sorted(r.i for r in dedup.keep_first(df, ["k"], ["i"]).collect()) == [1, 3, 4]
    new = spark.createDataFrame([(9, "y"), (7, "z"), (8, "z")], "i int, k string")
    assert sorted(r.i for r in dedup.merge_unseen(df, new, ["k"], ["i"]).collect()) == [1, 2, 3, 4, 5, 7]
    got = {(r.a, r.b): (r.size_a, r.size_b, r.common) for r in dedup.overlaps({"p": df.select("i"), "q": df.where("i > 3").select("i"), "r": df.where("i < 3").select("i")}, "i").collect()}
    assert got == {("p", "q"): (5, 2, 2), ("p", "r"): (5, 2, 2), ("q", "r"): (2, 2, 0)}


def test_lookups(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "zz")], "i int, k string")
    texts = spark.createDataFrame([("a", "old", 1), ("a", "new", 2)], "k string, t string, o int")
    assert {r.i: r.t for r in joins.hydrate(rows, texts, "k", "t", "o", "[NOT FOUND]").collect()} == {1: "new", 2: "[NOT FOUND]"}
    both = {r.k: (r.base, r.tuned, r.pct) for r in joins.metric_comparison(spark.createDataFrame([("x", 0.0), ("y", 2.0), ("b", 1.0)], "k string, v double"), spark.createDataFrame([("x", 1.0), ("y", 3.0), ("t", 1.0)], "k string, v double"), "k", "v").collect()}
    assert both == {"x": (0.0, 1.0, 0.0), "y": (2.0, 3.0, 50.0), "b": (1.0, None, None), "t": (None, 1.0, None)}
    sizes = [random.Random(1).randrange(9) for _ in range(200)]
    got = [r.start for r in ranking.running_offsets(spark.createDataFrame(list(enumerate(sizes)), "i int, n int"), "i", "n").orderBy("i").collect()]
    assert got == [sum(sizes[:i]) for i in range(200)]


def test_ranks_of_hot_and_null_groups(spark):
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else "cold", (i * 37) % 500, i) for i in range(500)]
    got = {r.i: r["rank"] for r in ranking.ranked(spark.createDataFrame(rows, "g string, v int, i int"), [-F.col("v"), "i"], "g").collect()}
    for g in (None, "hot", "cold"):
        own = sorted(((-v, i) for k, v, i in rows if k == g))
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert ranking.ranked(spark.createDataFrame([], "g string, i int"), ["i"], "g").count() == 0


def test_range_lookup_both_ways(spark, monkeypatch):
    ranges = spark.createDataFrame([(i, i * 10, i * 10 + 1 + i % 10) for i in range(30)], "r int, a int, b int")
    points = spark.range(310).select(F.col("id").cast("int").alias("p"))
    want = {(p, p // 10) for p in range(300) if p % 10 <= (p // 10) % 10}
    assert {(x.p, x.r) for x in joins.range_lookup(points, ranges, "p", "a", "b").collect()} == want
    monkeypatch.setattr(joins, "MAX_RANGES", 5)
    assert {(x.p, x.r) for x in joins.range_lookup(points, ranges, "p", "a", "b").collect()} == want


def test_minhash_estimates_and_drops(spark):
    a, b = "the quick brown fox jumps over the lazy dog again and again", "the quick brown fox jumps over the lazy dog again and once"
    df = spark.createDataFrame([(1, a), (2, b), (3, "something else entirely, with other words"), (4, "ab"), (5, None)], "i int, t string")
    sig = {r.i: r.s for r in df.select("i", joins.minhash(F.col("t"), 128).alias("s")).collect()}
    runs = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    same = np.mean(np.array(sig[1]) == np.array(sig[2]))
    assert same == pytest.approx(len(runs(a) & runs(b)) / len(runs(a) | runs(b)), abs=0.12) and sig[4] is None and sig[5] is None
    assert joins.best_bands(128, 0.8) == (9, 13)
    left = joins.minhash_decontaminated(df, df.where("i = 1").select("t"), "i", "t")
    assert sorted(r.i for r in left.collect()) in ([3, 4, 5], [2, 3, 4, 5])


def test_kappa_cases(spark):
    def kappa(rows, raters):
        return annotation.fleiss_kappa(annotation.label_counts(spark.createDataFrame(rows, "i int, l string"), "i", "l"), "i", "l", raters).first().kappa

    assert kappa([(1, "a"), (1, "a"), (2, "b"), (2, "b")], 2) == pytest.approx(1.0)
    assert kappa([(1, "a"), (1, "b"), (2, "b"), (2, "a")], 2) == pytest.approx(-1.0)
    assert kappa([(1, "a"), (1, "a")], 2) is None and kappa([(1, "a"), (2, "b")], 1) is None


def test_verdicts(spark):
    rows = spark.createDataFrame([(1, "exact"), (2, "subset"), (3, "subset"), (4, "subset"), (5, "related")], "k int, kind string")
    first = spark.createDataFrame([(2, True), (3, False), (1, False)], "k int, v boolean")
    second = spark.createDataFrame([(3, True), (4, True), (5, True)], "k int, v boolean")
    final = lambda **o: {r.k: r.final for r in annotation.coalesced_verdicts(rows, first, second, ["k"], "v", "kind", **o).collect()}
    assert final() == {1: True, 2: True, 3: False, 4: True, 5: False}
    assert final(override=True) == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_wilson_and_classification(spark):
    low, high = annotation.wilson(F.col("h"), F.col("n"))
    got = spark.createDataFrame([(0, 0), (5, 10), (10, 10)], "h int, n int").select(low, high).collect()
    assert tuple(got[0]) == (0.0, 0.0) and tuple(got[1]) == pytest.approx((0.23659, 0.76341), abs=1e-4) and got[2][1] == 1.0
    row = evaluation.classification(spark.createDataFrame([(True, True)], "t boolean, p boolean"), "t", "p").first()
    assert row.accuracy == 1.0 and row.mcc == 0.0 and row.precision_0 == 0.0


def test_signed_ranks_and_trials(spark):
    draw = random.Random(6)
    rows = [(1, i, draw.randrange(5) / 4, draw.randrange(5) / 4) for i in range(60)]
    got = evaluation.signed_ranks(spark.createDataFrame(rows, "k int, sample int, a double, b double"), ["k"]).first()
    d = np.array([a - b for *_, a, b in rows])
    d = d[d != 0]
    ranks = average_ranks(np.abs(d))
    assert (got.n, got.w_plus, got.w_minus) == (len(d), ranks[d > 0].sum(), ranks[d < 0].sum())
    trials = evaluation.expanded_trials(spark.createDataFrame([(1, 0.5, 5), (2, 0.0, 2)], "sample int, rate double, n int"), "sample", "rate", "n")
    assert {r.sample: (r.k, r.n) for r in trials.groupBy("sample").agg(F.sum("correct").alias("k"), F.count("run").alias("n")).collect()} == {1: (2, 5), 2: (0, 2)}


def test_paired_tests_of_equal_arms(spark):
    same = spark.createDataFrame([(1, i, 0.5, 0.5) for i in range(5)], "split int, sample int, a double, b double")
    row = evaluation.paired_tests(same, "split", 200).first()
    assert row["diff"] == 0 and row.w is None and row.t_p is None and row.shapiro_w is None
    counts = spark.createDataFrame([(1, 1, 3.0, 3.0, 1.0, 3.0), (1, 2, 3.0, 3.0, 2.0, 3.0)], "split int, sample int, hits_a double, trials_a double, hits_b double, trials_b double")
    assert evaluation.clustered_tests(counts, "split", 200).first().method == "wilcoxon"


def test_streams(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.col("id") * 600).cast("timestamp_ntz").alias("ts"), (F.col("id") % 3).alias("g"), ((F.col("id") * 37) % 101).cast("double").alias("value"))
    rows.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = incremental.event_stream(spark, str(tmp_path / "in"), rows.schema, late="1 day", maxFilesPerTrigger="1")
    incremental.keep_best(stream, str(tmp_path / "best"), str(tmp_path / "cp"), "g", "event_id", "value", 4).awaitTermination()
    last = max(int(p.name[2:]) for p in (tmp_path / "best").iterdir() if p.name.startswith("v="))
    got = {(r.g, r.event_id) for r in spark.read.parquet(str(tmp_path / f"best/v={last}")).collect()}
    want = sorted(((r.g, -r.value, r.event_id) for r in rows.collect()))
    assert got == {(g, e) for k in range(3) for g, _, e in [x for x in want if x[0] == k][:4]}
    counts = incremental.windowed_counts(stream, "ts", ["g"], "value", "6 hours")
    query = counts.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 200
    once = incremental.first_deliveries(stream.select("ts", "g"), ["g"]).writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 3


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8])
def test_set_similarity_join_against_brute_force(spark, threshold):
    draw = random.Random(8)
    rows = [(i, i % 3, sorted(set(draw.choice("abcdefghij") for _ in range(draw.randrange(9))))) for i in range(60)]
    got = {(r.a, r.b) for r in joins.set_similarity_join(spark.createDataFrame(rows, "k int, g int, v array<string>"), "k", "g", "v", threshold).collect()}
    want = {(a, b) for a, g, v in rows for b, h, w in rows if a < b and g != h and v and w and len(set(v) & set(w)) / len(set(v) | set(w)) >= threshold}
    assert got == want


def test_score_partials_against_all_scores(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(i, [float(x) for x in draw.normal(size=4)]) for i in range(60)]
    tests, corpus = vectors_of(spark, rows[:7], "test_id"), vectors_of(spark, rows[7:], "corpus_id")
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", 12)
    scores = {}
    for r in vectors.scored(tests, corpus).collect():
        scores.setdefault(r.test_id, []).append(round(r.score, 6))
    got = vectors.score_partials(tests, corpus, 0.0, 1.0, 10)
    for r in vectors.moments(got).collect():
        own = np.array(scores[r.test_id])
        assert (r.n, r.min_score, r.max_score) == (len(own), own.min(), own.max())
        assert (r.mean_score, r.std_score) == pytest.approx((own.mean(), own.std()), abs=1e-9)
    bins = {(r.test_id, r.bin): r.n for r in got.collect()}
    assert bins == {k: v for k, v in Counter((t, -1 if s < 0 else min(9, int(np.floor(s / 0.1)))) for t, own in scores.items() for s in own).items()}
    clipped = vectors.score_partials(tests, corpus, 0.0, 1.0, 10, clip=True).agg(F.sum("n"), F.min("bin")).first()
    assert tuple(clipped) == (7 * 53, 0) and vectors.score_partials(tests.limit(0), corpus).count() == 0


@pytest.mark.parametrize("numbers, batch", [(50_000_000, "10000"), (12, "5")])
def test_folds_of_scores_against_brute_force(spark, monkeypatch, numbers, batch):
    """One block and one batch a task, and several of both; equal vectors tie at the edge of the best."""
    monkeypatch.setattr(vectors, "BLOCK_NUMBERS", numbers)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    draw = np.random.default_rng(4)
    known = draw.normal(size=(9, 3))
    rows = [(i, known[i % 9].tolist()) for i in range(60)] + [(None, [1.0, 0.0, 0.0]), (99, None)]
    tests = spark.createDataFrame([(i, draw.normal(size=3).tolist()) for i in range(7)], "test_id long, embedding array<double>")
    corpus = spark.createDataFrame(rows, "corpus_id long, embedding array<double>").repartition(3)
    labels = tests.select("test_id", (F.col("test_id") % 2).alias("label"))
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    scores = {t.test_id: {c: round(float(unit(t.embedding) @ unit(v)), 6) for c, v in rows if c is not None and v} for t in tests.collect()}
    for k in (1, 4, 100):
        want = sorted((t, i + 1, c) for t, s in scores.items() for i, c in enumerate(sorted(s, key=lambda c: (-s[c], c))[:k]))
        assert sorted((r.test_id, r["rank"], r.corpus_id) for r in vectors.top_matches(tests, corpus, k=k).collect()) == want
    got = {r.test_id: (r.p0, r.p37, r.p50, r.p100) for r in vectors.score_quantiles(tests, corpus, {"p0": 0.0, "p37": 37.0, "p50": 50.0, "p100": 100.0}).collect()}
    for t, s in scores.items():
        assert got[t] == pytest.approx(np.quantile(list(s.values()), [0, 0.37, 0.5, 1]).tolist(), abs=1e-9)
    for r in vectors.score_rates(tests, corpus, (0.1, 0.5)).collect():
        s = list(scores[r.test_id].values())
        assert (r.n_10, r.n_50) == (sum(x >= 0.1 for x in s), sum(x >= 0.5 for x in s)) and r.pct_50 == pytest.approx(100 * r.n_50 / len(s))
    pooled = {g: [x for t, s in scores.items() if t % 2 == g for x in s.values()] for g in (0, 1)}
    for r in vectors.score_cdf(tests, corpus, labels, "label").collect():
        assert r.cdf == pytest.approx(np.mean(np.round(pooled[r.label], 2) <= r.score + 1e-9), abs=0.04)
    for r in vectors.best_percentiles(tests, corpus, labels, "label").collect():
        best = max(scores[r.test_id].values())
        assert r.best == best and r.pct == pytest.approx(100 * np.mean(np.array(pooled[r.label]) < best))
    cuts = spark.createDataFrame([(t, 0.2) for t in range(6)], "test_id long, cut double")
    got = sorted((r.test_id, r.pick, r.corpus_id) for r in vectors.score_sample(tests, corpus, 3, cuts, seed=5).collect())
    key = lambda t, c: (hashlib.md5(f"5:{t}:{c}".encode()).hexdigest(), c)
    assert got == sorted((t, i + 1, c) for t, s in scores.items() if t < 6 for i, c in enumerate(sorted((c for c in s if s[c] >= 0.2), key=lambda c: key(t, c))[:3]))
    assert vectors.score_quantiles(tests.limit(0), corpus, {"p": 50.0}).count() == 0 and vectors.score_sample(tests, corpus.limit(0), 2).count() == 0
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ranges_of_very_different_widths(spark, monkeypatch):
    draw = random.Random(3)
    cuts = sorted(draw.sample(range(100_000), 60)) + [10**9]
    rows = [(k, a, b - (k % 3)) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b - k % 3 > a]
    ranges = spark.createDataFrame(rows, "r int, a long, b long").repartition(3)
    points = spark.createDataFrame([(draw.randrange(-5, 120_000),) for _ in range(500)] + [(None,), (10**8,)], "p long").repartition(4)
    want = sorted((x.p, r) for x in points.collect() if x.p is not None for r, a, b in rows if a <= x.p < b)
    for most in (1000, 3):
        monkeypatch.setattr(joins, "MAX_RANGES", most)
        got = joins.range_lookup(points, ranges, "p", "a", "b")
        assert sorted((x.p, x.r) for x in got.collect()) == want
        assert "NestedLoop" not in got._jdf.queryExecution().toString() and joins.range_lookup(points, ranges.limit(0), "p", "a", "b").count() == 0


def test_balanced_sample_of_large_quotas(spark):
    df = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("kind"))
    got = sampling.balanced_sample(df, "kind", "id", 4000, ["a", "b", "c"], 1).groupBy("kind").count().collect()
    assert {r.kind: r["count"] for r in got} == {"a": 2500, "b": 1500}


def test_orders_and_reasons(spark):
    df = spark.createDataFrame([("s2", True, "word " * 30 + "http://x.y"), ("s1", True, "it is the case that " * 6), ("s3", None, None), ("s0", False, "")], "stage string, dup boolean, text string")
    got = {r.stage: (r.dup, r.demoted) for r in annotation.demoted(df, "dup", refine_reason(F.col("text"))).collect()}
    assert got == {"s2": (False, True), "s1": (True, False), "s3": (False, False), "s0": (False, False)}
    assert [(r.stage, r.stage_order) for r in annotation.of_stages(df, "stage", ["s1", "s2", "gone"]).orderBy("stage_order").collect()] == [("s1", 1), ("s2", 2)]
    kinds = spark.createDataFrame([(" Exact", "a", "b"), ("unrelated", "a", "b"), ("exact", " ", "b"), ("exact", "a", None)], "k string, x string, y string")
    assert annotation.readable_pairs(kinds, "k", "x", "y").count() == 1


def test_epochs_and_regression(spark):
    df = spark.createDataFrame([("checkpoint-167",), ("checkpoint-500",), ("final",), ("best",)], "c string")
    assert [r.epoch for r in evaluation.with_epochs(df, "c").collect()] == [1, 3, 4, None]
    assert [r.e for r in df.select(evaluation.epoch_of("c", final=11).alias("e")).collect()] == [1, 3, 11, None]
    fit = annotation.regression(spark.createDataFrame([(1.0, 2.0), (2.0, 2.5), (3.0, 3.9), (4.0, 3.8), (5.0, 6.0)], "x double, y double"), "x", "y").first()
    t = fit.r * np.sqrt(3 / (1 - fit.r**2))  # with three degrees of freedom, the distribution has a closed form
    assert (fit.slope, fit.p) == (pytest.approx(0.93), pytest.approx(1 - 2 / np.pi * (np.arctan(t / np.sqrt(3)) + t * np.sqrt(3) / (t * t + 3))))
    assert annotation.regression(df.select(F.lit(1.0).alias("x"), F.lit(2.0).alias("y")), "x", "y").first().p is None


@pytest.mark.parametrize("sizes", [{}, {"mark_bytes": 2000, "index_bytes": 2000}])
def test_set_similarity_join_of_runs_in_blocks(spark, sizes):
    draw = random.Random(5)
    texts = [[draw.choice("abcdefgh") for _ in range(draw.randrange(40))] for _ in range(40)]
    rows = [(f"k{i:03}", draw.choice("xyz"), draw.choice(texts)[draw.randrange(5) : draw.randrange(20, 40)]) for i in range(200)] + [("k900", None, texts[0]), ("k901", "x", None), ("k902", "y", [])]
    runs = lambda v: {tuple(v[i : i + 3]) for i in range(len(v or []) - 2)}
    sets = [(k, g, runs(v)) for k, g, v in rows if g and runs(v)]
    want = {(a, b): len(v & w) / len(v | w) for a, g, v in sets for b, h, w in sets if a < b and g != h and len(v & w) / len(v | w) >= 0.5}
    got = joins.set_similarity_join(spark.createDataFrame(rows, "k string, g string, v array<string>"), "k", "g", "v", 0.5, runs=3, **sizes).collect()
    assert len(want) > 100 and {(r.a, r.b): r.similarity for r in got} == pytest.approx(want) and len(got) == len(want)


def test_set_similarity_join_shuffles_less_than_its_values(spark):
    draw = random.Random(6)
    rows = [(i, i % 7, [f"{draw.getrandbits(60):015x}" for _ in range(400)]) for i in range(1500)]
    rows += [(i + 5000, 9, v[:300] + v[:1]) for i, _, v in rows[:20]]
    path = spark.conf.get("spark.checkpoint.dir") + "/sets-of-values"
    spark.createDataFrame(rows, "k int, g int, v array<string>").repartition(4).write.mode("overwrite").parquet(path)

    shuffled = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = shuffled()
    assert joins.set_similarity_join(spark.read.parquet(path), "k", "g", "v", 0.5).count() == 20
    assert 0 < shuffled() - before < 1500 * 400 * 5
