"""Problems 1 to 3."""

import random
import re
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import consensus, split, topn

NAN = float("nan")


def test_top_n_ties_repeats_and_unusable_scores(spark):
    rows = [("A ", "t", "c1", 0.5), (" a", "t", "c1", 0.9), ("a", "t", "c2", 0.9), ("a", "t", "c3", NAN), ("a", "t", "c4", None), ("a", "t", "c5", -0.1), ("a", "t", "c6", 1.1), ("a", "t", "c7", 1.0), ("a", "t", None, 0.5), (None, None, "c9", 0.0)]
    df = spark.createDataFrame(rows, "dataset string, test_id string, corpus_id string, score double").withColumn("dataset", topn.clean_key("dataset"))
    got = topn.top_n_per_group(df, ["dataset", "test_id"], "corpus_id", "score", 2).collect()
    assert sorted((r.dataset or "", r.corpus_id, r.score, r["rank"]) for r in got) == [("", "c9", 0.0, 1), ("a", "c1", 0.9, 2), ("a", "c7", 1.0, 1)]


def test_top_n_against_brute_force_with_clashing_names(spark):
    draw = random.Random(3)
    rows = [(draw.choice("xy"), f"c{draw.randrange(40)}", draw.randrange(6) / 5, 7, "n") for _ in range(500)]
    df = spark.createDataFrame(rows, "g string, item string, score double, rank int, __item string")
    got = {(r.g, r.item) for r in topn.top_n_per_group(df, ["g"], "item", "score", 5).collect()}
    best = defaultdict(dict)
    for g, item, score, *_ in rows:
        best[g][item] = max(score, best[g].get(item, 0))
    assert got == {(g, i) for g in best for i, _ in sorted(best[g].items(), key=lambda x: (-x[1], x[0]))[:5]}


def test_top_n_empty_and_group_limit(spark):
    df = spark.createDataFrame([], "g string, item string, score double")
    out = topn.top_n_per_group(df, ["g"], "item", "score")
    assert out.count() == 0
    assert out._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", "end.", "\n\n", "\n", "def f():\n", "\\begin{x} ", "\\end{x}\n\n", "Response: ", "\r\n", "  ", "\t", "é漢😀", "x" * 50]), max_size=120), st.integers(1, 12), st.integers(0, 6), st.integers(0, 12))
def test_pieces_cover_the_text_within_the_limit(parts, most, least, overlap):
    text = "".join(p + (" " if p[-1].isalnum() or p[-1] == "." else "") for p in parts)
    spans = [m.span() for m in re.finditer(r"[^ \t\r\n]+", text)]
    got = split.pieces_of(text, most, least, overlap)
    if len(spans) <= most:
        assert got == [(0, 0, len(text), len(spans), "end")]
        return
    assert got[0][1] == 0 and got[-1][2] == len(text)
    shared = min(overlap, most - 1)
    for k, a, b, n, _ in got:
        assert n <= most and len(re.findall(r"[^ \t\r\n]+", text[a:b])) == n, k
    firsts = [next(i for i, s in enumerate(spans) if s[1] > p[1]) for p in got]
    for (p, q), (i, j) in zip(zip(got, got[1:]), zip(firsts, firsts[1:])):
        assert j == i + p[3] - shared  # consecutive pieces share exactly the overlap
    whole = text[got[0][1] : got[0][2]]
    for p, q in zip(got, got[1:]):
        whole += text[p[2] : q[2]]
    assert whole == text


def test_pieces_end_at_natural_boundaries_and_keep_environments():
    prose = "One two three four. Five six seven eight.\n\nNine ten eleven twelve. Thirteen fourteen."
    assert [p[4] for p in split.pieces_of(prose, 9, 2, 0)][:1] == ["block"]
    assert prose[split.pieces_of(prose, 9, 2, 0)[1][1] :].startswith("Nine")
    latex = "a b c\n\n\\begin{x}\nd e\n\nf g\n\\end{x}\nh i j k l"
    cut = split.pieces_of(latex, 8, 1, 0)
    assert latex[cut[1][1] :].startswith("\\begin{x}")
    hard = split.pieces_of("w " * 25, 10, 3, 2)
    assert [p[4] for p in hard] == ["hard", "hard", "end"] and all(p[3] >= 3 for p in hard)


def test_split_table_nulls_empty_unknown_and_long(spark):
    config = spark.createDataFrame([("d", "paragraph", 2, 5, 1), ("d", "rl", 1, 3, 9)], "dataset_short_name string, mode string, min_tokens int, max_tokens int, overlap_tokens int")
    long = "x" * 200_000
    rows = [(1, None, "d", "paragraph"), (2, "", "d", None), (3, "a b c d e", "d", " PARAGRAPH"), (4, "a b c d e f", "d", None), (5, "a b c d e f", "other", None), (6, "a b c d", "d", "Rl "), (7, long, "d", None), (None, "a b c d e f g", "d", None), (4, "a b c d e f", "d", None)]
    df = spark.createDataFrame(rows, "record_id long, text string, ds string, mode string").withColumn("key", F.lit("clash"))
    got = defaultdict(list)
    for r in split.split_oversized(df, config, "record_id", "text", "ds", "mode").collect():
        got[r.record_id].append(r)
    assert got[1][0].text is None and got[1][0].n_tokens == 0 and got[2][0].text == ""
    assert len(got[3]) == 1 and len(got[5]) == 1 and len(got[7]) == 1 and got[7][0].n_tokens == 1
    assert len(got[4]) == 4 and len(got[None]) == 2  # the repeated row is cut twice
    assert max(r.n_tokens for r in got[6]) == 3 and len(got[6]) == 2
    assert split.split_oversized(df.limit(0), config, "record_id", "text", "ds", "mode").count() == 0
    assert split.split_oversized(df, config.limit(0), "record_id", "text", "ds", "mode").count() == len(rows)


def test_split_falls_back_on_a_data_sets_default(spark):
    config = spark.createDataFrame([("d", "paragraph", 1, 3, 0, True), ("d", "rl", 1, 5, 0, False)], "dataset_short_name string, mode string, min_tokens int, max_tokens int, overlap_tokens int, is_default boolean")
    df = spark.createDataFrame([(i, "a b c d", ds, mode) for i, (ds, mode) in enumerate([("d", "dpo"), ("d", "rl"), ("e", "dpo"), ("d", None)])], "k long, text string, ds string, mode string")
    got = split.split_oversized(df, config, "k", "text", "ds", "mode").groupBy("k").count().collect()
    assert {r.k: r["count"] for r in got} == {0: 2, 1: 1, 2: 1, 3: 2}


def labels(n_items, accuracy, seed, kinds=("no", "yes")):
    draw = random.Random(seed)
    truth, rows = {}, []
    for i in range(n_items):
        truth[i] = draw.choice(kinds)
        for name, right in draw.sample(sorted(accuracy.items()), draw.randint(2, len(accuracy))):
            rows.append((i, name, truth[i] if draw.random() < right else draw.choice([k for k in kinds if k != truth[i]])))
    return truth, rows


def test_consensus_finds_truth_and_reliability(spark):
    accuracy = {"good": 0.95, "fine": 0.85, "coin": 0.5, "wrong": 0.15, "fair": 0.75}
    truth, rows = labels(1500, accuracy, 1)
    got = consensus.consensus(spark.createDataFrame(rows, "item long, who string, label string"), "item", "who", "label")
    found = {r.annotator: r.accuracy for r in got.annotators.collect()}
    assert all(abs(found[k] - v) < 0.06 for k, v in accuracy.items()), found
    by_item = {r.item: r.label for r in got.items.collect()}
    votes = defaultdict(list)
    for i, _, v in rows:
        votes[i].append(v)
    weighted = sum(by_item[i] == truth[i] for i in truth)
    majority = sum(max(sorted(set(votes[i])), key=votes[i].count) == truth[i] for i in truth)
    assert weighted > majority and weighted > 0.85 * len(truth)


def test_consensus_of_three_labels(spark):
    truth, rows = labels(600, {"a": 0.9, "b": 0.8, "c": 0.4}, 2, ("x", "y", "z"))
    got = consensus.consensus(spark.createDataFrame(rows, "item long, who string, label string"), "item", "who", "label")
    assert sum(r.label == truth[r.item] for r in got.items.collect()) > 0.8 * len(truth)


def test_consensus_cases(spark):
    rows = [(1, "a", "yes", 1), (1, "a", "no", 2), (1, "b", "yes", 1), (2, "a", None, 1), (None, "a", "yes", 1), (3, "c", "no", 1), (1, "a", "no", 2)]
    df = spark.createDataFrame(rows, "item long, who string, label string, at int")
    got = consensus.consensus(df, "item", "who", "label", F.col("at"))
    items = {r.item: r for r in got.items.collect()}
    assert items[1].label is None and items[1].n == 2 and items[3].label == "no"
    empty = consensus.consensus(df.limit(0), "item", "who", "label")
    assert empty.items.count() == 0 and empty.annotators.count() == 0 and empty.agreement.first().alpha is None


def test_alpha_against_its_definition(spark):
    _, rows = labels(200, {"a": 0.9, "b": 0.7, "c": 0.8}, 5)
    got = consensus.alpha(spark.createDataFrame(rows, "item long, annotator string, label string")).first()
    units = defaultdict(list)
    for i, _, v in rows:
        units[i].append(v)
    units = [u for u in units.values() if len(u) > 1]
    values = [v for u in units for v in u]
    n = len(values)
    observed = sum(sum(u[i] != u[j] for i in range(len(u)) for j in range(len(u)) if i != j) / (len(u) - 1) for u in units) / n
    expected = sum(values.count(a) * values.count(b) for a in ("no", "yes") for b in ("no", "yes") if a != b) / (n * (n - 1))
    assert got.alpha == pytest.approx(1 - observed / expected)
