"""Problems 4, 7, 8 and 9."""

import random
import unicodedata
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import bpe, lookalike, mixing, pairs

CODE = "def f(x):\n    total = []\n    for i in x:\n        total.append(i)\n    return total\n"
EN = "Write a function that sorts the values of a list and returns the first of them."


@pytest.mark.parametrize("prompt, answer, kind", [
    (EN, None, "empty"), (EN, "", "empty"), (EN, " \t\r\n", "empty"), (EN, "```python\n```", "empty"), (EN, "``````", "empty"), (EN, "\u200b\ufeff", "empty"),
    (EN, CODE, None), (EN, "```python\n" + CODE + "```", None), (EN, "Here is the function that you want.\n\n```\n" + CODE + "```\n\nIt goes over the list once.", None),
    (EN, CODE[:-8], "truncated"), (EN, "```python\n" + CODE, "truncated"), (EN, CODE[:60], "truncated"), (EN, "The list is sorted by the value of each item and then the fir", "truncated"),
    (EN, EN, "copy"), (EN, "Q: " + EN.upper(), "copy"), (EN, f'"""\n{EN}\n"""', "copy"), (EN, EN + "\n\n" + EN, "copy"), (EN, "# " + EN, "copy"),
    (EN, f'def f(x):\n    """{EN}"""\n    return sorted(x)[:1]\n', None),
    (EN, "I'm sorry, but I cannot help with that.", "refusal"), (EN, "```\nThis is something I have to decline.\n```", "refusal"), (EN, "# Regrettably, no solution can be offered.", "refusal"), (EN, "Lo siento, pero no puedo ayudarte.", "refusal"),
    (EN, "def f(x):\n    if not x:\n        raise ValueError('cannot handle nothing')\n    return x[0]\n", None),
    (EN, "# Diese Funktion sortiert die Werte und gibt den ersten zurück, wenn es einen gibt.\n" + CODE, "language"), (EN, "Сначала проверим, что список не пуст, и затем вернём первое значение.\n\n```\n" + CODE + "```", "language"),
    ("Écrivez une fonction qui trie les valeurs d'une liste et renvoie la première.", "# La fonction trie les valeurs de la liste et renvoie la première.\n" + CODE, None),
    (None, CODE, None), ("", "return = lambda v: v[16:]", None), (EN, "x = lambda v: v[1:]", None),
])
def test_defects(prompt, answer, kind):
    assert pairs.defect(prompt, answer) == kind


def test_defect_table(spark):
    rows = [(1, EN, CODE), (2, EN, None), (2, EN, None), (None, EN, ""), (4, None, "x" * 300_000)]
    df = spark.createDataFrame(rows, "answer_id long, prompt string, code string").withColumn("text", F.lit("clash"))
    got = sorted((r.answer_id or 0, r.defect) for r in pairs.defective_pairs(df, "answer_id", "prompt", "code").collect())
    assert got == [(0, "empty"), (2, "empty"), (2, "empty")]
    assert pairs.defective_pairs(df.limit(0), "answer_id", "prompt", "code").count() == 0


def test_shortened_versions_against_brute_force(spark):
    draw = random.Random(1)
    texts = sorted({(draw.randint(1, 2), "".join(draw.choice("ab") for _ in range(draw.randint(1, 9)))) for _ in range(400)})
    df = spark.createDataFrame([*texts, texts[0], (1, None), (1, "")], "group long, text string").withColumn("h", F.encode(F.concat_ws(":", "group", "text"), "utf-8"))
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {bytes(r.h).decode() for r in pairs.shortened_versions(df).collect()}
        assert got == {f"{g}:{t}" for g, t in texts if any(p == g and o != t and o.startswith(t) for p, o in texts)}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_where_a_longer_code_goes_on():
    code = "def f(x):\n    y = 2 * x\n    return g(y)"
    assert pairs.cut_short(code, code + " + h(y)") and pairs.cut_short("def f(x):\n    y = 2 * x", code)
    assert not pairs.cut_short(code, code) and not pairs.cut_short(code, code + "\n\nprint(f(1))") and not pairs.cut_short(code, code + "  # done")
    assert pairs.cut_short("He counts the letters.", "He counts the letters. Then he adds them.")


def test_shortened_rows_are_truncated(spark):
    fenced = lambda c: f"Here it is:\n\n```python\n{c}\n```"
    whole, cut = "def f(x):\n    return g(x) + h(x)", "def f(x):\n    return g(x)"
    rows = [(1, EN, fenced(whole)), (2, EN, cut), (3, EN + " Now.", cut), (4, EN, whole + "\n\nprint(f(2))"), (5, None, cut)]
    df = spark.createDataFrame(rows, "answer_id long, prompt string, code string")
    assert [tuple(r) for r in pairs.defective_pairs(df, "answer_id", "prompt", "code").collect()] == [(2, "truncated")]


def test_limit_lengths(spark):
    lengths = [n for n in range(50, 150) for _ in range(3)] + [100] * 60
    assert [r.length for r in pairs.limit_lengths(spark.createDataFrame([(n,) for n in lengths], "length int")).collect()] == [100]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    encoder = bpe.encoder(bpe.vocabulary_path())
    return encoder, tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.rank, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(st.sampled_from(["the", " ", "ing", "aaaa", "<|endoftext|>", "'ll", "==", "\n\n", "é", "e\u0301", "漢字", "👩\u200d💻", "0123"]), max_size=60).map("".join)))
def test_ids_equal_the_public_encoder(reference, text):
    encoder, other = reference
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode(text) == other.encode_ordinary(text)


def test_long_runs_are_linear_and_exact(reference):
    encoder, other = reference
    for text in ("a" * 30_000, "ab" * 20_000, "=" * 30_000, " " * 20_000 + "x", "é" * 10_000, "zq" * 5000 + "zqx"):
        assert encoder.encode(text) == other.encode_ordinary(text)


def test_ids_table(spark, reference):
    rows = [(1, None), (2, ""), (3, "<|endoftext|> hi"), (3, "<|endoftext|> hi"), (None, "x"), (5, " \t\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    got = [(r.doc_id, r.ids) for r in bpe.encode_corpus(df).collect()]
    assert got == [(k, reference[1].encode_ordinary(t) if t else []) for k, t in rows]
    assert bpe.encode_corpus(df.limit(0)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 50)), min_size=1, max_size=40), st.integers(0, 999))
def test_pivot_keeps_the_sum_and_leaves_one(items, seed):
    chance, size = np.array([c for c, _ in items]), np.array([float(s) for _, s in items])
    out = mixing.pivot(chance, size, np.random.default_rng(seed))
    assert ((out >= 0) & (out <= 1)).all() and ((out > 0) & (out < 1)).sum() <= 1
    assert out @ size == pytest.approx(chance @ size, abs=1e-6)


def test_pivot_keeps_expectations():
    chance, size = np.array([0.2, 0.7, 0.5, 0.9, 0.35]), np.array([3.0, 1.0, 7.0, 2.0, 4.0])
    draws = []
    for seed in range(6000):
        draw = np.random.default_rng(seed)
        out = mixing.pivot(chance, size, draw)
        draws.append(np.where((out > 0) & (out < 1), draw.random(5) < out, out))
    assert np.abs(np.mean(draws, axis=0) - chance).max() < 0.03


def test_mixture(spark):
    draw = random.Random(4)
    rows = [(i, draw.choice(["Big ", "big", "mid-size", "tiny"] if i % 20 == 0 else ["big", "mid_size"]), draw.randint(1, 30)) for i in range(4000)] + [(9001, None, 5), (9002, "big", 0), (None, "big", 9)]
    df = spark.createDataFrame(rows, "doc_id long, source string, n long").withColumn("tokens", F.lit("clash"))
    targets = spark.createDataFrame([("m", "big", 1.0, 2, 0.6), ("m", "mid_size", 1.0, 2, 0.6), ("m", "tiny", 2.0, 3, 0.6), ("m", "absent", 1.0, 3, 0.6), ("over", "mid_size", 1.0, 1, 5.0), ("none", "big", 0.0, 1, 0.5)], "mix_name string, source string, weight double, max_repeats int, budget_share double")
    a = mixing.mixture(df, targets, "doc_id", "source", F.col("n"), 3, bucket=300, fan_in=3)
    b = mixing.mixture(df.repartition(7), targets, "doc_id", "source", F.col("n"), 3, bucket=300, fan_in=3)
    taken = {(r.mix_name, r.source, r.doc_id): r.copies for r in a.copies().collect()}
    assert taken == {(r.mix_name, r.source, r.doc_id): r.copies for r in b.copies().collect()}
    shares = {(r.mix_name, r.source): r for r in a.shares().collect()}
    total = sum(n for *_, n in rows)
    tiny = shares["m", "tiny"]
    assert tiny.reached_tokens == 3 * tiny.available_tokens and tiny.most_copies == 3
    for name in ("big", "mid_size"):
        assert abs(shares["m", name].reached_tokens - shares["m", name].allotted_tokens) <= 30
    assert abs(sum(shares["m", s].reached_tokens for s in ("big", "mid_size", "tiny", "absent")) - 0.6 * total) <= 60
    assert shares["m", "absent"].reached_tokens == 0 and shares["none", "big"].reached_tokens == 0
    assert shares["over", "mid_size"].reached_tokens == shares["over", "mid_size"].available_tokens
    assert not any(k[2] in (9001, 9002, None) for k in taken) and all(v <= 3 for v in taken.values())
    empty = mixing.mixture(df.limit(0), targets, "doc_id", "source", F.col("n"))
    assert empty.copies().count() == 0 and empty.shares().count() == 6


def test_allotted_shares_out_what_a_source_lacks():
    import pandas as pd

    got = mixing.allotted(pd.DataFrame({"mix": "m", "source": list("abc"), "weight": [1.0, 1.0, 2.0], "max_repeats": [1, 1, 1], "tokens": [10, 1000, 1000], "budget": 400.0}))
    assert got["wanted"].tolist() == pytest.approx([10, 130, 260])


LOOKS = ["Café ﬁne １２", "Cafe\u0301 fine 12", "Ｃａｆé\u00a0fi\u200bne 12", "С\u0430fé fine\u200912", "C\u0430f\u0435\u0301 f\u00adine 12"]
APART = ["Cafe fine 12", "café fine 12", "Café fine 13", "Café fine 12.", "Café fine  12", "Café\nfine 12"]


def test_same_looking_and_visibly_different(spark):
    rows = [(i, t) for i, t in enumerate([*LOOKS, *APART, LOOKS[0], None, "", "\u200b", " ", "\u2003"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash"))
    got = {(r.doc_id_a, r.doc_id_b) for r in lookalike.same_looking_pairs(df).collect()}
    same = [0, 1, 2, 3, 4, 11]
    assert got == {(a, b) for a in same for b in same if a < b and rows[a][1] != rows[b][1]}
    assert lookalike.same_looking_pairs(df.limit(0)).count() == 0


@pytest.mark.parametrize("one, two, same", [
    ("\u0600\u0661", "\u0661", False), ("a\u06ddb", "ab", False), ("\uffe5", "\u00a5", True), ("\u0133", "ij", True), ("\u0474", "V", True), ("\u01c4", "D\u017d", True), ("\u03ba", "\u043a", True),
    ("\u03b1", "a", False), ("\u0131", "i", False), ("\u2026", "...", False), ("\u2167", "VIII", False), ("\uff30", "\u0420", True), ("\ufb01", "fi", True), ("a\u00adb", "ab", True),
])
def test_what_looks_the_same(one, two, same):
    rewrite = lookalike.Rewriter(tuple(lookalike.rewrite_table(lookalike.classes(lookalike.look_alike_pairs()), {}).items()))
    assert (rewrite(one) == rewrite(two)) is same


def test_classes_of_looks(spark):
    df = spark.createDataFrame([(5, "A b"), (3, "\u0410 b"), (7, "A b"), (9, "A\u00a0b"), (1, "c"), (2, None), (4, " ")], "doc_id long, text string")
    assert {r.doc_id: (r.class_id, r.links) for r in lookalike.same_looking_classes(df).collect()} == {5: (3, 2), 3: (3, 2), 7: (3, 2), 9: (3, 2), 1: (1, 0)}
    assert lookalike.same_looking_classes(df.limit(0)).count() == 0


def test_representatives_follow_frequency_and_forms_are_stable(spark):
    groups = lookalike.classes(lookalike.look_alike_pairs())
    russian = lookalike.rewrite_table(groups, {"а": 10, "a": 1})
    assert russian["a"] == "а"
    rewrite = lookalike.Rewriter(tuple(lookalike.rewrite_table(groups, {"a": 10}).items()))
    for text in [*LOOKS, *APART, "ﬀi fﬁ ﬃ ffi", "Ωμέγα й ё", "\u0301", "한국어", "👩\u200d💻"]:
        assert rewrite(rewrite(text)) == rewrite(text)
    assert rewrite("ﬀi") == rewrite("fﬁ") == rewrite("ﬃ") == rewrite("ffi")
    df = spark.createDataFrame([(1, "ﬁ"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.form for r in lookalike.consistent_form(df).orderBy("doc_id").collect()] == ["fi", None, ""]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("abceopxyABCE 12.,\nßéñйёαο"), max_size=40), st.data())
def test_any_variant_has_the_same_form(text, data):
    groups = lookalike.classes(lookalike.look_alike_pairs())
    rewrite = lookalike.rewriter(tuple(sorted(lookalike.rewrite_table(groups, {}).items())))
    of = defaultdict(list)
    for g in groups:
        for m in g:
            of[m] = [x for x in g if len(x) == 1]
    changed = "".join(data.draw(st.sampled_from(of[ch] or [ch])) + data.draw(st.sampled_from(["", "", "\u200b", "\u2060"])) for ch in unicodedata.normalize(data.draw(st.sampled_from(["NFC", "NFD"])), text))
    assert rewrite(changed) == rewrite(text)
