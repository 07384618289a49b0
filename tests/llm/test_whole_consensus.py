"""The consensus is fitted until its reported decimals stand, in one task or in rounds of aggregations."""

import random

import pytest

from siltstone.llm import consensus


def accuracies(spark, votes, labels, most=10**9):
    return {r.annotator: r.accuracy for r in consensus.reweighted(votes, labels, most).collect()}


def test_accuracies_settle_or_fail(spark, monkeypatch):
    draw = random.Random(3)
    truth = [draw.random() < 0.5 for _ in range(300)]
    rows = [(i, f"a{a}", int(t if draw.random() < right else not t)) for i, t in enumerate(truth) for a, right in enumerate((0.6, 0.65, 0.7, 0.75))]
    votes = spark.createDataFrame(rows, "item long, annotator string, code int").cache()
    got = accuracies(spark, votes, 2)
    monkeypatch.setattr(consensus, "SETTLED", 1e-7)
    assert accuracies(spark, votes, 2) == pytest.approx(got, abs=1e-5)
    monkeypatch.setattr(consensus, "ROUNDS", 2)
    for most in (0, 10**9):
        with pytest.raises(Exception, match="after 2 rounds"):
            accuracies(spark, votes, 2, most)


@pytest.mark.parametrize("labels", [2, 3, 70])
def test_one_task_and_rounds_agree(spark, monkeypatch, labels):
    """Also with ties, labels without verdicts in an item, annotators that are mostly wrong, and more than 64 labels."""
    monkeypatch.setattr(consensus, "SETTLED", 1e-3)
    draw = random.Random(labels)
    rows = []
    for i in range(150):
        truth = draw.randrange(labels)
        for a in draw.sample(range(7), draw.randint(1, 5)):
            rows.append((i, f"a{a}", f"l{truth if draw.random() < (0.1, 0.5, 0.6, 0.8, 0.9, 0.9, 0.3)[a] else draw.randrange(labels):02}"))
    df = spark.createDataFrame(rows, "item long, who string, label string").cache()
    got = [consensus.consensus(df, "item", "who", "label", task_verdicts=most) for most in (0, 10**9)]
    one, two = ({r.annotator: r.accuracy for r in x.annotators.collect()} for x in got)
    assert one == pytest.approx(two, abs=1e-9)
    one, two = ({r.item: (r.label, r.n, r.agreement, round(r.posterior, 6)) for r in x.items.collect()} for x in got)
    assert one == two and len(one) == len({r[0] for r in rows})


def test_labels_in_any_number(spark, monkeypatch):
    monkeypatch.setattr(consensus, "LISTED_LABELS", 3)
    rows = [(i, f"a{a}", f"l{i if a else i + 1}") for i in range(40) for a in range(3)]
    got = consensus.consensus(spark.createDataFrame(rows, "item long, who string, label string"), "item", "who", "label")
    assert {r.item: r.label for r in got.items.collect()} == {i: f"l{i}" for i in range(40)}
