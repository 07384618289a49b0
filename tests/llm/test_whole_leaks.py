"""Recall of edited windows as texts hold them: other words follow the passage."""

import itertools
import random

import numpy as np
import pytest

from siltstone.llm import leak

WORDS = [f"w{i}" for i in range(400)]


def index_of(seed, recall=0.95):
    draw = random.Random(seed)
    items = [(f"i{k}", " ".join(draw.choice(WORDS) for _ in range(60)), []) for k in range(40)]
    return leak.Index(items, 13, 8, 2, recall), draw


@pytest.mark.parametrize("kinds", list(itertools.combinations_with_replacement("dis", 2)), ids="".join)
def test_every_mix_of_two_edits_is_found_with_other_words_behind(kinds):
    index, draw = index_of(5)
    rows, wanted = [], []
    for _ in range(1500):
        at = draw.randrange(len(index.starts))
        row = index.symbols[index.starts[at] : index.starts[at] + 13].tolist()
        for where, kind in zip(sorted(draw.sample(range(1, 12), 2), reverse=True), kinds, strict=True):
            row[where : where + (kind != "i")] = [] if kind == "d" else [0]
        rows.append((row + [draw.randrange(1, index.end) for _ in range(4)])[:15] + [-1] * 15)
        wanted.append(index.owner[at])
    symbols, starts = np.array(rows, dtype=np.int32).ravel(), np.arange(len(rows)) * 30
    assert index.may_match(symbols, starts).all()
    place, item, _ = index.hits(symbols, starts)
    got = set(zip(place.tolist(), item.tolist(), strict=True))
    assert np.mean([(r, k) in got for r, k in enumerate(wanted)]) >= 0.93


def test_edited_rows_are_full_and_really_edited():
    index, _ = index_of(6)
    starts, rows = index.edited((0, 0), 300, np.random.default_rng(1))
    assert rows.shape == (300, 15) and rows.max() < index.end and rows.min() >= 0
    assert set(leak.edit_distance(index.symbols[starts[:, None] + np.arange(13)], rows)) == {2}


def test_a_recall_out_of_reach_is_an_error(monkeypatch):
    monkeypatch.setattr(leak, "MOST_WALKS", 2)
    with pytest.raises(ValueError, match="2 walks"):
        index_of(7)
