"""Problems 5 and 6, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import classes, leak, neardup
from siltstone.llm.words import words

WORDS = [f"w{i}" for i in range(400)]


def texts(seed, n=60):
    draw = random.Random(seed)
    out = {}
    for i in range(n):
        base = [draw.choice(WORDS) for _ in range(draw.randint(20, 80))]
        out[f"t{i:03}"] = " ".join(base)
        for j in range(draw.randint(0, 4)):
            near = list(base)
            for _ in range(draw.randint(0, 3)):
                near[draw.randrange(len(near))] = draw.choice(WORDS)
            out[f"t{i:03}_{j}"] = (", " if j % 2 else " ").join(near).upper()
    return out


def true_pairs(table, ngram, threshold):
    sets = {k: {tuple(w[i : i + ngram]) for i in range(len(w) - ngram + 1)} for k, t in table.items() for w in [words(t)]}
    keys = sorted(k for k in sets if sets[k])
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


@pytest.mark.parametrize("ngram, threshold, block", [(3, 0.8, 512), (2, 0.6, 2)])
def test_near_duplicates_against_brute_force(spark, ngram, threshold, block):
    table = texts(ngram)
    rows = [*table.items(), *list(table.items())[:9], ("none", None), (None, "a b c d"), ("short", "a b"), ("empty", "")]
    df = spark.createDataFrame(rows, "k string, t string").withColumn("key", F.lit("clash")).withColumn("rid", F.lit(1))
    found = neardup.NearDuplicates(df, "k", "t", threshold, ngram, 128, block=block)
    got = [(r.k_a, r.k_b) for r in found.pairs("k").collect()]
    assert len(got) == len(set(got)) and set(got) == true_pairs(table | {"short": "a b"}, ngram, threshold)
    groups = {r.k: r.group_id for r in found.groups("k").collect()}
    parent = {k: k for k in table}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(got):
        if a in parent and b in parent:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert {k: v for k, v in groups.items() if k in table} == {k: root(k) for k in table if k in groups}


def test_near_duplicates_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k string, t string")
    assert neardup.near_duplicate_pairs(df, "k", "t").count() == 0
    assert neardup.near_duplicate_groups(df, "k", "t").count() == 0


def test_bands_and_posterior():
    rows = neardup.band_rows(128, 0.8)
    assert (1 - 0.8**rows) ** (128 // rows) <= 1e-4
    assert neardup.beta_tail(0, 0, 0.8) == pytest.approx(0.2, abs=1e-3)
    assert neardup.beta_tail(128, 128, 0.8) > 0.999
    looks = neardup.least_matches(128, 0.8)
    draw = np.random.default_rng(1)
    lost = sum(any(same[:c].sum() < m for c, m in looks) for same in (draw.random((5000, 128)) < 0.8))
    assert lost <= 5  # pairs at the threshold itself


def test_components_against_union_find(spark):
    draw = random.Random(2)
    links = [(draw.randrange(80), draw.randrange(80)) for _ in range(55)] + [(100, 100 + i) for i in range(1, 30)] + [(i, i + 1) for i in range(200, 240)]
    got = {r.rid: r.root for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


def leak_case(seed):
    draw = random.Random(seed)
    wording = [draw.choice(WORDS) for _ in range(30)]
    items = {f"i{k:02}": [draw.choice(WORDS) for _ in range(draw.randint(10, 60))] + (wording if k % 3 == 0 else []) for k in range(25)}
    corpus = {}
    for c in range(150):
        body = [draw.choice(WORDS) for _ in range(draw.randint(5, 120))]
        if draw.random() < 0.5:
            own = draw.choice(sorted(items.values()))
            a = draw.randrange(len(own))
            body[draw.randrange(len(body)) :] = own[a : a + draw.randint(8, 30)]
        corpus[f"c{c:03}"] = " ".join(body)
    return {k: " ".join(v) for k, v in items.items()}, corpus


def true_leaks(items, corpus, window=13, run=8):
    owners, good = {}, {}
    for name, t in items.items():
        w = words(t)
        for p in range(len(w) - run + 1):
            owners.setdefault(tuple(w[p : p + run]), set()).add(name)
    for name, t in items.items():
        w = words(t)
        for p in range(len(w) - window + 1):
            if all(owners[tuple(w[q : q + run])] == {name} for q in range(p, p + window - run + 1)):
                good.setdefault(tuple(w[p : p + window]), set()).add(name)
    return {(c, i) for c, t in corpus.items() for w in [words(t)] for p in range(len(w) - window + 1) for i in good.get(tuple(w[p : p + window]), ())}


@pytest.mark.parametrize("block_words", [2_000_000, 200])
def test_leaks_against_brute_force(spark, block_words):
    items, corpus = leak_case(4)
    rows = [*corpus.items(), *list(corpus.items())[:5], ("none", None), (None, items["i01"]), ("empty", ""), ("again", items["i01"].upper().replace(" ", ",\n")), ("long", ("w1 " * 50_000) + items["i02"])]
    df = spark.createDataFrame(rows, "cid string, body string").withColumn("item", F.lit("clash")).withColumn("key", F.lit(2))
    its = spark.createDataFrame([*items.items(), ("i98", None), ("i99", "a b")], "test_id string, text string").withColumn("shared", F.lit(1))
    got = [(r.cid, r.test_id) for r in leak.leaked_items(df, its, "cid", "body", "test_id", "text", block_words=block_words).collect()]
    want = true_leaks(items, {k: t for k, t in rows if k and t})
    assert len(got) == len(set(got)) and set(got) == want and any(k == "again" for k, _ in got)


def test_leaks_with_edits_reach_the_recall(spark):
    draw = random.Random(9)
    items = {f"i{k:02}": " ".join(draw.choice(WORDS) for _ in range(13)) for k in range(40)}
    corpus = {}
    for c in range(400):
        own = items[f"i{c % 40:02}"].split()
        kind = c % 3
        at = draw.randrange(13)
        own[at : at + (kind != 1)] = [] if kind == 0 else ["other"]
        corpus[f"c{c}"] = " ".join(["pad"] * 6 + own + ["fill"] * 6)
    df = spark.createDataFrame(list(corpus.items()), "cid string, body string")
    its = spark.createDataFrame(list(items.items()), "test_id string, text string")
    got = {(r.cid, r.test_id): r.edits for r in leak.leaked_items(df, its, "cid", "body", "test_id", "text", max_edits=1).collect()}
    met = sum((f"c{c}", f"i{c % 40:02}") in got for c in range(400))
    assert met >= 0.9 * 400 and set(got.values()) <= {0, 1}


def test_leaks_of_empty_tables(spark):
    df = spark.createDataFrame([], "cid string, body string")
    its = spark.createDataFrame([("i", "a b c")], "test_id string, text string")
    assert leak.leaked_items(df, its, "cid", "body", "test_id", "text").count() == 0
    assert leak.leaked_items(its.withColumnsRenamed({"test_id": "cid", "text": "body"}), df.withColumnsRenamed({"cid": "test_id", "body": "text"}), "cid", "body", "test_id", "text").count() == 0


def test_edit_distance_to_a_beginning():
    one = np.array([[1, 2, 3, 4]] * 4)
    two = np.array([[1, 2, 3, 4, 9], [1, 2, 4, 9, 9], [1, 7, 2, 3, 4], [1, 2, 3, -1, -1]])
    assert leak.edit_distance(one, two).tolist() == [0, 1, 1, 1]


@pytest.mark.parametrize("block", [2, 512])
def test_pairs_of_classes_in_blocks(spark, block):
    """With one class of a third of all members."""
    draw = random.Random(block)
    members = [(0, k) for k in range(40)] + [(draw.randint(1, 25), k) for k in range(40, 120)]
    links = sorted({tuple(sorted(draw.sample(range(26), 2))) for _ in range(20)} | {(0, 1)})
    placed = classes.in_blocks(spark.createDataFrame(members, "cls int, key int").repartition(5), block).cache()
    got = [(r.ka, r.kb) for r in classes.pairs_within(placed).collect()]
    assert sorted(got) == sorted((a, b) for c, a in members for d, b in members if c == d and a < b)
    got = [(r.ka, r.kb, r.s) for r in classes.pairs_across(spark.createDataFrame([(*x, 0.5) for x in links], "a int, b int, s double"), placed).collect()]
    assert sorted(got) == sorted((min(p, q), max(p, q), 0.5) for a, b in links for c, p in members if c == a for d, q in members if d == b)


def test_leaks_in_blocks_and_segments_are_those_of_one_index(spark):
    """Items longer than a block come in segments; a window on either side of a cut is found, and the exact search loses none of the edited ones."""
    draw = random.Random(9)
    item = [f"i{draw.randrange(300)}" for _ in range(150)]
    items = spark.createDataFrame([("long", " ".join(item)), ("short", " ".join(f"s{i}" for i in range(20))), ("none", None)], "test_id string, t string")
    rows = []
    for k in range(0, 137, 4):
        passage = item[k : k + 13]
        rows.append((f"c{k:03}", " ".join(["x"] * 5 + passage + ["y"] * 5)))
        passage = list(passage)
        del passage[draw.randrange(13)]
        passage.insert(draw.randrange(12), "new")
        rows.append((f"e{k:03}", " ".join(["x"] * 5 + passage + item[k + 13 : k + 14] + ["y"] * 5)))
    rows.append(("twice", " ".join(item[:40] + ["z"] * 9 + item[90:130])))
    df = spark.createDataFrame(rows, "k string, t string")
    search = lambda **s: {(r.k, r.test_id): (r.edits, r.windows) for r in leak.leaked_items(df, items, "k", "t", "test_id", "t", **s).collect()}
    plain = search()
    assert set(plain) >= {(k, "long") for k, _ in rows if k[0] in "ct"} and search(block_words=30) == plain
    exact = search(max_edits=2, exact=True)
    assert {k for k, _ in exact} == {k for k, _ in rows} and search(max_edits=2, exact=True, block_words=30) == exact
    found = leak.LeakSearch(df, items, "k", "t", "test_id", "t", max_edits=2)
    got = {(r.k, r.test_id): (r.edits, r.windows) for r in found.found.collect()}
    assert found.recall >= 0.95 and set(got) <= set(exact) and len(got) >= 0.95 * len(exact)
    assert sum(w for _, w in got.values()) >= 0.95 * sum(w for _, w in exact.values())


def test_recall_on_held_out_windows_with_two_edits():
    """Fresh windows with the worst mixes of two edits, followed by other words than those that the walks were chosen with."""
    draw = np.random.default_rng(77)
    items = [(f"t{k}", " ".join(f"w{draw.integers(2000)}" for _ in range(60)), []) for k in range(60)]
    index = leak.Index(items, 13, 8, 2, 0.95)
    for kinds in ((0, 0), (1, 1), (0, 1), (2, 2)):
        starts, rows = index.edited(kinds, 1500, draw)
        symbols = np.concatenate([rows, np.full((len(rows), 15), -1, dtype=np.int32)], axis=1)
        place, item, _ = index.hits(symbols.ravel(), np.arange(len(rows)) * symbols.shape[1])
        owner = {int(s): int(o) for s, o in zip(index.starts, index.owner)}
        met = {(int(p), int(i)) for p, i in zip(place, item)}
        assert np.mean([(k, owner[int(s)]) in met for k, s in enumerate(starts)]) >= 0.94, kinds
