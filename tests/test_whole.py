"""Cases that only show beyond the size of the test tables."""

import random
from statistics import NormalDist

import numpy as np
import pytest

from siltstone.functions import statistics as st
from siltstone.operators import evaluation, joins


def test_paired_tests_read_all_pairs_beyond_5000(spark):
    draw = np.random.default_rng(3)
    d = np.concatenate([draw.normal(size=5000), draw.normal(8, 1, size=1000)])  # the highest sample ids are the odd ones
    rows = [(1, i, float(x), 0.0) for i, x in enumerate(d)]
    row = evaluation.paired_tests(spark.createDataFrame(rows, "split int, sample int, a double, b double"), "split", 20).first()
    scores = [NormalDist().inv_cdf((i - 0.375) / (len(d) + 0.25)) for i in range(1, len(d) + 1)]
    assert row.n == 6000 and row.shapiro_w == pytest.approx(np.corrcoef(np.sort(d), scores)[0, 1] ** 2, abs=1e-3)
    assert row.shapiro_p is None and st.shapiro(d[:5000])[1] == st.shapiro(d[4999::-1])[1] > 0


@pytest.mark.parametrize("block_characters", [4_000_000, 3_000])
def test_decontamination_against_brute_force(spark, block_characters):
    draw = random.Random(12)
    text = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(300)).strip()
    held = [text() for _ in range(30)]
    rows = []
    for i in range(600):  # similarities of 0.6 to 1, most of them near 0.8
        t = list(draw.choice(held))
        for at in draw.sample(range(len(t)), draw.randrange(0, 22)):
            t[at] = draw.choice("0123456789")
        rows.append((i, "".join(t).upper().replace(" ", "\n ")))
    rows += [(600, None), (601, "ab"), (602, text())]
    runs = lambda t: {t[i : i + 3] for i in range(len(t) - 2)}
    sets = [runs(" ".join(h.split())) for h in held]

    def near(t):
        own = runs(" ".join((t or "").lower().split()))
        return any(len(own & s) / len(own | s) >= 0.8 for s in sets)

    want = [i for i, t in rows if not near(t)]
    assert 150 < len(want) < 450
    df = spark.createDataFrame(rows, "i int, t string")
    left = joins.minhash_decontaminated(df, spark.createDataFrame([(h,) for h in [*held, held[0].upper(), None, "a"]], "t string"), "i", "t", block_characters=block_characters)
    assert sorted(r.i for r in left.collect()) == want
    assert joins.minhash_decontaminated(df, df.limit(0), "i", "t").count() == len(rows)


def test_sure_bands():
    assert joins.sure_bands(128, 0.8) == (25, 5) and (1 - 0.8**5) ** 25 < 1e-4
