import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanloom.llm import hardneg

SCHEMA = "vec_id long, embedding array<float>, label int, id string, row int, score string, part int, a string"


def brute(rows):
    own = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            key = ((label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v])
            own[i] = max(own.get(i, key), key)
    dot = lambda a, b: sum(x * y for x, y in zip(own[a][1], own[b][1]))
    out = []
    for a in own:
        if a % 50:
            continue
        ranked = sorted((-dot(a, j), j) for j in own if j != a)
        for s, p in [x for x in ranked if own[x[1]][0] == own[a][0]][:5]:
            window = [(-x, j) for x, j in ranked if own[j][0] != own[a][0] and 50 * -s <= 100 * -x <= 95 * -s]
            out += [(a, p, r + 1, j, -s, x) for r, (x, j) in enumerate(window[:3])]
    return sorted(out)


def got(spark, rows):
    df = spark.createDataFrame([(i, v, label, "a", 1, "s", 2, "b") for i, v, label in rows], SCHEMA)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = hardneg.mine(df, F.col("vec_id") % 50 == 0, label=label)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, out.collect()))


@pytest.fixture
def small_blocks(monkeypatch):
    for name, size in (("ANCHORS", 9), ("BLOCK", 150), ("SLICE", 64)):
        monkeypatch.setattr(hardneg, name, size)


def clustered(n, d, spread, labels=10, seed=1):
    rng = np.random.RandomState(seed)
    centres = rng.normal(size=(labels, d))
    which = rng.randint(0, labels, n)
    return [(i, (centres[w] + spread * rng.normal(size=d)).tolist(), int(w)) for i, w in enumerate(which)]


def test_against_brute_force_in_several_blocks(spark, small_blocks):
    rows = clustered(1500, 8, 0.4)
    rows += [(i, [0.5] * 8, i % 3) for i in range(1500, 1620)]  # ties
    rows += [(2000, None, 1), (2050, [None] + [1.0] * 7, 1), (2100, [math.nan] * 8, 1), (2150, [math.inf] * 8, 1), (None, [1.0] * 8, 1), (2200, [1.0] * 8, None),
             (2250, [], 2), (2300, [1.0, 2.0], 3), (0, [9.0] * 8, 4), (0, [9.0] * 8, 4), (50, [-1.0] * 8, 5)]
    want = brute(rows)
    assert got(spark, rows) == want and len(want) > 100


def test_one_label_holds_a_third(spark, small_blocks):
    rows = [(i, v, 0 if i % 3 == 0 else label) for i, v, label in clustered(900, 5, 1.0, seed=2)]
    assert got(spark, rows) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, -1.0], 1), (1, [0.5, -0.4], 1), (3, [0.7, -0.6], 2), (50, [-1.0, 0.0], 3)]
    assert got(spark, rows) == brute(rows) != []
    assert got(spark, []) == [] and got(spark, [(1, [1.0], 1)]) == [] and got(spark, [(0, [1.0], 1)]) == []


def test_bounds_spare_candidates():
    rng = np.random.RandomState(3)
    v = np.round(256 * np.concatenate([rng.normal(size=(1, 6)) * 3 + 0.02 * rng.normal(size=(500, 6)), rng.normal(size=(2000, 6))])).astype(np.int64)
    scores = hardneg.Scores(v[:40], v)
    done = 0
    for nodes, mask, exact in hardneg.walk(scores, list(hardneg.spanning_tree(v[:40].astype(float))), slice(0, len(v)), lambda nodes, low, high: (high >= 20000) & (low <= 30000)):
        true = v[nodes] @ v.T
        assert (exact[mask] == true[mask]).all() and not (~mask & (true >= 20000) & (true <= 30000)).any()
        done += mask.sum()
    assert done < 0.8 * 40 * len(v)


def test_scores_beyond_a_double_are_exact_or_an_error():
    big = np.array([[2**30 + 1, 3]], np.int64)
    assert hardneg.Scores(big, big).of(np.array([0]), slice(0, 1), np.ones((1, 1), bool))[0, 0] == (2**30 + 1) ** 2 + 9
    with pytest.raises(OverflowError):
        hardneg.Scores(big * 4, big * 4)
