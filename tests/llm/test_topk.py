import math

import numpy as np
import pyspark.sql.functions as F

from scanloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, label int, id string, q int, score string"


def brute(vectors, k=20):
    own = {}
    for i, v in vectors:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            w = [math.floor(64 * float(np.float32(x))) for x in v]
            own[i] = max(own.get(i, w), w)
    out = []
    for i in own:
        if i % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(own[i], own[j])), j) for j in own if j != i))[:k]
            out += [(i, r + 1, j, -x) for r, (x, j) in enumerate(s)]
    return sorted(out)


def got(spark, vectors, k=20):
    df = spark.createDataFrame([(i, v, 1, "a", 2, "b") for i, v in vectors], SCHEMA)
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, k)
    assert out.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, out.collect()))


def test_against_brute_force_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 150)
    monkeypatch.setattr(topk, "QUERIES", 10)
    rng = np.random.RandomState(1)
    centres = rng.normal(size=(6, 12))
    vectors = [(i, (centres[i % 6] + 0.3 * rng.normal(size=12)).astype(float).tolist()) for i in range(700)]
    vectors += [(i, [0.5] * 12) for i in range(700, 760)]  # ties
    vectors += [(800, None), (801, [None] + [1.0] * 11), (802, [float("nan")] * 12), (803, [float("inf")] * 12), (None, [1.0] * 12), (820, []), (840, [1.0, 2.0]), (0, [9.0] * 12), (0, [9.0] * 12)]
    assert got(spark, vectors) == brute(vectors)


def test_few_rows_and_none(spark):
    vectors = [(0, [1.0, -1.0]), (1, [0.5, 0.5]), (20, [-3.0, 2.0])]
    assert got(spark, vectors) == brute(vectors)
    assert got(spark, []) == []
    assert got(spark, [(1, [1.0])]) == []


def test_bounds_leave_nothing_out():
    rng = np.random.RandomState(2)
    v = rng.randint(-20, 20, (3000, 8)).astype(np.float32)
    q = v[:40]
    found = topk.nra(q, v, np.arange(40), 20)
    full = q @ v.T
    for i, places in enumerate(found):
        full[i, i] = -np.inf
        assert set(np.argsort(-full[i])[:20]) <= set(np.flatnonzero(full[i] >= np.sort(full[i])[-20]))
        assert set(np.flatnonzero(full[i] >= np.sort(full[i])[-20])) <= set(places)
    assert sum(len(p) < len(v) for p in found) > 20
