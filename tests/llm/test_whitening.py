import math
from fractions import Fraction

import numpy as np
import pytest

from scanloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, id string, v int, n int, component string, cell int, label int"


def got(spark, vectors, **options):
    df = whitening.whiten(spark.createDataFrame([(i, v, "a", 1, 2, "c", 3, 4) for i, v in vectors], SCHEMA), **options)
    assert df.columns[:7] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    return [r.asDict() for r in df.collect()]


def ints(vectors):
    d = max(len(v) for v in vectors)
    return np.array([[math.floor(1024 * c) + 100_000 for c in v] + [100_000] * (d - len(v)) for v in vectors], object)


def check(rows, vectors, k):
    x = ints(vectors)
    n, s = len(x), x.sum(axis=0)
    z = (x - Fraction(1) * s / n).astype(float)
    e, u = np.linalg.eigh(z.T @ z / n)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    far = ((n * x - s) ** 2).sum(axis=1)
    by_row = {}
    for r in rows:
        by_row.setdefault((r["vec_id"], r["deviation"]), []).append(r)
        assert r["n"] == n and r["identity_error"] < 1e-9 and r["deviation_exact"] == r["deviation"]
        assert r["explained"] == pytest.approx(e[r["component"] - 1] / np.trace(z.T @ z / n), rel=1e-9)
    assert sorted(r["deviation"] for r in rows if r["component"] == 1) == sorted(far)
    for j in range(k):
        mine = sorted(abs(r["whitened"]) for r in rows if r["component"] == j + 1)
        assert mine == pytest.approx(sorted(abs(z @ u[:, j]) / np.sqrt(e[j])), rel=1e-6, abs=1e-6)
    return by_row


def test_against_numpy(spark):
    rng = np.random.RandomState(4)
    mix = rng.normal(size=(12, 12))
    vectors = [(i, (rng.normal(size=12) @ mix).tolist()) for i in range(500)]
    vectors += [(3, vectors[3][1])] * 4 + [(None, vectors[5][1]), (900, [0.1, -0.2])]  # repeated rows, no id, a short vector
    odd = [(700, None), (701, [None] + [1.0] * 11), (702, [math.nan] * 12), (703, [math.inf] * 12)]
    rows = got(spark, vectors + odd)
    assert len(rows) == 8 * len(vectors) and not {700, 701, 702, 703} & {r["vec_id"] for r in rows}
    check(rows, [v for _, v in vectors], 8)


def test_few_dimensions_and_no_spread(spark):
    rng = np.random.RandomState(5)
    flat = [(i, [a, 2 * a, b]) for i, (a, b) in enumerate(rng.normal(size=(40, 2)).round(3).tolist())]
    exact = [(i, [math.floor(1024 * v[0]) / 1024, 2 * math.floor(1024 * v[0]) / 1024, v[2]]) for i, v in flat]
    assert {r["component"] for r in got(spark, exact)} == {1, 2}  # rank two: the third eigenvalue is exactly zero
    for none in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(i, [0.5, 0.5]) for i in range(9)]):
        assert got(spark, none) == []


def test_equal_eigenvalues_span_their_space(spark):
    vectors = [(i, [s if j == i % 4 else 0.0 for j in range(4)]) for i, s in enumerate([1.0] * 4 + [-1.0] * 4)]
    rows = got(spark, vectors)
    assert len(rows) == 8 * 4 and max(r["identity_error"] for r in rows) < 1e-12
    assert {round(r["explained"], 12) for r in rows} == {0.25}


def test_deviation_beyond_a_long(spark):
    rows = got(spark, [(i, [1e6 * i, -1e6]) for i in range(-400, 401)])
    x = ints([[1e6 * i, -1e6] for i in range(-400, 401)])
    want = {i: sum((len(x) * a - b) ** 2 for a, b in zip(x[i + 400], x.sum(axis=0))) for i in range(-400, 401)}
    assert {r["vec_id"]: int(r["deviation_exact"]) for r in rows} == want
    assert {r["vec_id"] for r in rows if r["deviation"] is None} == {i for i, v in want.items() if v > 2**63 - 1} != set()


def test_polynomial_is_exact_and_roots_agree():
    rng = np.random.RandomState(6)
    a = rng.randint(-50, 50, (9, 6)).astype(object)
    m = a.T @ a
    primes = whitening.primes_below(2**31, whitening.primes_needed(int(np.trace(m)), 6))
    poly = whitening.chinese(primes, [whitening.charpoly_mod(np.array(m % p, np.int64), p) for p in primes])
    # Faddeev-LeVerrier, exactly
    c, b = [1], np.eye(6, dtype=int).astype(object)
    for k in range(1, 7):
        ab = m @ b
        c.append(-int(np.trace(ab)) // k)
        b = ab + c[-1] * np.eye(6, dtype=int).astype(object)
    assert poly == c[::-1]
    roots = whitening.largest_roots(poly, 6)
    assert [float(r) for r, _ in roots] == pytest.approx(np.linalg.eigvalsh(m.astype(float))[::-1], rel=1e-9)
    assert whitening.largest_roots([-20, 24, -9, 1], 3)[1][1] == 2  # (x - 5)(x - 2)^2
