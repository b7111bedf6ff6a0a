import random

import numpy as np

from llm.conftest import SCHEMA, VOCABULARY, prose, rows
from scanloom.llm import neardup
from scanloom.llm.components import components
from scanloom.llm.neardup import near_duplicates


def shingles(text, words=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()


def brute(texts, percent=80):
    ids = sorted({i for i, _ in texts if i is not None})
    sets = {i: shingles(t) for i, t in texts}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_against_brute_force_with_a_family_of_variants(spark):
    r = random.Random(5)
    base = prose(9, 150).split()
    texts = [(i, prose(100 + i, r.randint(1, 90))) for i in range(40)]
    for i in range(40, 110):  # variants around the limit, among them pairs that differ too much from each other
        own = list(base)
        for _ in range(r.randint(0, 9)):
            own[r.randrange(len(own))] = r.choice(VOCABULARY)
        texts.append((i, " ".join(own)))
    texts += [(200 + i, " ".join(base).upper()) for i in range(5)] + [(300, "a b c d e f"), (301, "a b c d e f g"), (302, "one two"), (303, "One  TWO")]
    assert result(near_duplicates(spark.createDataFrame(rows(texts), SCHEMA))) == brute(texts)


def test_an_id_with_two_texts_keeps_the_links_of_both(spark):
    one, two = prose(21, 60), prose(22, 70)
    texts = [(1, one), (1, two), (2, one + " more"), (3, two + " more"), (5, one), (6, two), (7, prose(23, 50))]
    got = result(near_duplicates(spark.createDataFrame(rows(texts), SCHEMA)))
    assert {i: c for i, (_, c, _) in got.items()} == {1: 1, 2: 1, 3: 1, 5: 1, 6: 1, 7: 7}


def test_a_large_family_below_the_limit_meets_seldom(spark, monkeypatch):
    """Variants of one text at 0.70 to 0.85: all links are found, and hardly a pair below the limit is compared in full."""
    r = random.Random(8)
    base = prose(31, 200).split()
    texts = []
    for i in range(130):
        own = list(base)
        for at in r.sample(range(0, 200, 4), r.choice([3, 5, 6, 7])):
            own[at] = r.choice(VOCABULARY) + str(i)
        texts.append((i, " ".join(own)))
    compared = []
    plain = neardup.confirmed

    def counting(pairs, *rest):
        compared.append(pairs.count())
        return plain(pairs, *rest)
    monkeypatch.setattr(neardup, "confirmed", counting)
    assert result(near_duplicates(spark.createDataFrame(rows(texts), SCHEMA))) == brute(texts)
    assert compared[-1] < 200


def test_odd_sketches_never_rule_out_a_pair():
    r = np.random.RandomState(3)
    for n in (0, 1, 50, 3000, 20000):
        a = r.randint(0, 2**62, n).astype(np.uint64)
        b = np.concatenate([a[r.rand(n) > 0.1], r.randint(0, 2**62, n // 9).astype(np.uint64)])
        apart = len(np.setxor1d(a, b))
        bits = int(np.unpackbits((neardup.odd_sketch(a) ^ neardup.odd_sketch(b)).view(np.uint8)).sum())
        assert bits <= apart and (apart > 200 or bits > 0.9 * apart - 2)


def test_odd_rows(odd, odd_texts):
    got = result(near_duplicates(odd))
    assert got == brute(odd_texts)
    assert got[1] == (0, 1, True) and got[2] == (0, 2, True)  # empty sets are linked with nothing
    assert got[10] == (57, 8, False)


def test_empty(empty):
    assert near_duplicates(empty).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a int, b int").filter("a IS NOT NULL")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}
