import math
import random

import numpy as np
import pyarrow as pa
import pytest
import pyspark.sql.functions as F

from llm.conftest import SCHEMA, VOCABULARY, prose, rows
from scanloom.llm import hpylm, langid, quality, toxicity, words


def test_pack_round_trip():
    rng = np.random.RandomState(1)
    for n in (0, 1, 5, 1000):
        keys = np.sort(rng.randint(0, 2**62, n).astype(np.uint64) * np.uint64(3))
        assert (words.unpack(words.pack(keys)) == keys).all()
        assert (words.unpack_small(words.pack_small(keys)) == keys).all()


def test_word_hashes_are_those_of_equal_words():
    texts = [b"ab cd ab", b"", b"  cd\tx\n", b"ab"]
    h, first = words.word_hashes(texts, words.separators())
    w = [t.split() for t in texts]
    assert np.diff(first).tolist() == [len(x) for x in w]
    flat = sum(w, [])
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(len(flat)))


# language id

TONGUES = {"aa": "abcdefgh", "bb": "efghijkl", "cc": "ijklmnop"}


def speech(lang, seed, n=60):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(TONGUES[lang]) for _ in range(r.randint(2, 7))) for _ in range(n))


def test_language_id(spark, odd, empty):
    docs = spark.createDataFrame([(i, speech(k, i), k) for i in range(60) for k in TONGUES] + [(99, None, "aa"), (98, "x", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs, learn=F.col("doc_id") < 40)
    got = docs.filter("doc_id >= 40 AND doc_id < 90").select("lang", langid.identify(model, F.col("text")).alias("p")).collect()
    assert all(r.lang == r.p.lang_pred and r.p.accepted and 0.9 < r.p.score <= 1 for r in got)
    foreign = spark.createDataFrame([("zzz yyy xxx www " * 9,)], "text string").select(langid.identify(model, F.col("text")).alias("p")).first().p
    assert foreign.lang_pred in TONGUES and not foreign.accepted
    odd_rows = {(r.doc_id, r.text): r.p for r in odd.select("doc_id", "text", langid.identify(model, F.col("text")).alias("p")).collect()}
    for (i, t), p in odd_rows.items():
        assert (p.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and 0 <= p.score <= 1
    nothing = langid.fit(empty)
    assert [r.p.lang_pred for r in odd.select(langid.identify(nothing, F.col("text")).alias("p")).collect()] == ["und"] * len(odd_rows | {1: 1})


def test_kneser_ney_probabilities_sum_to_one():
    codes = langid._grams(langid.codes(speech("aa", 1, 300)))
    symbols = np.unique(langid._tail(codes, 1))
    kn = langid._KneserNey(codes, len(symbols) + 1)
    for ctx in (codes[50] >> np.uint64(16), np.uint64(0xFFFF << 16 | 7)):
        keys = (np.uint64(ctx) << np.uint64(16)) | symbols
        unseen = (np.uint64(ctx) << np.uint64(16)) | np.uint64(0xFFFF)
        assert abs(kn.prob(4, keys).sum() + kn.prob(4, np.array([unseen]))[0] - 1) < 1e-9


# Pitman-Yor

def test_pitman_yor_counts_base_and_odd_rows(spark, odd, odd_texts):
    texts = odd_texts + [(100 + i, prose(i % 7, 200)) for i in range(12)]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    held = F.coalesce(F.col("doc_id") % 3 == 1, F.lit(False))
    model = hpylm.fit(docs, learn=~held)
    got = sorted((tuple(r) for r in hpylm.score(model, docs, held).collect()), key=str)
    counts, own = {}, {}
    for i, t in texts:
        w = [*(t or "").encode().lower().split(), b" "]
        own[i, t] = w
        if i is None or i % 3 != 1:
            for x in w:
                counts[x] = counts.get(x, 0) + 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t in texts:
        w = own[i, t]
        want.append((i, i is not None and i % 3 == 1, len(w), sum(x in counts for x in w), n, sum(math.log10((counts.get(x, 0) + 0.5) / (n + 0.5 * (v + 1))) for x in w)))
    want.sort(key=str)
    assert [g[:5] for g in got] == [x[:5] for x in want]
    assert np.allclose([g[5] for g in got], [x[5] for x in want])
    assert all(g[6] < 0 for g in got)


def test_pitman_yor_is_a_distribution(spark):
    docs = spark.createDataFrame([(i, prose(i % 9, 300) + " a b a b a") for i in range(30)], "doc_id long, text string")
    model = hpylm.fit(docs)
    s = model.settings
    shard_rows = model.dishes.collect()
    for ctx in range(0, len(s.frequent) + 1, max(1, len(s.frequent) // 5)):
        total = 0.0
        for r in shard_rows:
            d = hpylm.Shard.of(words.unpack(r["keys"]), words.unpack_small(r["counts"]))
            key = (d.word << np.uint64(hpylm.CTX_BITS)) | np.uint64(ctx)
            dish, seen = words.lookup(d.key, key)
            total += hpylm._averaged(d, s, model.history, r["shard"], np.where(seen, dish, -1), np.arange(len(d.word)), np.full(len(key), ctx)).sum()
        assert abs(total + hpylm._unseen(s, model.history, np.array([ctx]))[0] - 1) < 1e-9


def seat_one_by_one(c, others, prior, d, strength, sweeps, r):
    """Mean tables of a dish when single customers leave and are seated again given all others."""
    sizes, seen = [c], 0
    for sweep in range(sweeps + 20):
        for _ in range(c):
            at = r.choices(range(len(sizes)), sizes)[0]
            sizes[at] -= 1
            if not sizes[at]:
                sizes.pop(at)
            weights = [x - d for x in sizes] + [(strength + d * (others + len(sizes))) * prior]
            at = r.choices(range(len(weights)), weights)[0]
            sizes[at:at + 1] = [sizes[at] + 1] if at < len(sizes) else [1]
        seen += len(sizes) if sweep >= 20 else 0
    return seen / sweeps


def test_seating_is_the_conditional_of_single_customers():
    rng = np.random.default_rng(1)
    n = 20000
    for c, others, prior, d in ((30, 1000, 0.01, 0.8), (12, 5, 0.3, 0.4), (60, 30, 0.02, 0.6)):
        got = hpylm.seat(np.full(n, c), np.full(n, float(others)), np.full(n, prior), d, 1.0, rng).mean()
        assert abs(got - seat_one_by_one(c, others, prior, d, 1.0, 1500, random.Random(3))) < 0.03 * got
    assert hpylm.seat(np.ones(5, int), np.zeros(5), np.ones(5), 0.6, 1.0, rng).tolist() == [1] * 5


def test_seating_of_large_dishes(monkeypatch):
    cases = [(3000, o, p, d) for o, p, d in ((1e3, 0.001, 0.6), (1e3, 0.5, 0.5), (1e4, 0.01, 0.8), (1e5, 0.01, 0.8), (1e6, 0.01, 0.8), (1e6, 0.001, 0.6), (100, 0.3, 0.9), (0, 0.0001, 0.05))]
    n, rng = 2000, np.random.default_rng(2)
    got = [hpylm.seat(np.full(n, c), np.full(n, o), np.full(n, p), d, 1.0, rng) for c, o, p, d in cases]
    monkeypatch.setattr(hpylm, "EXACT", 3000)
    for (c, o, p, d), tables in zip(cases, got):
        t = np.arange(1, c + 1)
        w = np.cumsum(np.log((1 + d * (o + t - 1)) * p)) + hpylm._log_stirling.__wrapped__(d)[c, 1:]
        w = np.exp(w - w.max()) / np.exp(w - w.max()).sum()
        mean = (w * t).sum()
        deviation = math.sqrt((w * t * t).sum() - mean**2)
        assert abs(tables.mean() - mean) < 0.015 * mean + 4 * deviation / math.sqrt(n), (o, p, d)
        assert abs(tables.std() - deviation) < 0.1 * deviation + 0.05, (o, p, d)


def test_frequent_words_do_not_depend_on_batches(spark):
    # 99 of 200,000 tokens are not a share of 1/2000, 100 are; both come in few texts and in many.
    filler = [f"w{i}" for i in range(30000)]
    words_ = ["edge"] * 99 + ["just"] * 100 + [filler[i % 30000] for i in range(199301)]
    random.Random(5).shuffle(words_)
    found = []
    for texts, parts in ((500, 1), (500, 40)):
        size = -(-len(words_) // texts)
        docs = spark.createDataFrame([(" ".join(words_[i * size:(i + 1) * size]),) for i in range(texts)], "text string").repartition(parts)
        frequent, total = hpylm.frequent_words(docs)
        assert total == 200000
        found.append(set(frequent.tolist()))
    name = lambda w: int(hpylm.tokens([w])[0][0])
    assert found[0] == found[1] == {int(hpylm.END), name(b"just")}


def test_pitman_yor_without_training_rows(spark, odd, empty):
    model = hpylm.fit(odd, learn=F.lit(False))
    got = hpylm.score(model, odd, F.lit(True)).collect()
    assert len(got) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 and abs(r.score) < 1e-9 for r in got)
    assert hpylm.score(model, empty, F.lit(True)).count() == 0


# quality

def test_quality_prefers_trusted_words(spark, odd, empty):
    r = random.Random(2)
    docs = [(i, prose(1000 + i, 80), "en" if i % 2 else None) for i in range(120)]
    junk = [(500 + i, " ".join(VOCABULARY[r.randrange(3000)].upper() + "!!" for _ in range(80)), "en") for i in range(20)]
    table = spark.createDataFrame(docs + junk, "doc_id long, text string, lang string")
    trusted = table.filter("doc_id < 100").select("doc_id")
    model = quality.fit(table, trusted, sample=quality.Sample(rows=30))
    got = {x.doc_id: x for x in quality.classify(model, table, trusted).collect()}
    assert len(got) == 140
    assert not any(got[i].kept for i, _, _ in junk)
    assert sum(got[i].kept for i, _, _ in docs) >= 110
    assert {x.doc_id: x.n_tokens for x in got.values()} == {i: len(t.split()) + 1 for i, t, _ in docs + junk}
    assert quality.classify(model, odd).count() == odd.count()
    assert quality.classify(model, empty).count() == 0
    none = odd.limit(0).select("doc_id")
    assert all(x.kept for x in quality.classify(quality.fit(odd, none), odd, none).collect())


def test_quality_learns_from_every_trusted_row(spark):
    texts = [f"only{i} {prose(i, 3)}" for i in range(700)] + [f"{prose(1, 5000)} farback"]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").cache()
    got = quality.classify(quality.fit(docs, docs.select("doc_id")), docs).collect()
    assert len(got) == 701 and all(x.n_known == x.n_tokens for x in got)


def test_quality_filter_is_bounded_and_loses_nothing(spark, monkeypatch):
    docs = spark.createDataFrame([(i, prose(i, 40), "en") for i in range(40)], "doc_id long, text string, lang string").cache()
    wide = quality.fit(docs, docs.select("doc_id"))
    want = sorted((x.doc_id, x.n_known, round(x.perplexity, 3)) for x in quality.classify(wide, docs).collect())
    monkeypatch.setattr(quality, "FILTER_BITS", 1)
    monkeypatch.setattr(quality, "HOT", 5)
    narrow = quality.fit(docs, docs.select("doc_id"))
    assert len(narrow.filter) == narrow.n * 128 and len(narrow.hot) == 5
    assert sorted((x.doc_id, x.n_known, round(x.perplexity, 3)) for x in quality.classify(narrow, docs).collect()) == want


def test_quality_equals_a_plain_back_off_model(spark):
    texts = [prose(i % 5, 30) for i in range(12)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = quality.fit(docs, docs.select("doc_id"))
    got = {x.doc_id: x.perplexity for x in quality.classify(model, docs.union(spark.createDataFrame([(99, "new words " + texts[0][:60], "en")], docs.schema))).collect()}
    tri = {}
    for t in texts:
        w = ["<e>", "<e>", *t.split(), "<e>"]
        for a in zip(w, w[1:], w[2:]):
            tri[a] = tri.get(a, 0) + 1
    bi, uni = {}, {}
    for a in tri:
        bi[a[1:]] = bi.get(a[1:], 0) + 1
    for a in bi:
        uni[a[1:]] = uni.get(a[1:], 0) + 1

    def cuts(c):
        n = [0] + [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        if not all(n[1:4]):
            return [0.5] * 3
        y = n[1] / (n[1] + 2 * n[2])
        return [min(i - 0.05, max(0.05, i - (i + 1) * y * n[i + 1] / n[i])) for i in (1, 2, 3)]

    def prob(gram):
        if not gram:
            return 1 / quality.BASE_WORDS
        table = {1: uni, 2: bi, 3: tri}[len(gram)]
        d, low = cuts(table), prob(gram[1:])
        own = {g: c for g, c in table.items() if g[:-1] == gram[:-1]}
        if not own:
            return low
        total = sum(own.values())
        c = own.get(gram, 0)
        return (max(0, c - d[min(c, 3) - 1]) if c else 0) / total + sum(d[min(x, 3) - 1] for x in own.values()) / total * low

    for i, t in [*enumerate(texts), (99, "new words " + texts[0][:60])]:
        w = ["<e>", "<e>", *t.split(), "<e>"]
        logp = sum(math.log10(prob(a)) for a in zip(w, w[1:], w[2:]))
        assert math.isclose(got[i], 10 ** (-logp / (len(w) - 2)), rel_tol=1e-4)


# toxicity

def toxic_corpus():
    r = random.Random(4)
    out = []
    for i in range(400):
        w = prose(2000 + i, r.randint(5, 90)).split()
        bad = i % 4 == 0
        if bad:
            w.insert(r.randrange(len(w)), r.choice(["zzvile", "qqfoul", "zzviles"]))
        out.append((i, " ".join(w), "en" if i % 2 else "fr", int(bad)))
    return out


def test_toxicity(spark, odd, empty):
    rows_ = toxic_corpus()
    docs = spark.createDataFrame([x[:3] for x in rows_], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], 1, x[3]) for x in rows_] + [(7, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels, learn=F.col("doc_id") < 300)
    score = {x.doc_id: x.s for x in docs.select("doc_id", toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()}
    right = sum((score[i] >= 0.3) == bool(y) for i, _, _, y in rows_[300:])
    assert right >= 95
    got = [x.s for x in odd.select(toxicity.toxicity_score(model, F.col("text")).alias("s")).collect()]
    assert len(got) == odd.count() and all(0 <= s <= 1 for s in got)
    cut = docs.select(toxicity.language_threshold(model, F.col("lang")).alias("c")).distinct().collect()
    assert all(0 < x.c < 1 for x in cut)
    one_class = toxicity.fit(docs, labels.filter("toxic = 0"))
    assert all(x.s < 0.01 for x in docs.select(toxicity.toxicity_score(one_class, F.col("text")).alias("s")).collect())
    assert empty.select(toxicity.toxicity_score(model, F.col("text")).alias("s")).count() == 0


def test_toxicity_scoring_equals_the_trained_network(spark):
    texts = [t for _, t, _, _ in toxic_corpus()[:60]] + ["", "one", None]
    rng = np.random.RandomState(1)
    k = len(toxicity.WIDTHS) * toxicity.FILTERS
    model = toxicity.Model(rng.normal(size=(toxicity.HASHES, 1 << toxicity.BITS, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(size=k), 0.05 * rng.normal(size=k), 0.1)
    b, first = toxicity._buckets([words.lowered(t) for t in texts])
    plain = toxicity._score_buckets(model, [b[a:z] for a, z in zip(first[:-1], first[1:])])
    assert np.allclose(toxicity.score_texts(model, texts), plain, atol=1e-4)


def test_toxicity_learns_from_every_labelled_row_and_long_texts(spark, monkeypatch):
    """The one foul word stands in long texts only; rows are many shards, and a cut counts every held-out row."""
    monkeypatch.setattr(toxicity, "SHARD", 60)
    seen = [(i, prose(5000 + i, 40), 0) for i in range(300)] + [(1000 + i, prose(6000 + i, 2300) + " zzvile", 1) for i in range(60)]
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in seen], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in seen], "doc_id long, toxic int")
    assert toxicity.labelled(docs, labels, F.lit(True), "doc_id", "text", "lang").count() == len(seen)
    model = toxicity.fit(docs, labels)
    foul, clean = toxicity.score_texts(model, ["some words zzvile", "some words"])
    assert foul > clean
    assert 0 < model.thresholds["en"] < 1
    assert toxicity._best_cut(np.array([0.1, 0.9, 0.5]), np.array([10, 0, 1]), np.array([0, 3, 3])) == 0.3


def test_toxicity_texts_meet_labels_once_and_sums_come_in_slices(spark, monkeypatch):
    """Texts are dealt by one shuffle whatever the labels' size, and the driver gets one array however many shards there are."""
    monkeypatch.setattr(toxicity, "SHARD", 20)
    rows_ = toxic_corpus()
    docs = spark.createDataFrame([x[:3] for x in rows_] + [(5, "the second text of an id", None), (None, "no id", "en"), (9999, "no label", "en"), (6, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows_] + [(5, 1), (None, 1), (8888, 1)], "doc_id int, toxic int")
    dealt, count, size, toxic, _ = toxicity._dealt(docs, labels, F.col("doc_id") < 350, "doc_id", "text", "lang")
    assert "Join" not in dealt._jdf.queryExecution().executedPlan().toString()
    got = {r.shard: [x for batch in batches_of(r.texts) for x in batch.to_pylist()] for r in dealt.collect()}
    every = [x for v in got.values() for x in v]
    assert sorted((x["id"], x["text"]) for x in every) == sorted([(i, t) for i, t, _, _ in rows_ if i < 350] + [(5, "the second text of an id")])
    assert all(x["y"] == (x["id"] == 5 or {i: y for i, _, _, y in rows_}[x["id"]]) for x in every)
    train = [x for s, v in got.items() if s < count for x in v]
    assert len(train) == size and sum(x["y"] for x in train) == toxic and count == -(-size // 20) > 10
    # The filter of labelled ids loses none of them, spares most others, and a full one lets all pass.
    known = spark.range(500).select(toxicity._hash("id").alias("h"))
    others = spark.range(10_000, 20_000).select(toxicity._hash("id").alias("h"))
    bits = toxicity._bits(known, 1 << 13)
    assert len(bits) == 1 << 10 and known.filter(toxicity._maybe(bits, F.col("h"))).count() == 500
    assert others.filter(toxicity._maybe(bits, F.col("h"))).count() < 1000
    monkeypatch.setattr(toxicity, "FILTER_BITS", 1 << 10)
    assert sum(batches_of(r.texts).read_all().num_rows for r in toxicity._dealt(docs, labels, F.col("doc_id") < 350, "doc_id", "text", "lang")[0].collect()) == len(every)
    ones = toxicity._sums(dealt.filter(F.col("shard") < count), lambda shard, words, y: np.arange(1000) * len(y)).collect()
    assert sum(len(r.out) for r in ones) == 8 * 1000 and max(len(r.out) for r in ones) <= 8 * 16
    assert (toxicity._over_shards(dealt.filter(F.col("shard") < count), lambda shard, words, y: np.arange(1000) * len(y)) == np.arange(1000) * size).all()


def test_toxicity_learns_from_labelled_texts_without_words(spark):
    rows_ = toxic_corpus()[:200] + [(1000, "", "en", 0), (1001, " \n", "en", 1), (1002, "!!! ... ???", None, 0), (1003, "", "fr", 0), (1004, "--", "fr", 0), (1005, "", "fr", 0)]
    docs = spark.createDataFrame([x[:3] for x in rows_], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(x[0], x[3]) for x in rows_], "doc_id long, toxic int")
    assert {r.h % 5 == 4 for r in docs.filter("doc_id >= 1000").select(toxicity._hash("doc_id").alias("h")).collect()} >= {False}
    model = toxicity.fit(docs, labels)
    foul, clean, none = toxicity.score_texts(model, ["some words zzvile", "some words", ""])
    assert foul > clean and foul > none


@pytest.mark.parametrize("bound", [{"SHARD": 20}, {"SHARD_BYTES": 4000}])
def test_toxicity_no_id_makes_a_shard_large(spark, monkeypatch, bound):
    """Two ids, one of them held out, have most of the rows: shards stay bounded in texts or bytes, and no row is lost."""
    for k, v in bound.items():
        monkeypatch.setattr(toxicity, k, v)
    held = {r.id: r.h % 5 == 4 for r in spark.range(50).select("id", toxicity._hash("id").alias("h")).collect()}
    ids = [*range(50), *[next(i for i in held if not held[i])] * 150, *[next(i for i in held if held[i])] * 100]
    docs = spark.createDataFrame([(i, prose(n, 30), "en") for n, i in enumerate(ids)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    dealt, count, size, toxic, _ = toxicity._dealt(docs, labels, F.lit(True), "doc_id", "text", "lang")
    got = {r.shard: batches_of(r.texts).read_all().to_pylist() for r in dealt.collect()}
    assert sorted((x["id"], x["text"]) for v in got.values() for x in v) == sorted((i, prose(n, 30)) for n, i in enumerate(ids))
    assert all(x["y"] == x["id"] % 2 and held[x["id"]] == (s >= count) for s, v in got.items() for x in v)
    assert sum(len(v) for s, v in got.items() if s < count) == size and sum(x["y"] for s, v in got.items() if s < count for x in v) == toxic
    most = max(len(v) if "SHARD" in bound else sum(len(x["text"]) for x in v) for v in got.values())
    assert count > 5 and most < 2.5 * next(iter(bound.values()))


def test_toxicity_reads_long_texts_in_steps(monkeypatch):
    """The same scores, words and training step as from whole texts, whatever the steps; a word longer than a step is not cut."""
    rng = np.random.RandomState(2)
    k = len(toxicity.WIDTHS) * toxicity.FILTERS
    texts = [prose(7, 400), prose(8, 3) + " " + "x" * 300 + " end", "!" * 200, "y" * 500, "a b", "  " + prose(9, 150) + " " * 90, "z" * 100 + "."]
    model = toxicity.Model(rng.normal(size=(toxicity.HASHES, 1 << toxicity.BITS, toxicity.DIM)), [rng.normal(size=(w, toxicity.DIM, toxicity.FILTERS)) for w in toxicity.WIDTHS], rng.normal(size=k), 0.05 * rng.normal(size=k), 0.1)
    table = pa.table({"id": range(len(texts)), "text": texts, "y": [i % 2 for i in range(len(texts))]})

    def trained():
        rows, y = toxicity._texts(table)
        p = toxicity._start(np.zeros((toxicity.HASHES, 1 << toxicity.BITS), np.float32), 1)
        toxicity._epoch(p, rows, y, 0, [1])
        return rows, toxicity._flat(p)

    whole, (rows, flat) = toxicity.score_texts(model, texts), trained()
    taken = []
    monkeypatch.setattr(toxicity, "_buckets", lambda part, f=toxicity._buckets: taken.append(sum(map(len, part))) or f(part))
    monkeypatch.setattr(toxicity, "TOGETHER", 64)
    monkeypatch.setattr(toxicity, "STEP", 5)
    assert np.allclose(toxicity.score_texts(model, texts), whole, rtol=1e-6)
    own, moved = trained()
    assert all((a == b).all() for a, b in zip(rows, own)) and np.allclose(moved, flat, atol=1e-5)
    assert max(taken) <= 500 and sorted(taken)[-4] <= 310 and b"".join(words.pieces(texts[0].encode(), toxicity._TABLE, 64)) == texts[0].encode()


def batches_of(stream):
    return pa.ipc.open_stream(stream)


def test_pitman_yor_totals_are_one_row_a_part(spark):
    """What shards say of all contexts is summed in packed rows; the sums are those of plain counting."""
    docs = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 37 + 1))) for i in range(90)], "doc_id long, text string")
    model = hpylm.fit(docs)
    sums = hpylm._summed(model.dishes, model.settings, [])
    n = sum(i % 37 + 2 for i in range(90))
    assert [r.ctx for r in sums] == [*range(len(model.settings.frequent) + 1), -1, -2, -3]
    assert sum(r.a for r in sums if r.ctx >= 0) == n == model.settings.tokens
    assert next(r.c for r in sums if r.ctx == -1) == 38
