import random

import pytest

import corpus_pipeline
from llm.conftest import VOCABULARY, prose
from llm.test_neardup import shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, docs, labels, items):
    spark.createDataFrame(docs, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def staged(spark, path):
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = stage(spark, docs, path)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        out[name] = docs
        assert name == "packing" or docs.columns == before
    return out


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(260):  # labelled, a quarter of them toxic
        w = prose(3000 + i, r.randint(20, 80)).split()
        if i % 4 == 0:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["zzvile", "qqfoul"]))
        docs.append((i, " ".join(w), ("en", "fr")[i % 2], "s"))
        labels.append((i, 1, int(i % 4 == 0)))
    base = prose(41, 120).split()
    for k in range(5):  # near copies, the first of them an exact one
        own = list(base)
        for _ in range(k):
            own[r.randrange(120)] = r.choice(VOCABULARY)
        docs.append((300 + k, " ".join(own), "en", "s"))
    docs += [(305, " ".join(base), "en", "s")]
    passage = prose(42, 70)
    docs += [(310 + k, f"{prose(500 + k, 40)} {passage} {prose(600 + k, 50)}", "fr", "s") for k in range(3)]
    item = prose(43, 30)
    docs += [(320, f"{prose(700, 30)}. {' '.join(item.split()[5:20]).upper()} {prose(701, 30)}", "en", "s"), (321, f"{prose(702, 30)} {' '.join(item.split()[5:13])}", "en", "s")]
    docs += [(330, None, None, None), (331, "", "en", None), (332, "one", "en", None), (None, prose(44, 50), "en", None), (333, prose(45, 9000), "en", None)]
    rows = [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in docs]
    path = folder(spark, tmp_path_factory.mktemp("planted"), rows, labels, [(1, item), (2, None)])
    return {i: t for i, t, *_ in rows}, staged(spark, path), path


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_toxic_documents_go_and_clean_ones_stay(planted):
    texts, out, _ = planted
    kept = ids(out["toxicity"])
    toxic = {i for i, t in texts.items() if t and ("zzvile" in t or "qqfoul" in t)}
    assert len(toxic & kept) <= 3
    assert len((set(texts) - toxic) - kept) <= 5
    assert {330, 331, None} <= kept


def test_one_of_each_near_group_stays(planted):
    texts, out, _ = planted
    given, kept = ids(out["toxicity"]), ids(out["near_dedup"])
    gone = given - kept
    sets = {i: shingles(texts[i], 5) for i in given if i is not None}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    want, root = set(), {i: i for i in sets if sets[i]}
    for a in sorted(root):
        for b in sorted(root):
            if a < b and near(a, b):
                x, y = root[a], root[b]
                root = {k: min(x, y) if v in (x, y) else v for k, v in root.items()}
    want = {i for i, v in root.items() if i != v}
    assert gone == want and 305 in gone


def test_repeated_passage_stays_once(planted):
    texts, out, _ = planted
    passage = prose(42, 70)
    rows = {r.doc_id: r for r in out["substring_dedup"].collect()}
    assert set(rows) == ids(out["near_dedup"])
    assert rows[310].text == texts[310]
    for i in (311, 312):
        assert 55 <= len(texts[i].split()) - len(rows[i].text.split()) <= 70 and passage not in rows[i].text and rows[i].n_chars == len(rows[i].text)
    assert all(rows[i].text == texts[i] for i in rows if i not in (311, 312, 301, 302, 303, 304))


def test_benchmark_passage_goes(planted):
    _, out, _ = planted
    assert ids(out["substring_dedup"]) - ids(out["decontamination"]) == {320}


def test_everything_left_is_packed(planted):
    _, out, _ = planted
    docs, pieces = out["decontamination"], out["packing"]
    assert ids(pieces) == ids(docs)
    per = {r["sequence_id"]: r["sum(length)"] for r in pieces.groupBy("sequence_id").sum("length").collect()}
    assert max(per.values()) <= 2048 and len(per) <= sum(per.values()) / 2048 + 2


def test_run_equals_the_stages(spark, planted):
    _, out, path = planted
    got = sorted(map(str, corpus_pipeline.run(spark, path).drop("sequence_id", "offset").collect()))
    assert got == sorted(map(str, out["packing"].drop("sequence_id", "offset").collect()))


def test_empty_tables(spark, tmp_path):
    path = folder(spark, tmp_path, [], [], [])
    assert corpus_pipeline.run(spark, path).count() == 0
