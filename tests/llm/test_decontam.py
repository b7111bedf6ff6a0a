import hashlib
import re

from llm.conftest import prose
from scanloom.llm import decontam, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, size=10):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        length = min(size, len(w))
        for s in range(max(1, len(w) - size + 1)) if w else []:
            for at in range(len(own) - length + 1):
                if own[at:at + length] == w[s:s + length]:
                    hit.update(range(at, at + length))
                    found.add(str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, prose(2, 60)), (2, prose(40, 25)), (10, "Été word"), (11, "word"), (12, ""), (13, None), (2, prose(40, 25)), (3, "a b a b a b a b a b a b a b")]


def test_against_brute_force(spark, odd, odd_texts, monkeypatch):
    more = [(20, "A B " * 12), (21, prose(7, 20) + ". " + prose(40, 25).upper() + "\n" + prose(8, 5)), (22, " ".join(prose(40, 25).split()[3:12])), (23, "été WORD word")]
    docs = odd.select("doc_id", "text", "word", "n").union(spark.createDataFrame([(i, t, "w", 1) for i, t in more], "doc_id long, text string, word string, n int"))
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = sorted(((i, *brute(t, ITEMS)) for i, t in odd_texts + more), key=str)
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str) == want
    monkeypatch.setattr(decontam, "SLICE", 20)  # a benchmark that is met in slices
    assert sorted(map(tuple, decontam.contamination(docs, bench).collect()), key=str) == want


def test_empty(spark, odd, empty):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contamination(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(odd, bench.limit(0)).collect())


def test_no_python_on_the_way(odd, spark):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    for df in (decontam.contamination(odd, bench), licenses.scan(odd)):
        plan = df._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_licenses(spark, odd):
    notice = licenses.TEMPLATES["GPL-3.0"]
    texts = [(1, f"{prose(1, 40)}\n{notice}\n{prose(2, 40)}"), (2, f"{prose(3, 10)} ALL RIGHTS RESERVED {prose(4, 10)}"), (3, f"released {prose(5, 20)} license"),
             (4, notice.replace("version 3", "version 2")), (5, "Licensed under CC BY-NC 4.0. Released under the MIT License.")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: (r.n_licenses, r.licenses) for r in licenses.scan(docs).collect()}
    # One word in the last of eight shingles leaves 7 of 8.
    assert got == {1: (1, "GPL-3.0"), 2: (1, "All rights reserved"), 3: (0, ""), 4: (1, "GPL-3.0"), 5: (2, "CC-BY-NC-4.0; MIT")}
    assert all(r.n_licenses == 0 and r.containment == 0 for r in licenses.scan(odd).collect())
    assert licenses.scan(odd).count() == odd.count()
    assert licenses.scan(odd, templates={"none": "..."}).count() == odd.count()


def test_licenses_empty(empty):
    assert licenses.scan(empty).count() == 0


def test_bands_keep_their_promise():
    for length in range(3, 60):
        shape = licenses.Shape(length, min(5, length))
        s = licenses.least_similarity(shape, 80)
        assert s == 1 or (1 - s ** licenses.ROWS) ** licenses.bands_for(s) <= licenses.MISS
