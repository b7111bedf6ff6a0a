import random

from llm.conftest import SCHEMA, prose, rows
from scanloom.llm.substring import remove_repeats, windows


def cut(spark, texts):
    out = remove_repeats(spark.createDataFrame(rows(texts), SCHEMA))
    return {r.doc_id: r for r in out.collect()}, out


def test_passage_goes_from_all_but_the_smallest_id(spark):
    passage = prose(50, 60)
    texts = [(i, f"{prose(60 + i, 30 + i)} {passage} {prose(90 + i, 40)}") for i in (5, 3, 8)] + [(9, prose(99, 100))]
    got, out = cut(spark, texts)
    assert out.columns == [*SCHEMA.replace(",", "").split()[::2], "removed_spans", "removed_bytes"]
    assert got[3].text == dict(texts)[3] and got[9].text == dict(texts)[9]
    for i in (5, 8):
        gone = len(dict(texts)[i].split()) - len(got[i].text.split())
        assert 45 <= gone <= 60
        assert passage not in got[i].text
        raw = dict(texts)[i].encode()
        assert all(raw[a:b].decode() in " " + passage for a, b in got[i].removed_spans)
        assert sum(b - a for a, b in got[i].removed_spans) == got[i].removed_bytes == len(raw) - len(got[i].text.encode())


def test_short_repeats_and_repeats_inside_a_document_stay(spark):
    line = prose(51, 13)
    texts = [(1, f"{prose(1, 50)}\n{line}\n{prose(2, 50)}"), (2, f"{prose(3, 50)}\n{line}\n{line}"), (3, f"{prose(4, 60)} {prose(4, 60)}")]
    got, _ = cut(spark, texts)
    assert {i: r.text for i, r in got.items()} == dict(texts)


def test_passages_without_spaces_go_too(spark):
    def run(seed, n, alphabet):
        r = random.Random(seed)
        return "".join(r.choice(alphabet) for _ in range(n))

    han, code = [chr(c) for c in range(0x4E00, 0x5200)], "abcdefghijklmnopqrstuvwxyz(){};=.,0123456789"
    for alphabet in (han, code):
        passage = run(1, 900, alphabet)
        texts = [(i, run(10 + i, 200 + 7 * i, alphabet) + passage + run(20 + i, 300, alphabet)) for i in (3, 5)] + [(7, run(30, 900, alphabet))]
        texts.append((9, texts[0][1]))
        got, _ = cut(spark, texts)
        assert got[3].text == texts[0][1] and got[7].text == texts[2][1]
        gone = len(texts[1][1]) - len(got[5].text)
        assert 500 <= gone <= 900
        raw = texts[1][1].encode()
        assert all(raw[a:b].decode() in passage for a, b in got[5].removed_spans)
        assert len(got[9].text) <= 200


def test_cuts_resist_insertions():
    text = prose(7, 400).encode()
    moved = b"some words before it " + text
    a, b = (next(windows([t], 32)) for t in (text, moved))
    shift = len(moved) - len(text)
    own, other = set(a[0].tolist()), {c - shift for c in b[0].tolist()}
    assert len(own - other) <= 4
    assert len(set(a[2].tolist()) - set(b[2].tolist())) <= 8


def test_odd_rows(odd, odd_texts):
    got = sorted(((r.doc_id, r.text, r.keys) for r in remove_repeats(odd).collect()), key=str)
    want = dict.fromkeys(odd_texts)
    # Document 10 repeats document 8, whose two rows share an id and stay.
    assert [x for x in got if x[0] != 10] == sorted(((i, t, "k") for i, t in odd_texts if i != 10), key=str)
    assert len(next(x for x in got if x[0] == 10)[1].split()) <= 8
    assert len(want) == len(odd_texts) - 1


def test_empty(empty):
    assert remove_repeats(empty).count() == 0
