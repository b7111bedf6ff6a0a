import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scanloom.llm.packing import WordIds, pack, plan

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_every_piece_once_and_sequences_without_gaps(odd, odd_texts):
    got = [tuple(r) for r in pack(odd, PATH, capacity=512).collect()]
    t, want = Tokenizer.from_file(PATH), []
    for i, text in odd_texts:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(i, p, a, len(ids[a:a + 512]), zlib.crc32(ids[a:a + 512].tobytes())) for p, a in enumerate(range(0, len(ids), 512))]
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted((r[:5] for r in got), key=key) == sorted(want, key=key)
    at = {}
    for r in sorted(got, key=lambda r: (r[5], r[6])):
        assert r[6] == at.get(r[5], 0)
        at[r[5]] = r[6] + r[3]
    assert max(at.values()) <= 512
    assert len(at) <= -(-sum(r[3] for r in want) // 512) + 1


def test_empty(empty):
    assert pack(empty, PATH).count() == 0


@pytest.mark.parametrize("text", ["Hello, WORLD!! don't stop... É école", "<|endoftext|> a <|ENDOFTEXT|>", "a b\x85c 12.5 1x! ́a é", "ÇA VA? été!!! İstanbul ΑΣ ας,.;"])
def test_word_ids_equal_the_tokenizer(text):
    own = WordIds(PATH)
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own(text).tolist() == want
    assert own(text).tolist() == want  # from the cache


@pytest.mark.parametrize("text", ["<|endoftext|> Hello NASA", "<| Hello, NASA! École", "H\u0331 Hello h\u0331", "T\u0308 J\u030c W\u030a Y\u030a NASA", "H\u1dc0\u0331 e\u0301 E\u0301"])
def test_capitals_beside_special_tokens_and_combining_marks(text):
    own = WordIds(PATH)
    want = own.tokenizer.encode(text, add_special_tokens=False).ids
    assert own(text).tolist() == want


def test_plan_replaces_the_smallest_by_two_that_fit_tighter():
    # Greedy fills 6 + 3 and leaves 1; 6 + 2 + 2 fills the bin.
    assert plan({6: 1, 3: 1, 2: 2}, 10) == [({6: 1, 2: 2}, 1), ({3: 1}, 1)]


def test_plan_uses_every_piece_once():
    rng = np.random.RandomState(1)
    counts = {int(k): int(rng.randint(1, 500)) for k in rng.choice(np.arange(1, 121), 90, replace=False)}
    used, bins = dict.fromkeys(counts, 0), 0
    for pattern, times in plan(counts, 256):
        assert sum(k * n for k, n in pattern.items()) <= 256
        bins += times
        for k, n in pattern.items():
            used[k] += n * times
    assert used == counts
    least = max(sum(k * n for k, n in counts.items()) / 256, sum(n for k, n in counts.items() if k > 128))
    assert bins <= 1.02 * least + 1
