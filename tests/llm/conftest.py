import os
import random

import pytest

FOLDER = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")

_r = random.Random(3)
VOCABULARY = ["".join(_r.choice("abcdefghij") for _ in range(_r.randint(2, 9))) for _ in range(3000)]


def prose(seed: int, words: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(words))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rep string, n int, keys string, shard int, word string"


def rows(texts):
    """(id, text) pairs as documents with extra columns whose names operators might use inside."""
    return [(i, t, "en", None, None if t is None else len(t), "x", 1, "k", 3, "w") for i, t in texts]


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, one word, very long, no spaces, beyond ASCII, repeated rows, no id."""
    long = prose(1, 30_000)
    return [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, long), (6, "x" * 50_000), (7, "été ñandú 漢字 🙂 İ"), (8, prose(2, 60)), (8, prose(2, 60)),
            (None, prose(4, 40)), (9, "!!! ... ???"), (10, prose(2, 60)), (-3, prose(5, 80))]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    return spark.createDataFrame(rows(odd_texts), SCHEMA).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
