import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, version string, node string, score double, revealed string, times int, _text string"


def rows_of(texts, *, ids=None, langs=None, sources=None):
    """Rows with further columns whose names the operators use themselves."""
    ids = ids if ids is not None else range(len(texts))
    langs = langs or ["en"] * len(texts)
    sources = sources or ["s"] * len(texts)
    return [(i, t, g, s, None if t is None else len(t), "x", "v", "n", 0.5, "r", 7, "z") for i, t, g, s in zip(ids, texts, langs, sources, strict=True)]


def prose(seed, words, vocabulary=4000):
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}" for _ in range(words))


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, **more):
        return spark.createDataFrame(rows_of(texts, **more), SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty, white space, one word, repeated rows, very long, other scripts."""
    long_text = prose(1, 60_000)
    return [None, "", " \n\t ", "word", "word", long_text, "naïve café 日本語 é \U0001f600", "a\n" * 300, prose(2, 80), prose(2, 80), None]


@pytest.fixture(scope="session")
def odd(make, odd_texts):
    return make(odd_texts, ids=[0, 1, None, 3, 4, 5, 6, 7, 8, 8, None], langs=["en", None, "en", "de", "de", "en", None, "fr", "en", "en", "fr"], sources=["a", "a", None, "b", "b", "a", "a", "c", "a", "a", None])


@pytest.fixture(scope="session")
def none(make):
    return make([])
