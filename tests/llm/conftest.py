import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept boolean, spans string, score double, words int, n int, fp int, digest string, block string"


def table(spark, rows):
    """documents with extra columns whose names clash with inner ones."""
    full = [(i, t, "en", s, len(t or ""), None, "x", 0.5, 1, 2, 3, "d", "b") for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


ROWS = [
    (1, "The Quick brown fox. " + words(60, 1), "a"),
    (2, "the quick BROWN fox. " + words(60, 1), "a"),
    (3, None, "a"),
    (4, "", None),
    (5, " \t\n ", "b"),
    (6, words(3000, 2), "b"),
    (7, words(60, 3) + "\n" + words(30, 4), "b"),
    (8, words(60, 3) + "\n" + words(30, 5), "c"),
    (8, words(60, 3) + "\n" + words(30, 5), "c"),
    (None, words(20, 6), None),
    (9, "Straße İstanbul ÀÉ x y 日本 😀  double  space\r\nnext", "c"),
    (10, "one", "c"),
]


@pytest.fixture
def docs(spark):
    return table(spark, ROWS)


@pytest.fixture
def no_docs(spark):
    return table(spark, [])
