import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, rank string, size int"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with inner ones."""
    rng = random.Random(1)
    long = " ".join(words(rng, 30000, 5000))
    base = " ".join(words(rng, 80))
    x = [(1, base), (2, base), (3, base.upper().lower()), (4, None), (5, ""), (6, "  \n\t "), (7, "one two"), (8, "one two"), (9, long), (9, long), (10, "ünïcode 你好 " * 20), (None, base), (None, None), (11, base + " tail"), (12, "a\x00b c")]
    return [(i, t, "en" if k % 3 else None, None if k % 4 == 0 else f"s{k % 2}", None, 5, "r", 7) for k, (i, t) in enumerate(x)]


@pytest.fixture(scope="session")
def edge(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
