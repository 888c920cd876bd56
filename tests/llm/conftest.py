import random

import pytest

WORDS = "the and attion thanedble anea eriner estion wh ntou tire ndonon eahe ansh hahe onin tionly edin heonth saou zur che lique".split()


@pytest.fixture(scope="session")
def prose():
    """Random texts, from a seed."""

    def make(n, seed):
        r = random.Random(seed)
        return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "ed", ",", "."]) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def frame(spark):
    """documents with clashing extra columns; rows are (doc_id, text) or (doc_id, text, lang, source)."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), 0, "kept", 1, 2) for r in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, kept string, row int, n int").repartition(3)

    return make


ODD = [(None, "a b c d e f g h i j"), (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (5, "x" * 300_000), (6, "é😀\u0001 ñandú " * 50), (7, "a\x00b " * 100), (8, "w " * 30_000)]


@pytest.fixture(scope="session")
def odd(frame):
    """Nulls, empty, blank, repeated and very long texts."""
    return frame(ODD)


@pytest.fixture(scope="session")
def none(frame):
    return frame(ODD).where("false")
