"""Tables with every awkward case, under column names that the operators also use inside."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, label string, row long, draw string, unit string, word string, size long, t string"
WORDS = [a + b + c for a in "bcdfglmn" for b in "aeiou" for c in ("n", "r", "st", "l", "")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def rows_of(texts):
    """(doc_id, text, lang, source) rows padded with the clashing columns."""
    return [(i, t, lang, source, None, "k", "l", 7, "d", "u", "w", 3, "t") for i, t, lang, source in texts]


ODD = [
    (1, None, "en", "a"),
    (2, "", "en", "a"),
    (3, " \n\t\x0b ", None, "b"),
    (4, "word", "en", None),
    (5, "Word", "en", "b"),
    (6, prose(1, 40), "en", "a"),
    (7, prose(1, 40), "en", "a"),
    (7, prose(1, 40), "en", "a"),
    (8, prose(1, 40).replace(" ", "\n"), None, None),
    (9, prose(2, 30_000), "de", "a"),
    (10, prose(3, 200), "de", "c"),
    (11, "x " + prose(3, 200), "de", "c"),
    (12, "12 345 !!", "fr", "c"),
    (None, "a null id", "fr", None),
    (13, "éàü ß 漢字 \U0001f600 é", "fr", "a"),
    (14, "A-" * 30_000, "fr", "b"),
    (15, "½ ² ① 7", "fr", "b"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(rows_of(ODD), COLUMNS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
