import random

import pytest

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, rid string, fp int, key string, row long, word string, target string"


def odd_rows():
    """Null columns, empty and long texts, ties, repeated rows, copies but for white space, control strings."""
    rng = random.Random(5)
    words = [rng.choice(["the", "of", "un", "le", "zwei"]) + rng.choice("abcdefg") for _ in range(900)]
    long = " ".join(words * 12)
    texts = [
        (1, "One two  three four five six", "en", "b"),
        (2, "one two three four five six", "en", "b"),
        (3, "One two three four five six", "en", None),
        (3, "One two three four five six", "en", None),
        (4, "", None, "a"),
        (5, None, "en", "a"),
        (None, "One two three four five six", "fr", "c"),
        (None, None, None, None),
        (6, " \t\n ", "en", "a"),
        (7, long, "en", "b"),
        (8, long, "en", "c"),
        (9, long + " x", "de", "c"),
        (10, "12 34 !!", "en", "a"),
        (11, "é" * 700, "fr", "a"),
        (12, "été\x0bà la plage", "fr", "z"),
        (13, "𝒳 𝒴 " * 150, "en", "é"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 7, "r", 1, "k", 2, "w", "t") for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
