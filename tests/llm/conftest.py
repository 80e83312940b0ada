import random

import pytest


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words))


#: Rows with nulls in any column, empty and very long texts, ties, repeated rows; further columns clash with inner names.
AWKWARD = [
    (1, prose(1, 80), "en", "a", 1, "x"),
    (2, prose(1, 80), "en", "a", None, None),
    (2, prose(1, 80), "en", "a", None, None),
    (3, None, "en", "b", 2, "y"),
    (4, "", None, "b", 3, "y"),
    (5, "one", "en", None, 4, "z"),
    (None, prose(2, 60), "de", None, 5, "z"),
    (6, prose(3, 30_000), None, "a", 6, "q"),
    (7, "1234 5678 !?", "de", "c", 7, "q"),
    (8, "Zażółć gęślą jaźń 😀 \t\n tail  ", "pl", "c", 8, None),
]
SCHEMA = "doc_id long, text string, lang string, source string, size long, node string"


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
