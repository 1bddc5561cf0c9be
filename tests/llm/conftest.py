import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    parts = ["ter", "an", "lo", "mi", "sta", "re", "en", "po", "qui", "da"]
    return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in any column, empty and long texts, repeated rows and ties."""
    base = prose(1, 120)
    rows = [
        (0, base, "en", "a", 1), (1, base, "en", "a", 1), (2, None, "fr", None, None), (3, "", None, "b", 0), (4, " \n\t ", "de", "b", 4), (5, "one", "en", "b", 3),
        (6, "One", "en", "b", 3), (7, base + " " + prose(2, 4), None, "c", 9), (7, base + " " + prose(2, 4), None, "c", 9), (None, base, "en", "c", 9),
        (None, None, None, None, None), (8, prose(3, 30_000), "es", "a", 1), (9, "ñandú " * 40 + "▁ 日本 🎉\x00   é", "es", "a", 1), (10, "x" * 5000, "en", "a", 1), (11, "123 456 !!", "en", "a", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
