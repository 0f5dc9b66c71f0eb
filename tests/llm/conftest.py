import random

import pytest

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, h int, key string, row string, n long, version int, "
          "fp string, copies int, word string, shard string, slot int, kept string, score string, item string, `all` int, size int, root int, nth int")
EXTRA = len(SCHEMA.split(",")) - 5


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{int(rng.paretovariate(0.7)) % words}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, a very long text, repeated rows and ids, letters of other scripts."""
    rng = random.Random(5)
    long_text = "\n".join(prose(rng, 30) for _ in range(600))
    rows = [(1, None, "en", "a", 0), (2, "", "en", "b", 0), (3, " \t\n ", None, None, 4), (4, long_text, "en", "a", 1), (4, long_text, "en", "a", 1),
            (5, long_text.upper(), "de", "a", 1), (None, "Straße Ünï ÀÉ çà", "fr", "c", 3), (None, "Straße Ünï ÀÉ çà", "fr", "c", 3), (None, None, None, None, None),
            (None, "other words of a row without an id", "en", None, 9), (7, "one", "es", "b", 3), (8, "ONE", "es", "b", 3), (9, "one ", "es", "b", 3),
            (7, "one again with the same id", "es", "b", 3), (10, "\x00\x1c\x85 nul", "es", "😀", 3), (11, "123 456", "de", "￿", 7)]
    rows += [(100 + i, prose(rng, rng.randint(1, 80)), rng.choice(["en", "de"]), rng.choice("abc"), 1) for i in range(60)]
    rows += [(200 + i, "The same short text.\nAnd a second line of it.", "en", "a", 1) for i in range(25)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    clash = (None, 1, "k", "r", 2, 3, "f", 4, "w", "s", 5, "x", "y", "z", 6, 7, 8, 9)
    return spark.createDataFrame([r + clash for r in odd_rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)
