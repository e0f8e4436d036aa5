import random

import pytest

SCHEMA = "doc_id long, text string, n_words string, fp string, kept string, lang string"


def odd_rows() -> list[tuple]:
    """Nulls in any column, empty and long texts, ties, repeated rows, copies, near copies, clashing extra columns."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = prose(60)
    rows = [
        (None, "a text without an id", "x", None, "y", None),
        (1, None, None, None, None, None),
        (2, "", "x", "x", "x", "en"),
        (3, " \n\t ", "x", "x", "x", "en"),
        (4, "one", "x", "x", "x", "en"),
        (5, "two  spaces \n and\u00a0odd\u2003ones  ", "x", "x", "x", "en"),
        (6, "Ünïcödé — ταΣ 漢字 😀 e\u0301 it's THEY'LL 123 4567 <|endoftext|>", "x", "x", "x", "en"),
        (7, prose(40_000), "x", "x", "x", "en"),
        (8, "word " * 120, "x", "x", "x", "en"),
    ]
    for i in range(10, 40):
        rows.append((i, prose(rng.randint(1, 300)) + ("\n" + passage if i % 3 == 0 else "") + "." * (i % 2), "x", "x", "x", "en"))
    rows += [(i + 40, rows[-5][1], "x", "x", "x", "en") for i in range(5)]
    rows += [rows[12], rows[12], (12, "another text with an id that is taken", "x", "x", "x", "en")]
    return rows


@pytest.fixture(scope="session")
def rows():
    return odd_rows()


@pytest.fixture(scope="session")
def odd(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, 1, 0) for i in range(10, 45)] + [(None, 1, 0), (8, 0, 1)], "doc_id long, quality int, toxic int")
