import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, size long, node long, n long, rank double, bin int, kept string, key string, found string, __part int"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    """Nulls in every column, empty, blank and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(3)
    base, shared = words(rng, 300), words(rng, 150)
    texts = [None, "", " \n\t ", "one", "one two three four", "Ünïcode ÄÖ  x y", "a b", "<|endoftext|> b\n\n c\td", base, base, base.upper()]
    texts += [base.replace(" w7 ", " zz ", 1), base + " tail", words(rng, 20_000, 5000), ("go " * 800).strip(), "# $ % " * 50]
    texts += [words(rng, 60) + " " + shared + " " + words(rng, 40 + k) for k in range(6)] + [words(rng, rng.randrange(5, 200)) for _ in range(60)]
    rows = [(k, t, "en", None if k % 7 == 0 else f"s{k % 5}", k, k, k, k, 0.5, k, "x", "y", "z", 1) for k, t in enumerate(texts)]
    rows += [rows[8], rows[20], (None, texts[21], None, None, None, *[None] * 9), (None, None, None, None, None, *[None] * 9), (5, words(rng, 30), *rows[5][2:])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)
