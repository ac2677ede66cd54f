import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, size long, _vslot int, _copies int, h long"


def some_words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" + rnd.choice(["", "", "", ",", "."]) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Null and empty texts, null ids, repeated rows, copies, a very long text, columns with names that operators use."""
    rnd = random.Random(3)
    texts = [" ".join(some_words(rnd, rnd.randint(1, 120))) for _ in range(40)]
    texts += [None, "", " \n\t ", "a", "a b", "é ü\nñ", "x" * 3000, texts[3], texts[3], texts[4] + " more", "\n".join(texts[:3])]
    texts.append(" ".join(some_words(rnd, 30_000)))
    rows = [(i, t, "en", f"s{i % 3}" if i % 7 else None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "text of a row without id", None, "s0"), (None, None, None, None)]
    return [(*r, None, "k", 1, 2, 3, 4, 5) for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], COLUMNS)


def pytest_configure(config):
    config.addinivalue_line("markers", "slow: takes over a few seconds")
