import pytest

from gristmill.llm.common import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, n_tokens string, kept string, spans string, rid long, h string, label int, x string, p string"
NORMAL = "the quick brown fox jumps over the lazy dog and runs away from here today"


@pytest.fixture(scope="session")
def shipped(spark):
    ship(spark)
    return spark


def rows_of(texts):
    return [(i, t, "en", "src", None, None, "clash", None, "clash", None, 7, None, None, None, None) for i, t in texts]


@pytest.fixture(scope="session")
def odd(shipped):
    """Nulls, empty, blank, one-word, very long and repeated texts, a null id, and columns with clashing names."""
    long = " ".join(f"w{i % 977}x{i % 1013}" for i in range(60_000))
    texts = [(1, None), (2, ""), (3, " \n\t"), (4, "word"), (5, long), (6, NORMAL), (6, NORMAL), (7, NORMAL), (8, "a" * 200_000), (None, NORMAL), (9, "mail bob@example.com or +49 (30) 555-1234, 4111 1111 1111 1111 at 10.0.0.1"), (10, "ünïcode 😀 " * 50)]
    return shipped.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def none(shipped):
    return shipped.createDataFrame([], SCHEMA)
