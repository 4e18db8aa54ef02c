import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, row int, key string, size int, score string, kept string"

WORDS = "the of and to in a is that for it river stone cloud amber mesa lilac orbit pixel quartz raven".split()


def sentence(seed: int, n: int) -> str:
    return " ".join(WORDS[(seed * 7 + i * i * 3 + i) % len(WORDS)] + str((seed + i) % 3 or "") for i in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing extra columns."""
    rest = ("x", 1, "k", 2, "s", "t")
    long = sentence(3, 9000)
    rows = [
        (1, "same text here", "en", "a", 14),
        (2, "same  text\there", "en", "a", 14),
        (3, "same text here", None, None, None),
        (4, None, "fr", "b", None),
        (5, "", "fr", "b", 0),
        (6, "   ", None, "b", 3),
        (7, long, "en", "a", len(long)),
        (8, long, "en", "c", len(long)),
        (9, long + " end", "en", "c", len(long)),
        (9, long + " end", "en", "c", len(long)),
        (None, "row without an id", "en", None, 4),
        (None, None, None, None, None),
        (10, "\x1c odd \x85 separators 　 é İ ΣΑΣ 日本", "xx", "", 3),
        (11, "1234 !!! 5678", "en", "a", 3),
    ]
    return [r + rest for r in rows]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
