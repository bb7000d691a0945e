import pytest

ODD = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from here", "en", "a"),
    (3, None, None, None),
    (4, "", "en", "a"),
    (5, "   \n\t ", "en", "b"),
    (None, "no id at all", "en", "b"),
    (7, "word", "en", "b"),
    (7, "word", "en", "b"),
    (8, "it's 'super 's  don't\n\n x\r\n'll é ΣΑΣ İ 日本語 🙂 123 45 ½ <|endoftext|>", "de", "c"),
    (9, "lorem ipsum dolor " * 3000, "la", "c"),
    (10, "a" * 3000, "xx", "c"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, blanks, repeats, a long text, and extra columns with names that operators use."""
    rows = [(*r, 0, "x", True, 1) for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, component_id string, kept boolean, length int").repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
