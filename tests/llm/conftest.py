import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and a clashing extra column."""
    long = " ".join(f"word{k % 977} of{k}" for k in range(30_000))
    rows = [
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
        (1, "one two three four five six seven eight nine ten eleven", "en", "a", 1),
        (2, "One Two three four five six seven eight nine ten eleven", None, "b", None),
        (3, None, "en", None, 0),
        (4, "", "en", "b", 0),
        (None, "a row without identifier that has some more words to it", "en", None, None),
        (5, " \n\t ", None, "", 3),
        (6, long, "en", "a", len(long)),
        (6, "same identifier but another text", "en", "a", 5),
        (7, "é ü 😀 naïve   two  blanks\n\nlines , marks !! it's", "fr", "c", 9),
    ]
    wide = [(*r, f"extra {k}") for k, r in enumerate(rows)]
    # Named like a result column of several operators.
    return spark.createDataFrame(wide, SCHEMA + ", taken string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def tokenizer():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")
