import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, Text string, _id string, t long, i string, kept int, score string, words string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls everywhere, empty and very long texts, repeated rows, columns with clashing names."""
    long = " ".join(f"Wort{k % 977}" for k in range(60_000))
    prose = " ".join(f"the word {k} of it" for k in range(30))
    rows = [
        (0, None, "en", "a"), (1, "", None, None), (2, "word", "en", "a"), (3, long, "de", "b"), (4, " \n\t ", "en", "a"), (None, prose, "en", None),
        (None, None, None, None), (5, prose, "en", "a"), (5, prose, "en", "a"), (6, "ÄÖ " + prose, "de", "a"), (7, "12 34 !!", "fr", "a"), (8, "a b", "xx", "a"),
        (9, "same " * 200, "en", "c"), (10, "x" * 100_000, "en", "c"), (11, prose.upper(), "en", "c"),
    ]
    return spark.createDataFrame([(*r, 1, "other", "y", 2, "z", 3, "s", "w") for r in rows], DOC)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
