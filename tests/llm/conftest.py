import pytest

EDGE = "doc_id long, text string, keep_id string, kept int, fingerprint string, score string, n_tokens string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and blank texts, ties, repeated rows, a long text, and columns named as results are."""
    texts = [(1, "the cat sat on the mat"), (2, "the cat sat on the mat"), (2, "the cat sat on the mat"), (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, "long text with words " * 5000), (8, "ä€😀 \x00 ▁"), (None, "no id"), (9, "The cat sat on the mat")]
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", "w", None, None, None) for i, t in texts], EDGE)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
