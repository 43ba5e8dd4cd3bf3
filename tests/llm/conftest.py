import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word " * 30_000


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text) or (doc_id, text, lang, source) as a documents table."""

    def build(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else None, r[3] if len(r) > 3 else None, len(r[1]) if r[1] is not None else None) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return build


@pytest.fixture(scope="session")
def odd():
    """Nulls in any column, empty and very long texts, ties and repeated rows."""
    return [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (1, "alpha beta gamma delta epsilon zeta", "en", "a"), (2, None, None, None), (3, "", "en", "a"),
        (4, LONG, "en", "b"), (5, "\n \t", None, "b"), (None, "alpha beta gamma delta epsilon zeta", "de", None), (6, "ünï 😀 ▁x", "de", "a"), (7, "…", "de", None),
    ]
