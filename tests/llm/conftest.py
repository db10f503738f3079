import pytest

TOP = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """A table of documents from texts, or of (doc_id, text, source) tuples."""

    def make(rows, more: str = "", values=()):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, source = r if isinstance(r, tuple) else (i, r, f"s{i % 3}")
            full.append((doc_id, text, "en", source, None if text is None else len(text), *values))
        return spark.createDataFrame(full, TOP + more)

    return make


@pytest.fixture
def odd(documents):
    """Nulls, empty and long texts, repeated rows, and clashing columns."""
    long = "word " * 3000 + "end"
    rows = [(0, None, "a"), (1, "", None), (2, "  \n\t", "a"), (None, "some words here to read", "b"), (3, long, "a"), (3, long, "a"), (4, "é ü\n" * 40, None), (None, None, None)]
    return documents(rows, ", _rid long, size long, n long, _row string, _words string, copies long", (7, 7, 7, "x", "y", 7))


@pytest.fixture
def none(documents):
    return documents([])
