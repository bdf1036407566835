import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """``docs([(id, text), ...])`` as a table of documents."""

    def make(rows, extra=""):
        full = [(i, t, "en", "s", None if t is None else len(t), *more) for i, t, *more in rows]
        return spark.createDataFrame(full, DOCS + extra)

    return make
