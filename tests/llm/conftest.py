import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, component string, u string, run string, fp string"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents, with extra columns whose names operators use themselves, from texts or (doc_id, text) pairs."""

    def make(texts, source="s"):
        pairs = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(texts)]
        rows = [(i, t, "en", source if isinstance(source, str) else source[k], None, "d", "c", "u", "r", "f") for k, (i, t) in enumerate(pairs)]
        return spark.createDataFrame(rows, DOCS)

    return make
