import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, size long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from (doc_id, text) or (doc_id, text, source), with extra columns whose names clash with results."""

    def make(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 0.5, 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, repeated rows, ties."""
    return docs_of([(1, None), (2, ""), (None, "alone here"), (3, "word " * 30000), (4, "same text of five words"), (4, "same text of five words"), (5, "same text of five words"), (6, "\n\n \t"), (7, "é ß 漢字 𝒳")])
