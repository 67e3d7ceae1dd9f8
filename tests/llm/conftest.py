import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, block string, token string, cls long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text[, lang, source]) with extra columns whose names clash with what operators use."""

    def make(rows):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, "en", "s")[:4] if len(r) < 4 else r
            full.append((doc_id, text, lang, source, None if text is None else len(text), 1, "x", "y", 2))
        return spark.createDataFrame(full, SCHEMA)

    return make


#: Null and empty texts, ties, repeated rows, null ids.
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (5, "two words"), (None, "null id here"), (None, None), (6, "a\x1cb c d"), (7, "x" * 5000), (8, "Ab aB AB ab " * 200)]


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    return make_docs(ODD)
