import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, row string, size long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents of (doc_id, text[, lang, source]), with extra columns whose names clash with operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", None if r[1] is None else len(r[1]), "x", "clash", 7) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


EDGES = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one"), (5, "one"), (None, "no id here at all"), (6, "Ünï çødé ✓ 😀 " * 40), (7, "word " * 30_000)]
