import pytest

DOC = ("doc_id long, text string, lang string, source string, n_chars long, score double, "
       "kept boolean, row_key string, content string, bands string, n_words string, "
       "spans string, label string, winner string, doc string")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with further columns whose names the operators use inside.

    rows: (doc_id, text) or (doc_id, text, lang, source)
    """

    def make(*rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 len(r[1] or "")) + (0.5, None, "k", "c", "b", "n", "s", "l", "w", "d")
                for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "é" * 5), (4, "é" * 5), (None, "no id at all"),
       (5, None), (6, "word " * 30_000), (7, "x" * 400_000), (8, "one\x00two   three")]


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty, repeated and very long texts."""
    return docs(*[(*r, None, None) if i % 3 == 0 else r for i, r in enumerate(ODD)])
