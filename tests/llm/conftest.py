import pytest


@pytest.fixture
def documents(spark):
    """documents([(id, text), ..]) with columns that operators use inside, under clashing names."""
    def build(rows, sources=None):
        data = [(i, t, "en", sources[k] if sources else "s", None, 7, "x", k, None, 0.5) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, key string, "
                                           "point int, digest string, score double")

    return build


#: Null id and text, empty and blank texts, repeated rows, one id with two texts, a long text.
MESSY = [(None, "a b c d e f"), (None, None), (1, None), (2, ""), (3, " \t\n"), (4, "a b c d e f"), (4, "a b c d e f"), (5, "A B c d e f"),
         (6, "x"), (6, "other words here"), (7, "w0 w1 " * 20000), (8, "é ß 日本 😀 e"), (9, "  nbsp word")]


@pytest.fixture
def messy(documents):
    return documents(MESSY)
