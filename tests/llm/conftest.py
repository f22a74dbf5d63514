import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, u bigint, v bigint, id bigint"


@pytest.fixture
def docs(spark):
    """Documents of given texts, with columns whose names operators use inside."""

    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = ["en"] * len(texts) if langs is None else langs
        rows = [(i, t, l, "s", 0, "k", 1, 2, 3) for i, t, l in zip(ids, texts, langs)]
        return spark.createDataFrame(rows, DOCS)

    return make
