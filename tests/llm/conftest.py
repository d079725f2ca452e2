import pytest

LONG = " ".join(f"word{i % 977} and{i % 31}" for i in range(12_000))


@pytest.fixture(scope="session")
def corpus(spark):
    """A maker of document tables with clashing extra columns."""
    def make(texts, ids=None, langs=None):
        ids = range(len(texts)) if ids is None else ids
        langs = ["xx"] * len(texts) if langs is None else langs
        rows = [(i, t, lang, "s", 7, "k", 1, "h") for i, t, lang in zip(ids, texts, langs, strict=True)]
        return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n bigint, key string, id int, doc string")
    return make


@pytest.fixture(scope="session")
def long_text():
    return LONG
