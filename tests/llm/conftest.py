import pytest


@pytest.fixture()
def docs(spark):
    """A documents table from texts (ids count from 0), with columns whose names clash with those inside the operators."""

    def make(texts, ids=None):
        ids = list(range(len(texts))) if ids is None else ids
        rows = [(i, t, "en", "src0", len(t or ""), 7, "x", "y", False, 2, "p", 0.5, "z", None, 9) for i, t in zip(ids, texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, rid int, kind string, id string, kept boolean, cuts int, print string, score double, c0 string, c1 long, __n_words int")

    return make
