import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def frame(spark):
    """documents from (doc_id, text) rows, with the other columns filled in, dealt to several partitions."""
    def make(rows, lang="en"):
        full = [(d, t, lang, "s", len(t) if t is not None else None) for d, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
