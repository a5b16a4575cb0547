import pytest
from llm_fixtures import messy_texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def messy(spark):
    rows = [(i, t, ("en", "fr", None)[n % 3], "s", len(t or "")) for n, (i, t) in enumerate(messy_texts())]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
