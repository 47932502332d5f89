import pytest

SMALL = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="session")
def document_rows(documents):
    return [(row.doc_id, row.text) for row in documents.collect()]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, start=0):
        rows = [(start + number, text, "en", f"src{number % 3}", 0) for number, text in enumerate(texts)]
        return spark.createDataFrame(rows, DOCUMENTS)

    return make
