import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, rep string, v string, n long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text), with further columns whose names the operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y", "z", 7) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r["doc_id"]: r["text"] or "" for r in documents.select("doc_id", "text").collect()}


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")
