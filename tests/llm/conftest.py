from __future__ import annotations

import pytest

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def corpus(spark):
    """(doc_id, text) of the small test table, for brute force."""
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture
def docs(spark):
    """A documents table from (doc_id, text) pairs."""
    def make(rows, schema=DOCS):
        return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], schema)
    return make
