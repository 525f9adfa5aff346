import pytest

from storelens.llm.common import Workspace

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def ws(spark):
    with Workspace(spark) as own:
        yield own


@pytest.fixture
def documents(spark):
    def make(texts, **columns):
        """doc_id counts from 0; other columns are constants or lists."""
        n = len(texts)
        of = lambda name, default: columns.get(name, [default] * n)
        rows = list(zip(of("doc_id", None) if "doc_id" in columns else range(n), texts, of("lang", "en"), of("source", "a"), [len(t or "") for t in texts], strict=True))
        return spark.createDataFrame(rows, DOCS)

    return make
