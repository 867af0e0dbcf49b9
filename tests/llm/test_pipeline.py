import pytest
from conftest import SF

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from agoraflow.llm.shared import table  # noqa: E402


def test_stages_keep_columns_and_narrow(spark):
    docs = table(spark, SF, "documents")
    first = docs
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == first.columns, name
        docs = out
        seen.append(docs.count())
    assert seen == sorted(seen, reverse=True) and 0 < seen[-1] < seen[0]


def test_stages_of_nothing(spark):
    docs = table(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0, name
