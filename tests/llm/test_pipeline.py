import corpus_pipeline
import pytest
from flowlens.llm import catalog, line_dedup

from conftest import SMALL


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage at sf0.001, by name."""
    base, out = tmp_path_factory.mktemp("stages"), {}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SMALL).write.parquet(f"{base}/{name}")
        docs = out[name] = spark.read.parquet(f"{base}/{name}")
    return out


def test_columns(stages):
    assert all(stages[n].columns == corpus_pipeline.COLUMNS for n in list(stages)[:-1])


def test_lines_only_shorten_texts(stages):
    before = {r.doc_id: r.text for r in stages["toxicity"].collect()}
    after = {r.doc_id: r.text for r in stages["line dedup"].collect()}
    assert before.keys() == after.keys()
    want = {r.doc_id: r.text for r in line_dedup.dedup_lines(stages["toxicity"]).collect()}
    assert after == want


def test_no_two_similar_documents_are_left(stages):
    from test_operators import _brute_groups

    rows = [(r.doc_id, r.text) for r in stages["line dedup"].collect()]
    keep = {d for d, _, first in _brute_groups(rows) if d == first}
    assert {r.doc_id for r in stages["n-gram jaccard join"].collect()} == keep


def test_all_that_is_mixed_is_packed(stages):
    mixed, packed = stages["mixing"], stages["packing"]
    assert packed.where("piece = 0").count() == mixed.count()
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0


def test_registered():
    import __spark_entry__

    assert set(catalog.QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
