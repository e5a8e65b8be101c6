"""Stages on a small fixture, each on its own input."""

import corpus_pipeline
from corvane.llm import common as C
from corvane.llm import set_join as S
from tests.llm.test_set_join import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = C.table(spark, SF, "documents")
    names, columns = [n for n, _ in corpus_pipeline.STAGES], docs.columns
    assert names == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "token-ID / binary output"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = C.spill(stage(spark, docs, SF), "stage")
        assert out.columns == columns and 0 < out.count() <= docs.count()
        if name == "n-gram Jaccard join":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert {r["doc_id"] for r in out.collect()} == {d for d, _, c in brute(rows, 5, 80, 100) if d == c}
        docs = out
    mixed = C.spill(corpus_pipeline.STAGES[3][1](spark, docs, SF), "stage")
    assert mixed.columns == columns
    last = corpus_pipeline.STAGES[4][1](spark, mixed, SF)
    assert last.count() == mixed.count()
    assert S.set_of(None, 3).size == 0
