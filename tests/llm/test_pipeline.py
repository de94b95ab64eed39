"""The pipeline's stages against the operators' own per-row results."""

from collections import Counter

import corpus_pipeline
from tidemark.llm import near_dedup, pieces, pii, quality_rules
from tidemark.llm.common import spill

from tests.llm.conftest import SF, edge_docs


def test_stages_in_order(spark, small, labels):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii", "mixing", "sentencepiece"]
    step = dict(corpus_pipeline.STAGES)
    good = spill(step["quality_rules"](spark, small, SF), "t")
    kept = {r.doc_id for r in quality_rules.quality_rules(small, labels).collect() if r.kept}
    assert good.columns == small.columns and {r.doc_id for r in good.collect()} == kept
    single = spill(step["near_dedup"](spark, good, SF), "t")
    classes = near_dedup.near_classes(good).collect()
    assert {r.doc_id for r in single.collect()} == {r.class_id for r in classes} and single.columns == small.columns
    clean = spill(step["pii"](spark, single, SF), "t")
    assert clean.columns == small.columns and clean.count() == single.count()
    before = {r.doc_id: r.text for r in single.collect()}
    for r in clean.collect():
        assert not pii.base_spans(r.text) and (r.text == before[r.doc_id]) == (not pii.base_spans(before[r.doc_id]))
        assert r.n_chars == len(r.text)
    mixed = spill(step["mixing"](spark, clean, SF), "t")
    assert mixed.columns == small.columns and max(Counter(r.doc_id for r in mixed.collect()).values()) <= 2
    out = step["sentencepiece"](spark, mixed, SF)
    v = pieces.load_vocabulary()
    want = sorted((r.doc_id, r.text) for r in mixed.collect())
    assert sorted((r.doc_id, pieces.decode(v, r.ids)) for r in out.collect()) == want


def test_run_equals_the_stages(spark, small):
    rows = corpus_pipeline.run(spark, SF).collect()
    docs = small
    for _, stage in corpus_pipeline.STAGES:
        docs = spill(stage(spark, docs, SF), "t")
    assert sorted((r.doc_id, r.n_pieces) for r in rows) == sorted((r.doc_id, r.n_pieces) for r in docs.collect())


def test_edges(spark):
    for docs in (edge_docs(spark), edge_docs(spark, [])):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns
            out.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
