"""Stages of the pipeline: each on what its predecessor kept."""

from collections import Counter

import corpus_pipeline
from phasegrid.llm.common import stored, table
from tests.llm.test_operators import WORD, brute_components, brute_spans

SF = "/root/testdata/sf0.001"


def test_stages_in_turn(spark):
    docs = table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(stored(stage(spark, kept[-1], SF), name.replace(" ", "-")))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept[-1].columns == columns
    good, one, hidden, mixed, packed = ([tuple(r) for r in k.select("doc_id", "text").collect()] if "text" in k.columns else k.collect() for k in kept[1:])
    labels = {r.doc_id: r.quality for r in table(spark, SF, "labels").collect()}
    assert not {i for i, q in labels.items() if q == 1} - {i for i, _ in good}
    groups = brute_components(good)
    assert {i for i, _ in one} == {c if n else i for i, n, c in groups} and len(one) == len({i for i, _ in one})
    assert all(not brute_spans(t) for _, t in hidden) and {i for i, _ in hidden} == {i for i, _ in one}
    assert set(mixed) <= set(hidden) and max(Counter(mixed).values()) <= 3
    assert {r.doc_id for r in packed} == {i for i, _ in mixed}
    assert sum(len(WORD.findall(t)) for _, t in mixed) > 0


def test_empty_corpus(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
