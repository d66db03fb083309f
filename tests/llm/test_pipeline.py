"""The pipeline, stage by stage, against brute force on each stage's own input."""

import corpus_pipeline
from loam.llm import toxicity
from loam.llm.common import table, written

from tests.llm.test_native_operators import window_brute
from tests.llm.test_numpy_operators import near_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        seen.append({r.doc_id: r.text for r in docs.collect()})
        after = written(stage(spark, docs, SF))
        assert after.columns == docs.columns and after.count() == after.select("doc_id").distinct().count()
        docs = after
    seen.append({r.doc_id: r.text for r in docs.collect()})
    scores = {r.doc_id: r.score for r in toxicity.score_toxicity(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert set(seen[1]) == {d for d in seen[0] if scores[d] < 0.5}
    last = {}
    for d in sorted(seen[1]):
        last[seen[1][d]] = d
    assert set(seen[2]) == set(last.values())
    assert set(seen[3]) == {d for d, (_, _, kept) in near_brute(list(seen[2].items())).items() if kept}
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert set(seen[4]) == {d for d, (_, hit, _) in window_brute(list(seen[3].items()), bench).items() if not hit}
    pieces = corpus_pipeline.packing(spark, docs, SF).collect()
    assert {p.doc_id for p in pieces} == set(seen[4])
    for d in seen[4]:
        own = sorted((p for p in pieces if p.doc_id == d), key=lambda p: p.start)
        assert sum(p.length for p in own) == own[0].doc_tokens


def test_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            after = written(stage(spark, docs, SF))
            assert after.columns == docs.columns
            docs = after
    assert corpus_pipeline.packing(spark, empty, SF).count() == 0
