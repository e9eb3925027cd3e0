"""Each stage of the corpus pipeline, and the whole, against what its rule keeps."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
from searchlift.llm.common import materialise
from test_native import contaminated_by_hand
from test_text_operators import components_by_hand

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = docs.columns
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = materialise(stage(spark, docs, SF), f"test-{n}")
        after = docs.collect()
        ids = {r.doc_id for r in after}
        if n < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
        if name == "language ID":
            assert ids == {i for i, t in before.items() if any(map(str.isalpha, t))}
        elif name == "near-duplicates":
            assert ids == {i for i, (_, c) in components_by_hand(list(before.items()), 80).items() if i == c}
        elif name == "decontamination":
            hits = contaminated_by_hand(list(before.values()), bench)
            assert ids == {i for i, h in zip(before, hits, strict=True) if not h[2]}
        elif name == "mixing":
            assert ids <= set(before) and max(Counter(r.doc_id for r in after).values()) <= 3
        else:
            assert ids == set(before)
            for shard in {r.shard for r in after}:
                slots = sorted(r.slot for r in after if r.shard == shard)
                assert slots == list(range(len(slots)))


def test_pipeline_is_registered(spark):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert corpus_pipeline.run(spark, SF).count() > 0
