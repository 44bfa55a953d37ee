"""The mixing stage decides the slots of the last stage."""

import corpus_pipeline
from leafwork.llm import mixing
from leafwork.llm.common import cut
from leafwork.llm.queries import MIX_BLOCK, MIX_OTHER, MIX_WEIGHTS


def test_each_shard_is_read_in_mixed_order(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    position = {r["doc_id"]: r["position"] for r in mixing.mix(docs.select("doc_id", "source"), MIX_WEIGHTS, MIX_OTHER, MIX_BLOCK).collect()}
    mixed, last = (stage for _, stage in corpus_pipeline.STAGES[-2:])

    def slots(table):
        by = {}
        for r in last(spark, table, sf).collect():
            by.setdefault(r["shard"], []).append((r["slot"], position[r["doc_id"]]))
        return [sorted(x) for x in by.values()]

    got = slots(cut(mixed(spark, docs, sf)))
    assert sum(map(len, got)) == len(position)
    for rows in got:
        assert [s for s, _ in rows] == list(range(len(rows)))
        assert [p for _, p in rows] == sorted(p for _, p in rows)
    assert sorted(slots(docs)) != sorted(got)  # without the mixing stage
