"""The pipeline's stages: each on what its predecessor kept."""

import corpus_pipeline
from framesift.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    n, kept = docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == docs.columns and out.select("doc_id").exceptAll(docs.select("doc_id")).count() == 0 or name == "mixing"
        kept[name], docs = out.count(), out
    assert n > kept["toxicity"] > kept["near_duplicates"] >= kept["decontamination"] > 0
    final = corpus_pipeline.run(spark, SF)
    assert final.count() == kept["mixing"] and {"doc_id", "shard", "slot"} <= set(final.columns)


def test_empty(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
