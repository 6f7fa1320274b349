"""A corpus pipeline of five stages, each one of the operators in ``framesift.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and
read again as the next one's docs. All but the last return the columns of docs.

Nulls in any column, empty and very long texts, repeated rows and empty tables
have the results that the operators define; extra columns pass through to the
end, whatever they are called (but for those that the last stage adds, size,
text_crc32, law, shard, slot and grown_shard, which are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framesift.llm import decontamination, mixing, ngram_join, sharding, toxicity
from framesift.llm.common import boxed, cut, drop_cut, free_name, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects (score of 0.5 or more) go."""
    model = toxicity.learn(spark, docs, sf_dir)
    score = free_name(docs, "toxicity")
    return toxicity.score_documents(docs, model, score=score).filter(F.col(score) < 0.5).drop(score)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return ngram_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: never, once or twice."""
    rows = boxed(docs, doc_id=F.col("doc_id"), source=F.col("source"), text=F.col("text"))
    mixed = mixing.mix(rows).filter("repeats > 0")
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("repeats")))).select("row.*")


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows, whole, with shard and slot."""
    return sharding.shard_rows(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: Two of the stages are classifiers and fingerprints, which SQL can't express; tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over the whole of ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_cut(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
