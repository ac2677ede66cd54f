"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumetry.llm import common, decontamination, mixing, quality_crf, sharding, simhash

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line model accepts. It is learned from labelled documents of the table itself.

    Null and empty texts are one empty line and are judged like any other; rows without id are judged but never
    learned from; repeated rows go or stay together. Without labels everything stays; an empty table stays empty.
    """
    chain = quality_crf.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_crf.accepted(docs, chain)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the least id.

    Texts without words (null and empty ones too) are one group. Null ids come last; of rows that share the
    least id, the one whose text's digest is least stays, and of repeated rows one. An empty table stays empty.
    """
    return simhash.one_of_each(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item.

    Texts and items of fewer than five words (null and empty ones too) hold nothing. Rows without id count by
    their text; repeated rows go or stay together. An empty table or benchmark changes nothing.
    """
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of each document as the mix takes; those that it doesn't take go.

    Texts without words (null and empty ones too) take nothing and go. Null is a source of its own; rows that
    share an id, null too, are taken as often as the most taken of them. An empty table stays empty.
    """
    return mixing.sampled(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their virtual slot and shard (under longer names where documents have such columns).

    Null text counts as empty, null ids as any others; repeated rows share a slot. An empty table stays empty.
    """
    out, _, _ = sharding.assign(docs, SHARDS)
    slot, shard = out.columns[-2:]
    return out.withColumnsRenamed({slot: common.unused_name(docs, "slot"), shard: common.unused_name(docs, "shard")})


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("mix", mix), ("shards", shards)]

#: A learned model decides the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, from its written table. What earlier stages wrote is deleted as soon as the next one is done."""
    docs, before = common.documents(spark, sf_dir), []
    for name, stage in STAGES:
        with common.noted() as made:
            out = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        common.removed(spark, [*before, *(p for p in made if p != out.written_to)])
        docs, before = out, [out.written_to]
    return docs
