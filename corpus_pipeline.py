"""A corpus pipeline of five stages: quality rules, near duplicates, benchmark decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracelake.llm.decontaminate import decontaminate
from tracelake.llm.jaccard_join import keep_first
from tracelake.llm.mixing import apply_mix
from tracelake.llm.quality_rules import keep_good
from tracelake.llm.scratch import release, tidy
from tracelake.llm.shards import pack_shards


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules, of hosts that pass theirs. Null, empty and short texts go; null sources are one host; equal rows have one verdict; no rows give none."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id; of rows that are the same in id and text, one. Rows without an id or words stay."""
    return keep_first(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark. Null and empty texts stay; equal rows have one verdict; an empty benchmark removes nothing; no rows give none."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with words in its source at least about once, small sources up to twice as often as the largest. Null sources are one source; equal rows are taken equally often; no rows give none."""
    return apply_mix(docs, max_epochs=2.0)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of each row, repeated ones too. Null texts have the size of none; ties go by id and text; no rows give none."""
    return pack_shards(docs, shards=24)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("source mixing", mixing), ("sharding", sharding)]

#: The near-duplicate components, the mixing exponent and the packing have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for _, stage in STAGES:
        docs = tidy(stage)(spark, docs, sf_dir)  # kept, and what the stage kept on its way is deleted
        if last is not None:
            release(last)
        last = docs
    return docs
