"""The corpus pipeline: five stages over documents, each a decision of one operator that the next one builds on.

Every function takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as Parquet to the
shared folder and reads it again as the next one's docs. All but the last return the columns of documents. Tables that a
stage writes on its way are deleted behind it.

Cases, stage by stage. Null and empty texts fail the quality rules, so later stages meet them only if run alone: they are
then linked with nothing, hold no benchmark words, are never taken by the mix, and weigh nothing in a shard. Null ids: each
row is judged by its own text; where rows are alike, those without an id count as the smallest. Repeated rows: both are
judged alike by quality rules, one stays after near duplicates. Ties: of equal ids in a group the row of the least text hash
stays; equal ids share the mix's hash and a shard. Null sources and languages are ones of their own. Texts of any length are
judged whole. Empty tables pass through all stages. Extra columns, whatever their names, travel in a struct through every
stage; only ``shard`` is replaced by the last one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexforge.llm import decontaminate, mix, ngram_jaccard, oracle, quality, sharding
from lexforge.llm.common import scratch, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.passed(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one of the smallest id stays, whatever
    ids are null or repeated."""
    return ngram_jaccard.representatives(docs, width=5, percent=80, by_id=False)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which at least 5 % of the words stand in windows of benchmark items go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mix.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard."""
    return sharding.sharded(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("sharding", shards),
]

ORACLE_SQL = oracle.pipeline()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
    return docs
