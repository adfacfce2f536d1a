"""The corpus pipeline: quality rules, near-dedup, decontamination, mixing, sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm.common import Scratch, table
from fieldloom.llm.decontaminate import drop_contaminated
from fieldloom.llm.mixing import mix_documents
from fieldloom.llm.quality_rules import filter_quality
from fieldloom.llm.sharding import shard_documents
from fieldloom.llm.simhash import drop_near_duplicates


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules accept."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as it is or with other slot values."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mix_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, texts included, with its shard: to be written with ``partitionBy("shard_id")``."""
    return shard_documents(docs, whole=True)


STAGES = [("quality rules", quality), ("near-dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
#: The near-dedup and mixing stages iterate or draw seeded coins, which SQL can't express; tests/llm holds run() against brute force, stage by stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table, each written and reread.

    Null and empty texts, and whatever the rules reject, go in the first stage; null ids, ties, repeated rows and
    very long texts pass as the operators say; other columns of ``documents`` come through, whatever their names (the last
    stage puts underscores after an added name that is taken); an empty table gives an empty result.
    """
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        open_before = len(Scratch.live)
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.save(docs, f"stage{i}")
            Scratch.close_since(open_before)
            if i:
                scratch.drop(f"stage{i - 1}")
    return docs
