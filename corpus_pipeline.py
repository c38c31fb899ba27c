"""The corpus pipeline: language ID, near-dedup, substring dedup, decontamination, mixing."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from devpulse.llm import decontamination, language_id, mixing, near_dedup, substring_dedup
from devpulse.llm.columns import set_aside
from devpulse.plans.files import staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: how far the shares of each dimension are evened out: sources fully, languages and topics in part
MIX = {"source": 0.0, "lang": 0.7, "_topic": 0.7}


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language."""
    return language_id.drop_unknown(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_duplicates(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus."""
    return substring_dedup.remove_repeated(docs)


def without_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def sampled_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents in the wanted mix, with the weight and the chance of each."""

    def mixed(docs: DataFrame) -> DataFrame:
        told = docs.withColumns({"_topic": mixing.topic(), "_n_tokens": mixing.n_tokens()})
        return mixing.mixed(told, MIX, tokens="_n_tokens").where("sampled").drop("_topic", "_n_tokens", "sampled")

    return set_aside(docs, ("_topic", "_n_tokens", "sampled"), mixed)


#: documents that go to Python at a time; a few MB of text, so that executors with little memory can hold what is made of it
BATCH_ROWS = 500


def _in_small_batches(stage: Stage) -> Stage:
    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark._jvm.System.gc()  # the driver lets go of the plans, broadcasts and shuffles of the stage before
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("language_id", _in_small_batches(known_language)),
    ("near_dedup", _in_small_batches(one_of_each_group)),
    ("substring_dedup", _in_small_batches(without_repeated_passages)),
    ("decontamination", _in_small_batches(without_test_items)),
    ("mixing", _in_small_batches(sampled_mix)),
]
#: decisions hang on learned profiles and hashed draws
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = staged(stage(spark, docs, sf_dir), name)
    return docs
