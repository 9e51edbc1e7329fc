"""The corpus pipeline: each stage is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillstream.llm import toxicity as toxic
from tillstream.llm.common import table
from tillstream.llm.decontamination import drop_contaminated
from tillstream.llm.exact_dedup import drop_exact_duplicates
from tillstream.llm.queries import digests_of_tokens, word_vocabulary
from tillstream.llm.simhash import drop_near_duplicates
from tillstream.session import free, new_folder, scratch_freed

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxic.drop_toxic(docs, toxic.trained(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_duplicates(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return digests_of_tokens(docs, word_vocabulary())


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encoding", bpe_encoding),
]

# The first stage is a trained model, which SQL cannot state; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of the documents that all stages keep.

    Null, empty and very long texts, null ids, rows repeated in full and extra columns of any name are
    handled as each stage states: such rows go only as toxic, copies or contaminated ones. Of rows
    repeated in full one stays. A stage that keeps nothing hands on an empty table, and the result is
    empty. A stage's folder goes once the next stage has stored its own.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_folder(spark, f"stage-{name}")
        with scratch_freed(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            free(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
