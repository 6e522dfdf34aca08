"""The corpus pipeline: quality, near copies, repeated passages, benchmark passages, mixing.

Each stage is one operator of recordloom.llm applied to all documents that the stage before has left. All but the last
return the columns of `documents`; the last adds `copy`, and has a document as many times as the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordloom.llm import decontam, mixing, near_copies, quality, suffix_dedup
from recordloom.llm.common import release, remove, shared_folder, table

#: Documents scored below this go.
LEAST_QUALITY = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field takes for bad go; it learns from the labels of the documents at hand.

    Null and empty texts are scored like others. Repeated rows stay or go together. Without labels of both kinds all stay.
    """
    return quality.good_documents(docs, table(spark, sf_dir, "labels"), LEAST_QUALITY)


def near_copies_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a 5-word-shingle similarity of 0.8 or more connect, that of the smallest doc_id stays.

    Ties of an id go to the smaller hash of the text, null ids come last; of repeated rows one stays; null, empty and blank texts
    are copies of each other.
    """
    release(spark)  # what the stage before has left
    return near_copies.keep_one(docs)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that appear earlier, by (doc_id, place), are cut out of the text, in whole characters.

    A document of which nothing is left goes; null and empty texts stay as they are.
    """
    release(spark)  # what the stage before has left
    return suffix_dedup.without_repeats(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of ten words of any benchmark item are cut out of the text; a document without another word goes.

    Null and empty texts stay as they are; without items nothing changes.
    """
    release(spark)  # what the stage before has left
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them, numbered by `copy`; a null source is one like others, and documents without words stay once."""
    release(spark)  # what the stage before has left
    return mixing.mixed_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("near-copy dedup", near_copies_stage),
    ("suffix-array dedup", repeats_stage),
    ("benchmark decontamination", benchmark_stage),
    ("mixing sources to target weights", mixing_stage),
]

#: SQL cannot express the stages: the first two learn and link; tests compare them with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written to the shared folder and read again, and deleted once the next is written.

    Columns beyond those of `documents` go through all stages. An empty table gives no rows.
    """
    folder = shared_folder(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs
