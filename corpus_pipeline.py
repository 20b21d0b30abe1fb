"""The corpus pipeline: quality, near-duplicates, decontamination, PII, packing.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept. `run`
writes every stage as Parquet in the shared folder and reads it again.

Defined results: a null or empty text scores the classifier's bias, is linked with
nothing, holds no benchmark passage and no personal data, and is packed as its end token
if the classifier keeps it; a null doc_id is kept by near-dedup; of rows that repeat a
doc_id all stay where that id does; of a group of near-duplicates the smallest doc_id
stays; a score of just the cut is kept; empty tables give no rows (an empty labels table
scores all 0.5 and rejects all); other columns are handed on until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratalake.llm import decontam, neardup, packing, pii, quality
from stratalake.llm.common import cut, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality.reject(docs, table(spark, sf_dir, "labels"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, from a similarity of 0.8 on."""
    return neardup.dedup(docs, threshold=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates in place of personal data."""
    return pii.rewrite(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences, with their token ids."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("near-dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs


#: Packing by tokenizer ids, learned scores and keyed surrogates have no SQL form.
ORACLE_SQL = None
