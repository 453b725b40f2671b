"""From raw documents to packed training windows: five stages, each written and read again by whoever runs them.

Quality rules drop what they reject, the Jaccard join leaves one document of each near-duplicate class, decontamination
drops documents that contain a benchmark item, personal data is masked in the texts, and packing returns the pieces of
all documents that stayed with their places in the windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandsort.llm import decontamination, jaccard_join, packing, pii, quality_rules
from strandsort.llm.common import table, written_table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitised_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs, packing.default_plan())


STAGES = [
    ("quality_rules", quality),
    ("jaccard_join", near_duplicates),
    ("decontamination", decontaminate),
    ("pii", personal_data),
    ("packing", pack),
]

#: Walks, signatures and token ids can't be put in SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
