"""A training-data pipeline over ``documents``: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of ``documents``, in their order and under any names. Null and empty texts end at the first stage, as no language is
found in them. Null doc_ids are kept like others. An empty table passes every stage as an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import common, decontaminate, jaccard_join, language, packing, pii


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model rejects go; each row is judged by its text alone, so equal rows fare alike."""
    return language.identified(docs, language.fitted(docs), reject=True).where("lang_pred <> 'und'").select(docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id (a null id comes last), and of its
    repeated rows one; texts that link with nothing stay, whatever their doc_ids."""
    return jaccard_join.deduplicated(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a test item go, all their rows; without test items all stay."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is masked and n_chars counted anew; all rows stay, equal texts are masked alike."""
    return pii.redacted(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences; rows are pieces of documents, each row's ids once, repeated rows each on their own."""
    return packing.packed(docs, "byte_bpe_50k.json")


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("personal_data", personal_data_stage),
    ("packing", packing_stage),
]
#: The stages' methods can't be expressed in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/strandwise-stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
