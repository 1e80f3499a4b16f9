"""Pipeline over ``documents``; each stage applies one operator of ``hydroseries.llm``
to all rows that its predecessor kept.  No stage can be stated in SQL as a whole
(learned model, signatures, Newton steps), so ORACLE_SQL is None."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from hydroseries.llm import stages
from hydroseries.session import scratch_path

STAGES = [
    ("quality", stages.good_quality),
    ("neardup", stages.one_of_each),
    ("decontaminate", stages.decontaminate),
    ("secrets", stages.redact_secrets),
    ("mix", stages.mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
