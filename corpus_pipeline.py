"""A corpus from documents to a training mix: each stage's result is written and read again as the next one's input."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm import decontaminate, line_dedup, mixing, near_dup, quality
from skyfold.llm.session import remove, shared_dir


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.quality_filter(docs)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their text without lines that match an earlier one; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return near_dup.drop_near_duplicates(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each repetition of a document, with its source's target."""
    return mixing.mixture(mixing.mix_sources(docs))


STAGES = [
    ("quality", keep_good),
    ("lines", drop_lines),
    ("near_duplicates", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix),
]

#: The label model's fit and the MinHash groups have no SQL form; tests/llm has the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``.

    Each result is written to a folder of its own in the shared one; a stage's input goes
    once its result is written, and the last input with the session.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{home}/{k}-{name}")
        remove(spark, f"{home}/{k}-{name}", at_exit=True)
        if k:
            remove(spark, f"{home}/{k - 1}-{STAGES[k - 1][0]}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
    return docs
