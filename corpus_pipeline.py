"""The corpus pipeline: documents in, a cleaned and mixed training corpus out.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before kept. All but the last return the
columns of ``documents``; the last adds how often and how many words the mix takes of each document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import decontaminate, mixing, near_dedup, quality, sanitize
from clauselake.llm.common import stage_folder
from clauselake.session import ship_package


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is at most the threshold of their language."""
    ship_package(spark)
    return quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))[1]


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    ship_package(spark)
    return near_dedup.keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without contamination by the benchmark."""
    ship_package(spark)
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced; ``n_chars`` follows the text."""
    ship_package(spark)
    clean = sanitize.sanitize(docs)
    return clean.withColumn("n_chars", F.coalesce(F.char_length("text").cast("long"), F.col("n_chars"))).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with ``times`` and ``taken`` words."""
    ship_package(spark)
    return mixing.mixed_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = stage_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs


ORACLE_SQL = None  # models, draws and alignments are no SQL; tests/llm compares with brute force
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
