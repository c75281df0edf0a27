"""Processing status events (O120) and display rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import PROCESSING_STAGES, SOURCE_LABELS, lookup
from clauselake.functions.display import DASH, decimal_br
from clauselake.functions.text import snippet


def current_status(events: DataFrame) -> DataFrame:
    """O120: latest published status per document ``(document_id, seq, stage, progress, message)``.

    The same query serves batch and streaming; its state is one row per document.
    """
    return (
        events.groupBy("document_id")
        .agg(F.max_by(F.struct("seq", "stage", "progress", "message"), "seq").alias("s"))
        .select("document_id", "s.*")
    )


def invalid_status(events: DataFrame) -> DataFrame:
    """Events outside the contract: unknown stage or progress outside [0, 1]."""
    valid = F.col("stage").isin(*PROCESSING_STAGES) & F.col("progress").between(0, 1)
    return events.filter(~F.coalesce(valid, F.lit(False)))


def evidence_rows(evidence: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Evidence for a reader: label, page, section, one-line excerpt, score and source."""
    if labels is None:
        labelled = evidence.withColumn("__label", F.col("policy_id"))
    else:
        labelled = evidence.join(labels.select("policy_id", F.col("label").alias("__label")), "policy_id", "left")
    score = F.col("retrieval_score").cast("decimal(20,10)")
    section = F.coalesce("section_name", F.lit(""))
    return labelled.select(
        "evidence_id",
        F.coalesce("__label", "policy_id").alias("apólice"),
        F.col("page_number").cast("string").alias("página"),
        F.when(section == "", F.lit(DASH)).otherwise(section).alias("seção"),
        snippet(F.col("quoted_text")).alias("trecho"),
        F.coalesce(decimal_br(score, 2), F.lit(DASH)).alias("similaridade"),
        lookup(F.col("source_type"), SOURCE_LABELS).alias("origem"),
    )
