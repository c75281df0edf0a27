"""Evaluation against a reference set (O112-O117)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import field_attribute
from clauselake.functions.text import strip
from clauselake.functions.values import normalize_value, parse_value


def match_scalar(expected: Column, extracted: Column) -> Column:
    """O112 on text scalars: the expected text is a literal part of the extracted one; null never matches."""
    return F.coalesce(F.contains(extracted, strip(expected)), F.lit(False))


def match_number(expected: Column, extracted: Column) -> Column:
    """O112 on numbers and booleans: equality; null never matches."""
    return F.coalesce(expected == extracted, F.lit(False))


def match_value(field_type: Column, expected: Column, extracted: Column) -> Column:
    """O112 on normalised structs: equality of the typed keys."""
    same = (
        F.when(
            field_type == "money",
            (expected["amount"] == extracted["amount"]) & (expected["currency"] == extracted["currency"]),
        )
        .when(field_type == "number", expected["number"] == extracted["number"])
        .when(field_type == "date", expected["date"] == extracted["date"])
        .when(field_type == "period", (expected["start"] == extracted["start"]) & (expected["end"] == extracted["end"]))
        .otherwise(expected["text"] == extracted["text"])
    )
    return F.coalesce(same, F.lit(False))


def evidence_matches(quote: Column, texts: Column) -> Column:
    """O113: no expected quote, or the quote is a literal part of one cited text."""
    no_quote = F.coalesce(quote, F.lit("")) == ""
    return no_quote | F.coalesce(F.exists(texts, lambda text: F.contains(text, strip(quote))), F.lit(False))


def classify_entry(expected_status: Column, extracted_status: Column, matches: Column) -> tuple[Column, Column]:
    """O114: (result, detail) of one expected field."""
    ladder = [
        (extracted_status.isNull(), "nao_avaliado", "campo não avaliado"),
        ((extracted_status == "NOT_FOUND") & (expected_status == "NOT_FOUND"), "correto", None),
        (extracted_status == "NOT_FOUND", "ausente", "campo não encontrado na apólice"),
        (
            extracted_status.isin("AMBIGUOUS", "NEEDS_REVIEW"),
            "inconclusivo",
            "extração sinalizada para revisão humana (EC-03)",
        ),
        (expected_status == "NOT_FOUND", "divergente", "campo extraído mas não esperado na referência"),
        (matches, "correto", None),
        (F.lit(True), "divergente", "valor divergente do esperado"),
    ]
    result = detail = None
    for condition, name, text in ladder:
        result = (F if result is None else result).when(condition, F.lit(name))
        detail = (F if detail is None else detail).when(condition, F.lit(text).cast("string"))
    return result, detail


def evaluate(expected: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """O115: one entry per expected field.

    ``expected(case_id, policy_id, field_code, status, expected_value,
    evidence_quote)`` with the value as JSON; ``facts`` with normalised values.
    The quote is checked inside the join with the cited evidence: what is
    aggregated per entry is a boolean.
    """
    code = F.col("field_code")
    expected = expected.withColumn("field_type", field_attribute(code, "field_type"))
    expected = expected.withColumn(
        "expected_normalized",
        normalize_value(F.col("field_type"), parse_value(F.col("field_type"), F.col("expected_value"))),
    )
    found = facts.select(
        "policy_id", "field_code", F.col("status").alias("extracted_status"),
        F.col("normalized_value").alias("extracted_normalized"), "evidence_ids",
    )
    joined = expected.join(found, ["policy_id", "field_code"], "left")
    matches = match_value(F.col("field_type"), F.col("expected_normalized"), F.col("extracted_normalized"))
    result, detail = classify_entry(F.col("status"), F.col("extracted_status"), matches)
    entries = joined.select(
        "case_id", "policy_id", "field_code", F.col("status").alias("expected_status"), "extracted_status",
        "expected_normalized", "extracted_normalized", result.alias("result"), detail.alias("detail"),
        "evidence_quote", F.coalesce("evidence_ids", F.array().cast("array<string>")).alias("evidence_ids"),
    )
    quoted = entries.filter(F.col("evidence_quote") != "").select(
        "case_id", "policy_id", "field_code", "evidence_quote", F.explode(F.array_distinct("evidence_ids")).alias("evidence_id")
    )
    hit = (
        quoted.join(evidence.select("policy_id", "evidence_id", "quoted_text"), ["policy_id", "evidence_id"])
        .groupBy("case_id", "policy_id", "field_code")
        .agg(F.bool_or(F.contains("quoted_text", strip(F.col("evidence_quote")))).alias("__hit"))
    )
    no_quote = F.coalesce("evidence_quote", F.lit("")) == ""
    ok = F.when(F.col("extracted_status").isNotNull(), no_quote | F.coalesce("__hit", F.lit(False)))
    return entries.join(hit, ["case_id", "policy_id", "field_code"], "left").withColumn("evidence_ok", ok).drop(
        "__hit", "evidence_quote"
    )


def totals(entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """O116: counts of the five results and of entries with correct evidence."""
    counts = {
        "correct": "correto", "divergent": "divergente", "absent": "ausente",
        "inconclusive": "inconclusivo", "not_evaluated": "nao_avaliado",
    }
    grouped = entries.groupBy(*keys) if keys else entries.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total_cases"),
        *[F.count_if(F.col("result") == value).alias(name) for name, value in counts.items()],
        F.count_if(F.coalesce("evidence_ok", F.lit(False))).alias("evidence_correct"),
    )


def run_id(expected: DataFrame) -> DataFrame:
    """O117: deterministic id of a reference set of any size and order.

    Each expected row gives a SHA-256; four 64-bit words of it are summed as
    decimals, which combines in any order without collecting the set, and the
    sums with the row count are hashed again.
    """
    row = F.sha2(
        F.to_json(F.struct("case_id", "policy_id", "field_code", "status", "expected_value", "evidence_quote")), 256
    )
    words = [
        F.sum(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)
    ]
    digest = expected.agg(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *words).alias("__digest"))
    return digest.select(F.concat(F.lit("eval_"), F.substring(F.sha2("__digest", 256), 1, 12)).alias("run_id"))
