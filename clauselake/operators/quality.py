"""Quality issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import SEVERITIES

CRITICAL, HIGH, MEDIUM, LOW = SEVERITIES
COUNT_COLUMNS = {CRITICAL: "critico", HIGH: "alto", MEDIUM: "medio", LOW: "baixo"}


def severity_rank(severity: Column) -> Column:
    """1 for the worst severity."""
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int")


def fact_issues(facts: DataFrame) -> DataFrame:
    """Issues of facts: one per rule violation, else one by status or flag. Narrow."""

    def issue(severity: str, reason: Column) -> Column:
        return F.struct(F.lit(severity).alias("severity"), reason.alias("reason"))

    by_rule = F.transform(
        "rule_violations",
        lambda v: issue(HIGH, F.concat(F.lit("regra de campo violada: "), v["rule"], F.lit(": "), v["reason"])),
    )
    single = (
        F.when(F.col("status") == "NEEDS_REVIEW", issue(MEDIUM, F.lit("valor ilegível/incerto (NEEDS_REVIEW)")))
        .when(F.col("status") == "AMBIGUOUS", issue(MEDIUM, F.lit("trechos conflitantes (AMBIGUOUS)")))
        .when(
            F.col("requires_human_review"),
            issue(LOW, F.lit("sinalizado pelo LLM para revisão (sem violação de regra)")),
        )
    )
    issues = F.when(F.size(F.coalesce("rule_violations", F.array())) > 0, by_rule).otherwise(
        F.array_compact(F.array(single))
    )
    return facts.select("policy_id", "field_code", "evidence_ids", F.inline(issues))


def failure_signals(rejects: DataFrame, requests: DataFrame) -> DataFrame:
    """A failed extraction is one critical issue per requested field, with the code only."""
    return requests.join(rejects.select("policy_id", "error_code"), "policy_id").select(
        "policy_id",
        "field_code",
        F.array().cast("array<string>").alias("evidence_ids"),
        F.lit(CRITICAL).alias("severity"),
        F.col("error_code").alias("reason"),
    )


def derive_issues(facts: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """All issues with their severity rank."""
    issues = fact_issues(facts)
    if failures is not None:
        issues = issues.unionByName(failures)
    return issues.withColumn("severity_rank", severity_rank(F.col("severity")))


def with_first_evidence(issues: DataFrame, evidence: DataFrame) -> DataFrame:
    """The first cited evidence that exists, per (policy, field)."""
    cited = issues.select("policy_id", "field_code", F.posexplode("evidence_ids").alias("position", "evidence_id"))
    found = (
        cited.distinct()
        .join(evidence.select("policy_id", "evidence_id").distinct(), ["policy_id", "evidence_id"])
        .groupBy("policy_id", "field_code")
        .agg(F.min_by("evidence_id", "position").alias("first_evidence_id"))
    )
    return issues.join(found, ["policy_id", "field_code"], "left")


def issue_counts(issues: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Issues per severity (0 included) for each document."""
    return issues.groupBy(*(keys or ["policy_id"])).agg(
        *[F.count_if(F.col("severity") == severity).alias(name) for severity, name in COUNT_COLUMNS.items()]
    )


def comparison_issue_counts(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """Counts of both sides of a comparison; the counts are joined, not the issues.

    Both sides meet the counts in one join, so the issues are derived once. The
    row number keeps equal pairs apart.
    """
    numbered = pairs.withColumn("__row", F.monotonically_increasing_id())
    sides = numbered.select("*", F.explode(F.array("policy_id_a", "policy_id_b")).alias("policy_id"))
    return (
        sides.join(issue_counts(issues), "policy_id", "left")
        .groupBy("__row", *pairs.columns)
        .agg(*[F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in COUNT_COLUMNS.values()])
        .drop("__row")
    )


def comparison_issues(pairs: DataFrame, issues: DataFrame) -> DataFrame:
    """The issues of both sides of each comparison."""
    sides = pairs.select(
        *pairs.columns, F.posexplode(F.array("policy_id_a", "policy_id_b")).alias("side", "policy_id")
    )
    return sides.join(issues, "policy_id")


def severity_groups(facts: DataFrame, issues: DataFrame) -> DataFrame:
    """Facts of the queue with the worst severity of their field; without an issue it is the lowest."""
    worst = issues.groupBy("policy_id", "field_code").agg(F.min("severity_rank").alias("__worst"))
    lowest = F.lit(len(SEVERITIES))
    return (
        facts.join(worst, ["policy_id", "field_code"], "left")
        .withColumn("severity_rank", F.coalesce("__worst", lowest))
        .withColumn("severity", F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), F.col("severity_rank")))
        .drop("__worst")
    )
