"""Weighted ranking and sensitivity (O106-O109, O127)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import CRITERION_CODES, GUARD_FACTS, RANKING_CRITERIA
from clauselake.plans.broadcasting import checked_broadcast
from clauselake.plans.ranking import integer_levels, rank_by_levels


def normalize_weights(weights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O106: weights scaled to a sum of 100 per scenario; scenarios with a sum of zero or less are rejects."""
    sums = weights.groupBy("scenario").agg(F.sum("weight").alias("__sum"))
    joined = weights.join(sums, "scenario")
    scaled = joined.filter(F.col("__sum") > 0).withColumn("weight", F.col("weight") * 100.0 / F.col("__sum")).drop("__sum")
    rejects = sums.filter(~(F.col("__sum") > 0)).select("scenario", F.lit("WEIGHT_SUM_NOT_POSITIVE").alias("error_code"))
    return scaled, rejects


def _bounds(weights: DataFrame) -> DataFrame:
    return weights.groupBy("scenario").agg(
        F.sum("weight").alias("__sum"), F.count(F.lit(1)).alias("__criteria"), F.max("scenario_ordinal").alias("scenario_ordinal")
    )


def ranking_rejects(notes: DataFrame, weights: DataFrame, group: list[str]) -> DataFrame:
    """O107: reasons why a policy or a scenario cannot be ranked."""
    scenarios = _bounds(weights)
    bad_sum = scenarios.filter(F.abs(F.col("__sum") - 100.0) > 0.01).select(
        "scenario", F.lit(None).cast("string").alias("policy_id"), F.lit("WEIGHT_SUM_NOT_100").alias("error_code")
    )
    scored = _scored(notes, weights, group)
    missing = scored.filter(F.col("__found") < F.col("__criteria")).select(
        "scenario", "policy_id", F.lit("CRITERION_WITHOUT_NOTE").alias("error_code")
    )
    outside = scored.filter(F.col("__outside") > 0).select(
        "scenario", "policy_id", F.lit("NOTE_OUT_OF_RANGE").alias("error_code")
    )
    return bad_sum.unionByName(missing).unionByName(outside)


def _scored(notes: DataFrame, weights: DataFrame, group: list[str]) -> DataFrame:
    """Partial sums per policy and scenario. The weights are a few rows per scenario."""
    contribution = F.round(F.col("nota") * F.col("weight") / 10.0, 9).cast("decimal(20,9)")
    return (
        notes.join(checked_broadcast(weights.select("scenario", "criterion", "weight")), "criterion")
        .groupBy("scenario", *group, "policy_id")
        .agg(
            F.min("input_pos").alias("input_pos"),
            F.sum(contribution).alias("__total"),
            F.count("nota").alias("__found"),
            F.count_if(~F.coalesce(F.col("nota").between(0.0, 10.0), F.lit(True))).alias("__outside"),
        )
        .join(checked_broadcast(_bounds(weights)), "scenario")
    )


def contributions(notes: DataFrame, weights: DataFrame) -> DataFrame:
    """O107: note times weight over ten, per criterion."""
    return notes.join(checked_broadcast(weights), "criterion").withColumn("contribution", F.col("nota") * F.col("weight") / 10.0)


def labelled_contributions(notes: DataFrame, weights: DataFrame) -> DataFrame:
    """O107: contributions with the label of their criterion, for the report."""
    label = None
    for code, _, text in RANKING_CRITERIA:
        label = (F if label is None else label).when(F.col("criterion") == code, F.lit(text))
    return contributions(notes, weights).withColumn("label", label)


def compute_ranking(notes: DataFrame, weights: DataFrame, group: list[str] | None = None) -> DataFrame:
    """O107: total and rank per scenario and group; equal totals keep their input order.

    ``notes(group.., policy_id, input_pos, criterion, nota)``. Policies with a
    missing or invalid note and scenarios whose weights do not sum to 100 are
    left out here and listed by ``ranking_rejects``. Totals are exact decimals,
    so ties do not depend on the order of addition.
    """
    group = group or []
    valid = _scored(notes, weights, group).filter(
        (F.col("__found") == F.col("__criteria"))
        & (F.col("__outside") == 0)
        & (F.abs(F.col("__sum") - 100.0) <= 0.01)
    )
    totals = valid.select(
        "scenario", "scenario_ordinal", *group, "policy_id", "input_pos", F.round("__total", 6).cast("decimal(20,6)").alias("total")
    )
    # Totals lie between 0 and 10 with six digits: a thousand coarse ranges of at most ten thousand totals each.
    levels = [-F.floor(F.col("total") * 100), -F.col("total"), *integer_levels(F.col("input_pos"))]
    return rank_by_levels(
        totals, ["scenario", "scenario_ordinal", *group], levels, [F.asc("input_pos"), F.asc("policy_id")], "rank"
    )


def compute_sensitivity(notes: DataFrame, scenarios: DataFrame, group: list[str] | None = None) -> DataFrame:
    """O108: the ranking under each scenario's normalised weights, keyed by scenario order."""
    scaled, _ = normalize_weights(scenarios)
    return compute_ranking(notes, scaled, group)


def no_winner_guard(available: DataFrame, keys: list[str]) -> DataFrame:
    """O109: whether a ranking is informative only, and which facts are missing.

    ``available`` has a boolean column per required fact (null = not there) and
    ``profile_complete``.
    """
    missing = []
    for code, label in GUARD_FACTS:
        absent = ~F.coalesce(F.col(code), F.lit(False))
        if code == "perfil_do_contratante":
            absent = absent | ~F.coalesce("profile_complete", F.lit(False))
        missing.append(F.when(absent, F.lit(label)))
    listed = F.array_join(F.array_compact(F.array(*missing)), ", ")
    reason = F.concat(
        F.lit("Sem vencedora geral: o ranking é informativo porque faltam dados de "),
        listed,
        F.lit(" (§9 — não há conclusão financeira sem dados financeiros)."),
    )
    return available.select(
        *keys, (listed != "").alias("informative_only"), F.when(listed != "", reason).alias("reason")
    )


def wide_notes(notes: DataFrame, weights: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """O127: one row per policy with the eight notes side by side and the total.

    Policies are rows and the eight fixed criteria are columns, so the width
    never depends on the data.
    """
    joined = contributions(notes, weights)
    cells = [F.max(F.when(F.col("criterion") == code, F.col("nota"))).alias(code) for code in CRITERION_CODES]
    total = F.sum(F.round("contribution", 9).cast("decimal(20,9)"))
    return joined.groupBy("scenario", *(keys or []), "policy_id").agg(
        *cells, F.round(total, 6).cast("decimal(20,6)").alias("total")
    )


def criterion_table(notes: DataFrame, weights: DataFrame, policy_ids: list[str]) -> DataFrame:
    """O127: criterion rows with weight and one column per listed policy of one report."""
    labels = {row[0]: row[2] for row in RANKING_CRITERIA}
    label = None
    for code, text in labels.items():
        label = (F if label is None else label).when(F.col("criterion") == code, F.lit(text))
    return (
        notes.join(checked_broadcast(weights), "criterion")
        .groupBy("scenario", "ordinal", "criterion", "weight")
        .pivot("policy_id", policy_ids)
        .agg(F.max("nota"))
        .withColumn("label", label)
    )
