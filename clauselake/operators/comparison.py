"""Comparison of policy pairs, field by field (O41, O42, O72-O79, O85, O125)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import FIELD_CODES, field_attribute
from clauselake.functions.ids import comparison_id
from clauselake.functions.text import is_blank
from clauselake.functions.values import to_brl
from clauselake.plans.once import compute_once

PENDING = ["AMBIGUOUS", "NEEDS_REVIEW"]


def with_brl(facts: DataFrame, fx_rates: DataFrame | None = None) -> DataFrame:
    """Add ``amount_brl`` and ``fx_error`` to facts; a missing or non-positive rate is an error code.

    Valid currencies are three letters, so the rate side has at most 26 cubed
    rows whatever is passed in, and is broadcast: a shuffle on the few
    currencies would put most facts into one task.
    """
    currency = F.col("normalized_value.currency")
    if fx_rates is None:
        priced = facts.withColumn("__rate", F.lit(None).cast("decimal(18,8)"))
    else:
        code = F.upper("currency")
        rates = fx_rates.filter(code.rlike("^[A-Z]{3}$")).groupBy(code.alias("__currency")).agg(
            F.max(F.col("rate").cast("decimal(18,8)")).alias("__rate")
        )
        priced = facts.withColumn("__currency", currency).join(F.broadcast(rates), "__currency", "left").drop("__currency")
    brl = to_brl(F.col("normalized_value.amount"), currency, F.col("__rate"))
    return (
        compute_once(priced, amount_brl=brl)
        .withColumn("fx_error", currency.isNotNull() & F.col("amount_brl").isNull())
        .drop("__rate")
    )


def _order(a: Column, b: Column) -> Column:
    return F.when(a > b, F.lit("MAIOR")).when(a < b, F.lit("MENOR")).when(a == b, F.lit("IGUAL"))


def typed_compare(field_type: Column, a: Column, b: Column) -> Column:
    """Result for two fact structs with values; null when a key is missing."""
    va, vb = a["normalized_value"], b["normalized_value"]
    same_period = (va["start"] == vb["start"]) & (va["end"] == vb["end"])
    period = (
        F.when(same_period, F.lit("IGUAL"))
        .when(va["duration_days"] != vb["duration_days"], _order(va["duration_days"], vb["duration_days"]))
        .when(va["duration_days"] == vb["duration_days"], F.lit("DIVERGENTE"))
    )
    text = F.when(va["text"] == vb["text"], F.lit("IGUAL")).when(va["text"] != vb["text"], F.lit("DIVERGENTE"))
    return (
        F.when(field_type == "money", _order(a["amount_brl"], b["amount_brl"]))
        .when(field_type == "number", _order(va["number"], vb["number"]))
        .when(field_type == "date", _order(va["date"], vb["date"]))
        .when(field_type == "period", period)
        .otherwise(text)
    )


def field_result(field_type: Column, a: Column, b: Column) -> Column:
    """Waiting for review, then absence, then the typed comparison."""

    def pending(fact: Column) -> Column:
        return F.coalesce(fact["requires_human_review"] | fact["status"].isin(*PENDING), F.lit(False))

    def absent(fact: Column) -> Column:
        return F.coalesce(fact["status"] == "NOT_FOUND", F.lit(True))

    return (
        F.when(pending(a) | pending(b), F.lit("AGUARDANDO_REVISAO"))
        .when(absent(a) & absent(b), F.lit("AUSENTES_AMBOS"))
        .when(absent(a), F.lit("AUSENTE_A"))
        .when(absent(b), F.lit("AUSENTE_B"))
        .otherwise(typed_compare(field_type, a, b))
    )


def direction(result: Column) -> Column:
    """O75."""
    return (
        F.when(result == "MAIOR", F.lit("A"))
        .when(result == "MENOR", F.lit("B"))
        .when(result == "IGUAL", F.lit("igual"))
        .otherwise(F.lit("n/a"))
    )


def compare_policies(
    pairs: DataFrame,
    facts: DataFrame,
    fx_rates: DataFrame | None = None,
    previous: DataFrame | None = None,
    strict: bool = False,
    id_prefix: str = "comparison:",
) -> DataFrame:
    """Full grid of catalog fields for every ordered pair ``(policy_id_a, policy_id_b)``.

    ``facts`` holds one row per policy and field. The facts of a policy (at most
    ten) travel as one map, so each side is joined once on the policy and a pair
    stays one row until both sides have met. ``previous`` keeps earlier
    explanations. Values that cannot be compared give a null result with an
    ``error_code``; ``strict`` raises instead.
    """
    fact = F.struct(
        "status", "normalized_value", "evidence_ids", "requires_human_review", "amount_brl", "fx_error"
    )
    by_policy = (
        with_brl(facts, fx_rates)
        .repartition("policy_id")  # serves the aggregate, and both sides reuse this one shuffle
        .groupBy("policy_id")
        .agg(F.map_from_entries(F.collect_list(F.struct("field_code", fact))).alias("facts"))
    )
    wide = (
        pairs.select("policy_id_a", "policy_id_b")
        .distinct()
        .join(by_policy.select(F.col("policy_id").alias("policy_id_a"), F.col("facts").alias("facts_a")), "policy_id_a", "left")
        .join(by_policy.select(F.col("policy_id").alias("policy_id_b"), F.col("facts").alias("facts_b")), "policy_id_b", "left")
        .withColumn("comparison_id", comparison_id(F.col("policy_id_a"), F.col("policy_id_b"), id_prefix))
    )
    codes = F.array(*[F.lit(code) for code in FIELD_CODES])
    grid = wide.select("*", F.posexplode(codes).alias("position", "field_code")).select(
        "comparison_id",
        "policy_id_a",
        "policy_id_b",
        (F.col("position") + 1).alias("ordinal"),
        "field_code",
        field_attribute(F.col("field_code"), "field_type").alias("field_type"),
        F.try_element_at("facts_a", F.col("field_code")).alias("a"),
        F.try_element_at("facts_b", F.col("field_code")).alias("b"),
    )
    result = compute_once(grid, resultado=field_result(F.col("field_type"), F.col("a"), F.col("b")))
    fx_error = F.coalesce(F.col("a.fx_error"), F.lit(False)) | F.coalesce(F.col("b.fx_error"), F.lit(False))
    error = F.when(
        F.col("resultado").isNull(),
        F.when(fx_error, F.lit("FX_RATE_MISSING")).otherwise(F.lit("NORMALIZATION_ERROR")),
    )
    if strict:
        failed = F.raise_error(F.concat(F.lit("cannot compare "), F.col("field_code")))
        result = result.withColumn("resultado", F.coalesce(F.col("resultado"), failed.cast("string")))
    no_ids = F.array().cast("array<string>")
    compared = result.select(
        "comparison_id",
        "policy_id_a",
        "policy_id_b",
        "ordinal",
        "field_code",
        "field_type",
        "resultado",
        F.col("a.normalized_value").alias("valor_a"),
        F.col("b.normalized_value").alias("valor_b"),
        F.when(F.col("resultado").isNotNull(), direction(F.col("resultado"))).alias("direcao"),
        F.coalesce("a.evidence_ids", no_ids).alias("evidencias_a"),
        F.coalesce("b.evidence_ids", no_ids).alias("evidencias_b"),
        error.alias("error_code"),
    )
    if previous is None:
        return compared.withColumn("explicacao", F.lit(None).cast("string"))
    kept = previous.select("comparison_id", "field_code", "explicacao")
    return compared.join(kept, ["comparison_id", "field_code"], "left")


def read_comparison(comparisons: DataFrame, comparison: str | Column) -> DataFrame:
    """One comparison in alphabetical field order; over a grid the id reaches the pairs before their facts are joined."""
    return comparisons.filter(F.col("comparison_id") == comparison).orderBy("field_code")


def differences(comparisons: DataFrame) -> DataFrame:
    """O125: fields that differ, wait for review, or have no result because of an error."""
    return comparisons.filter(~F.coalesce("resultado", F.lit("")).isin("IGUAL", "AUSENTES_AMBOS"))


def citation_is_valid(text: Column, ids: Column, a: Column, b: Column) -> Column:
    """An explanation cites only known evidence, and both sides when both have any."""
    cited = F.coalesce(ids, F.array().cast("array<string>"))
    known = F.size(F.array_except(cited, F.array_union(a, b))) == 0
    return (
        ~is_blank(text)
        & (F.size(cited) > 0)
        & known
        & ((F.size(a) == 0) | F.arrays_overlap(cited, a))
        & ((F.size(b) == 0) | F.arrays_overlap(cited, b))
    )


def fallback_text(comparison: DataFrame) -> Column:
    """Fixed explanation from the result, the direction and the evidence of both sides."""
    ids = F.array_distinct(F.concat("evidencias_a", "evidencias_b"))
    listed = F.when(F.size(ids) > 0, F.array_join(ids, ", ")).otherwise(F.lit("nenhuma"))
    return F.concat(
        F.lit("Comparação de "), F.col("field_code"), F.lit(": "), F.col("resultado"), F.lit(". "),
        F.when(F.coalesce("direcao", F.lit("")) != "", F.concat(F.lit("Direção: "), F.col("direcao"), F.lit(". "))).otherwise(
            F.lit("")
        ),
        F.lit("Evidências citadas: "), listed, F.lit("."),
    )


def explain(comparisons: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Comparisons with explanations written back, and rejects.

    ``answers(comparison_id, field_code, text, evidence_ids, failed)``: a failed
    call takes the fixed text, a valid citation is accepted, an invalid one is a
    reject and leaves the row as it was. Answers for rows that do not exist are
    rejects too.
    """
    answer = F.struct("text", F.col("evidence_ids").alias("ids"), "failed").alias("__answer")
    joined = comparisons.join(
        answers.select("comparison_id", "field_code", answer), ["comparison_id", "field_code"], "left"
    )
    failed = F.coalesce(F.col("__answer.failed"), F.lit(False))
    valid = citation_is_valid(
        F.col("__answer.text"), F.col("__answer.ids"), F.col("evidencias_a"), F.col("evidencias_b")
    )
    answered = F.col("__answer").isNotNull()
    written = joined.withColumn(
        "explicacao",
        F.when(answered & failed, fallback_text(joined))
        .when(answered & valid, F.col("__answer.text"))
        .otherwise(F.col("explicacao")),
    ).drop("__answer")
    return written, _explanation_rejects(comparisons, answers)


def _explanation_rejects(comparisons: DataFrame, answers: DataFrame) -> DataFrame:
    """Answers that are not accepted. The fields of a comparison, at most ten, travel as one list, so the grid is read once."""
    held = F.collect_list(F.struct("field_code", F.col("evidencias_a").alias("a"), F.col("evidencias_b").alias("b")))
    known = comparisons.groupBy("comparison_id").agg(held.alias("__fields"))
    met = answers.join(known, "comparison_id", "left")
    fields = F.filter("__fields", lambda field: field["field_code"] == F.col("field_code"))
    cited = F.exists(fields, lambda field: citation_is_valid(F.col("text"), F.col("evidence_ids"), field["a"], field["b"]))
    reason = (
        F.when(F.col("__fields").isNull(), F.lit("COMPARISON_NOT_FOUND"))
        .when(F.size(fields) == 0, F.lit("COMPARISON_FIELD_NOT_FOUND"))
        .when(~F.coalesce("failed", F.lit(False)) & ~F.coalesce(cited, F.lit(False)), F.lit("EXPLANATION_NOT_CITED"))
    )
    return met.select("comparison_id", "field_code", reason.alias("error_code")).filter(F.col("error_code").isNotNull())


def pairs_touching(pairs: DataFrame, policies: DataFrame) -> DataFrame:
    """Pairs with at least one changed policy, to be compared again."""
    touched = policies.select("policy_id").distinct().withColumn("__touched", F.lit(True))
    return (
        pairs.join(touched.select(F.col("policy_id").alias("policy_id_a"), F.col("__touched").alias("__a")), "policy_id_a", "left")
        .join(touched.select(F.col("policy_id").alias("policy_id_b"), F.col("__touched").alias("__b")), "policy_id_b", "left")
        .filter(F.col("__a") | F.col("__b"))
        .select("policy_id_a", "policy_id_b")
    )


def recompare(
    stored: DataFrame, pairs: DataFrame, changed: DataFrame, facts: DataFrame, fx_rates: DataFrame | None = None,
    id_prefix: str = "comparison:",
) -> tuple[DataFrame, DataFrame]:
    """Rows computed anew for the pairs that ``changed`` policies touch, and all rows after the change.

    Only touched pairs and the facts of their policies are compared; a pair that
    changed on both sides is compared once. Earlier explanations stay, in the
    new rows too. The new rows alone are what a keyed store has to take in; the
    merged rows equal a comparison of all pairs.
    """
    touched = pairs_touching(pairs, changed).distinct()
    members = touched.select(F.explode(F.array("policy_id_a", "policy_id_b")).alias("policy_id")).distinct()
    ids = touched.select(comparison_id(F.col("policy_id_a"), F.col("policy_id_b"), id_prefix).alias("comparison_id"))
    earlier = stored.join(ids, "comparison_id", "left_semi")
    fresh = compare_policies(touched, facts.join(members, "policy_id", "left_semi"), fx_rates, earlier, id_prefix=id_prefix)
    fresh = fresh.select(*stored.columns)
    return fresh, stored.join(ids, "comparison_id", "left_anti").unionByName(fresh)
