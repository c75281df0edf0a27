"""Human review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauselake.catalog import REVIEW_DECISIONS, field_attribute
from clauselake.functions.values import is_object, normalize_once, parse_value, raw_from_text, scalar_text
from clauselake.operators.facts import field_rules
from clauselake.plans.once import compute_once, let


def pending_queue(facts: DataFrame) -> DataFrame:
    """Facts that wait for a reviewer. Sort the output with ``orderBy("field_code")`` when showing it."""
    return facts.filter(F.col("revisao_status") == "PENDENTE")


def decision_history(facts: DataFrame) -> DataFrame:
    """Facts with a recorded human decision."""
    return facts.filter(F.col("revisao_decisao").isNotNull())


def _checked_decisions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions with their coerced value and the reason for rejecting them, if any."""
    target = facts.select(
        "fact_id", F.col("field_code").alias("__code"), F.struct("value.currency", "value.unit").alias("__original")
    ).withColumn("__known", F.lit(True))
    joined = decisions.join(target, "fact_id", "left")
    field_type = field_attribute(F.col("__code"), "field_type")
    given = F.col("value_json").isNotNull() & (F.trim("value_json") != "null")
    corrected = F.col("decision") == "CORRIGIDO"
    # A typed value takes currency and unit from the fact as the decisions before it left it. Typed corrections keep
    # both, so only accepted objects change them, and whether an object is accepted does not depend on its order.
    joined = compute_once(joined, __own=F.when(corrected & is_object(F.col("value_json")), parse_value(field_type, F.col("value_json"))))
    joined = normalize_once(joined, "__sound", field_type, F.col("__own"), F.col("__own").isNotNull())
    accepted = F.col("__sound").isNotNull() & (F.size(field_rules(F.col("__code"), field_type, F.col("__sound"))) == 0)
    joined = compute_once(joined, __sets=F.when(accepted, F.struct("__own.currency", "__own.unit"))).drop("__sound")
    before = Window.partitionBy("fact_id").orderBy("decided_at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    current = F.coalesce(F.last("__sets", ignorenulls=True).over(before), F.col("__original"))  # a fact's few human decisions
    joined = joined.withColumn("__current", current)
    typed = raw_from_text(field_type, scalar_text(F.col("value_json")), F.col("__current"))
    value = F.when(is_object(F.col("value_json")), F.col("__own")).otherwise(typed)
    joined = compute_once(joined, __value=F.when(corrected & given, value))
    joined = normalize_once(joined, "__normalized", field_type, F.col("__value"), F.col("__value").isNotNull())
    rules = field_rules(F.col("__code"), field_type, F.col("__normalized"))
    reason = (
        F.when(~F.coalesce(F.col("decision").isin(*REVIEW_DECISIONS), F.lit(False)), F.lit("INVALID_DECISION"))
        .when(F.col("__known").isNull(), F.lit("UNKNOWN_FACT"))
        .when(corrected & ~given, F.lit("VALUE_REQUIRED"))
        .when(corrected & F.col("__normalized").isNull(), F.lit("NORMALIZATION_ERROR"))
        .when(corrected & (F.size(rules) > 0), F.lit("RULE_VIOLATION"))
    )
    rule_names = F.array_join(F.transform(rules, lambda violation: violation["rule"]), ", ")
    checked = compute_once(joined, reason=reason, __rule_names=rule_names)
    return checked.withColumn("rules", F.when(F.col("reason") == "RULE_VIOLATION", F.col("__rule_names"))).drop(
        "__rule_names", "__own", "__sets", "__current"
    )


def _merged(checked: DataFrame) -> DataFrame:
    """The accepted decisions of a fact: the last one, the last correction, and whether one resolved it."""
    order = F.struct("decided_at", "seq")
    given = F.when(F.try_parse_json("value_json").isNotNull(), F.col("value_json"))
    shown = F.when(F.col("decision") == "CORRIGIDO", F.to_json("__value")).when(F.col("decision") == "CONFIRMADO", given)
    head = F.to_json(F.struct(F.col("decision").alias("decisao"), F.when(F.col("note") != "", F.col("note")).alias("nota")))
    payload = F.concat(F.lit('{"value":'), F.coalesce(shown, F.lit("null")), F.lit(","), F.substr(head, F.lit(2)))
    last = F.struct("decision", "decided_by", "decided_at", payload.alias("payload"))
    correction = F.struct(F.col("__value").alias("value"), F.col("__normalized").alias("normalized_value"))
    corrected = F.col("decision") == "CORRIGIDO"
    return (
        checked.filter(F.col("reason").isNull())
        .groupBy("fact_id")
        .agg(
            F.max_by(last, order).alias("__last"),
            F.max_by(F.when(corrected, correction), F.when(corrected, order)).alias("__correction"),
            F.bool_or(F.col("decision") != "DIVERGENTE").alias("__resolved"),
        )
    )


def recorded_decisions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """The review state of each fact that ``decisions`` decide; ``facts(fact_id, field_code, value)`` are read once."""
    return _merged(_checked_decisions(facts, decisions)).select(
        "fact_id",
        F.col("__last.decision").alias("revisao_status"),
        F.col("__last.payload").alias("revisao_decisao"),
        F.col("__last.decided_by").alias("revisao_por"),
        F.col("__last.decided_at").cast("string").alias("revisao_em"),
    )


def apply_decisions(facts: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts after review, rejected decisions).

    ``decisions(fact_id, decision, decided_by, value_json, note, decided_at,
    seq)``. Typed values take currency and unit from the fact as the
    valid decisions before them left it. Valid ones apply in (decided_at, seq) order: a correction sets the value, a confirmation or
    correction makes the fact FOUND and clears the flag, a divergence raises the
    flag and leaves status and value. The decisions of a fact are reduced by
    partial aggregates, so a fact with very many decisions is no hot task.
    """
    checked = _checked_decisions(facts, decisions)
    rejects = checked.filter(F.col("reason").isNotNull()).select(
        "fact_id", "decision", "decided_by", "seq", "reason", "rules"
    )
    merged = _merged(checked)
    decided = F.col("__last").isNotNull()
    has_correction = F.col("__correction").isNotNull()

    def pick(condition: Column, new: Column, old: str) -> Column:
        return F.when(condition, new).otherwise(F.col(old)).alias(old)

    replaced = {
        "status": pick(F.coalesce("__resolved", F.lit(False)), F.lit("FOUND"), "status"),
        "value": pick(has_correction, F.col("__correction.value"), "value"),
        "normalized_value": pick(has_correction, F.col("__correction.normalized_value"), "normalized_value"),
        "rule_violations": pick(has_correction, F.array().cast(dict(facts.dtypes)["rule_violations"]), "rule_violations")
        if "rule_violations" in facts.columns
        else None,
        "requires_human_review": pick(decided, F.col("__last.decision") == "DIVERGENTE", "requires_human_review"),
        "revisao_status": pick(decided, F.col("__last.decision"), "revisao_status"),
        "revisao_decisao": pick(decided, F.col("__last.payload"), "revisao_decisao"),
        "revisao_por": pick(decided, F.col("__last.decided_by"), "revisao_por"),
        "revisao_em": pick(decided, F.col("__last.decided_at").cast("string"), "revisao_em"),
    }
    reviewed = facts.join(merged, "fact_id", "left").select(
        *[replaced[name] if replaced.get(name) is not None else F.col(name) for name in facts.columns]
    )
    return reviewed, rejects


# fixed values: error names reported for skipped corrections
SKIP_REASONS = {
    "VALUE_REQUIRED": "ValueError",
    "INVALID_DECISION": "ValueError",
    "NORMALIZATION_ERROR": "NormalizationError",
    "RULE_VIOLATION": "ContractValidationError",
    "UNKNOWN_FACT": "UNKNOWN_FACT",
}


def _proposed(corrections: DataFrame, decided_by: str, note: Column) -> DataFrame:
    """Corrections as decisions. An unknown decision word means CORRIGIDO with a value and DIVERGENTE without."""
    word = F.upper(F.coalesce("decision", F.lit("")))
    has_value = F.col("value_json").isNotNull() & (F.trim("value_json") != "null")
    decision = F.when(word.isin(*REVIEW_DECISIONS), word).otherwise(
        F.when(has_value, F.lit("CORRIGIDO")).otherwise(F.lit("DIVERGENTE"))
    )
    return corrections.select(
        "fact_id", decision.alias("decision"), F.lit(decided_by).alias("decided_by"), "value_json",
        note.alias("note"), "decided_at", "seq",
    )


def feedback_outcomes(facts: DataFrame, corrections: DataFrame, decided_by: str, note: Column) -> DataFrame:
    """Each proposed correction with its decision, or the reason for skipping it.

    Facts and corrections are read once; of ``facts`` only fact_id, field_code
    and value are used.
    """
    checked = _checked_decisions(facts, _proposed(corrections, decided_by, note))
    reason = None
    for key, name in SKIP_REASONS.items():
        reason = (F if reason is None else reason).when(F.col("reason") == key, F.lit(name))
    return checked.select(
        "fact_id", F.col("__code").alias("field_code"), "seq",
        F.when(F.col("reason").isNull(), F.col("decision")).alias("decision"), reason.alias("reason"),
    )


def bulk_feedback(
    facts: DataFrame, corrections: DataFrame, decided_by: str, note: Column
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts after review, applied, skipped) for a list of proposed corrections.

    ``corrections(fact_id, decision, value_json, decided_at, seq)``.
    """
    reviewed, _ = apply_decisions(facts, _proposed(corrections, decided_by, note))
    outcomes = feedback_outcomes(facts, corrections, decided_by, note)
    applied = outcomes.filter(F.col("reason").isNull()).select("fact_id", "field_code", "decision", "seq")
    skipped = outcomes.filter(F.col("reason").isNotNull()).select("fact_id", "seq", "reason")
    return reviewed, applied, skipped
