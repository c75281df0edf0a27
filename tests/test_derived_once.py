"""Queries over facts derive them once."""

from __future__ import annotations

from pyspark.sql import functions as F

from clauselake.functions import text, values
from clauselake.operators import facts, quality, review


def leaves(df):
    return df._jdf.queryExecution().optimizedPlan().collectLeaves().size()


def test_comparison_counts_derive_the_issues_once(spark):
    issues = spark.createDataFrame([("1", "CRITICO"), ("1", "BAIXO"), ("2", "BAIXO"), (None, "BAIXO")], "policy_id string, severity string")
    issues = issues.withColumn("severity", F.when(F.col("severity") == "CRITICO", quality.CRITICAL).otherwise(quality.LOW))
    pairs = spark.createDataFrame([("1", "2"), ("1", "2"), ("2", "2"), ("3", None), ("2", "1")], "policy_id_a string, policy_id_b string")
    counted = quality.comparison_issue_counts(pairs, issues)
    got = sorted(tuple(map(str, row)) for row in counted.collect())
    zero = ("0", "0")
    assert got == [("1", "2", "1", *zero, "2"), ("1", "2", "1", *zero, "2"), ("2", "1", "1", *zero, "2"), ("2", "2", "0", *zero, "2"), ("3", "None", "0", *zero, "0")]
    assert counted.columns == ["policy_id_a", "policy_id_b", *quality.COUNT_COLUMNS.values()]
    assert leaves(counted) == 2


def test_rejects_read_ids_and_equal_those_of_whole_facts(spark):
    codes = ["limite_agregado", "prazo_notificacao_sinistro", "exclusoes_chave"]
    requests = facts.request_grid(spark.createDataFrame([(str(i),) for i in range(7)], "policy_id string"), codes)
    rows = [
        ("0", 0, codes[0], "FOUND", '"x"', 0.5, ["e0"]), ("0", 1, codes[1], "FOUND", "5", 1.5, ["e0"]),
        ("1", 0, codes[0], "FOUND", "5", 0.5, ["e0", None]), ("1", 1, codes[1], "ODD", "5", 0.5, ["e0", "gone"]),
        ("2", 0, codes[2], "FOUND", '{"text":"diz “nada”"}', 0.5, ["e0"]), ("2", 1, codes[1], "FOUND", "-5", 0.5, ["e0"]),
        ("3", 0, codes[2], "NOT_FOUND", None, 0.5, []), ("4", 0, codes[2], "FOUND", "1", 0.5, []),
        ("5", 0, codes[1], "FOUND", "1", 0.5, ["e1"]), ("6", 0, codes[1], None, "1", 2.0, None),
    ]
    schema = "policy_id string, position int, field_code string, status string, value string, confidence double, evidence_ids array<string>"
    responses = spark.createDataFrame(rows, schema).withColumn("requires_human_review", F.lit(False))
    evidence = spark.createDataFrame(
        [(str(i), e, None if e == "e1" else "texto") for i in range(7) for e in ("e0", "e1")], "policy_id string, evidence_id string, quoted_text string"
    )
    built, rejects = facts.build_facts(requests, responses, evidence)
    whole = facts._guarded(requests, responses, evidence).filter("batch_error is not null").select("policy_id", "batch_error.field_code", "batch_error.error_code").distinct()
    assert sorted(map(tuple, rejects.collect())) == sorted(map(tuple, whole.collect()))
    assert rejects.count() == 5 and built.select("policy_id").distinct().count() == 2
    plan = rejects._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "contains" not in plan.lower()


def test_parsing_without_lambdas_gives_the_same_values(spark):
    given = ["{\"currency\" : null, \"amount\":\"1\"}", "{\"x\":{\"currency\":null},\"currency\":\"USD\"}", "{\"currency\":\"EUR\"}", "{bad", "{}", None]
    df = spark.createDataFrame([(g,) for g in given], "json string").repartition(1)
    read = df.select(values.parse_value(F.lit("money"), F.col("json")).alias("v")).select("v.currency", "v.amount").collect()
    assert [tuple(row) for row in read] == [("NONE", "1"), ("NONE", None), ("EUR", None), (None, None), (None, None), (None, None)]
    words = ["  América  do Sul ", "plain", "ﬁm ½", "한국 É", "", None]
    folded = spark.createDataFrame([(w,) for w in words], "w string").repartition(1).select(text.fold(F.col("w")).alias("a"), text.fold_exact(F.col("w")).alias("b"))
    assert folded.filter(~F.col("a").eqNullSafe(F.col("b"))).count() == 0


def reviewed_facts(spark):
    rows = [("F1", "limite_agregado", "money", '{"amount":"10","currency":"USD"}'), ("F2", "prazo_notificacao_sinistro", "number", "5"),
            ("F3", "exclusoes_chave", "text", '"x"')]
    built = spark.createDataFrame(rows, "fact_id string, field_code string, field_type string, value_json string").repartition(1)
    built = built.withColumn("value", values.parse_value(F.col("field_type"), F.col("value_json")))
    built = values.normalize_once(built, "normalized_value", F.col("field_type"), F.col("value"), F.lit(True)).drop("value_json")
    built = built.withColumn("status", F.lit("FOUND")).withColumn("requires_human_review", F.lit(False))
    built = built.withColumn("rule_violations", F.array().cast(facts.VIOLATIONS))
    decided = [("F1", "corrigido", '"R$ 7,50"', 1), ("F1", "x", '"-3"', 2), ("F2", "CONFIRMADO", None, 3), ("F2", "y", None, 4),
               ("F3", "CORRIGIDO", None, 5), ("F9", "CONFIRMADO", None, 6), (None, "CONFIRMADO", None, 7), ("F3", "z", "null", 8)]
    given = spark.createDataFrame(decided, "fact_id string, decision string, value_json string, seq long")
    given = given.withColumn("decided_at", F.timestamp_seconds("seq")).withColumn("note", F.lit("n")).withColumn("decided_by", F.lit("r"))
    return facts.with_review_state(built, F.lit("r")), given


def test_feedback_reads_facts_and_corrections_once(spark):
    stored, given = reviewed_facts(spark)
    outcomes = review.feedback_outcomes(stored, given, "agente", F.lit("n"))
    got = {row["seq"]: (row["decision"], row["reason"]) for row in outcomes.collect()}
    assert got == {1: ("CORRIGIDO", None), 2: (None, "ContractValidationError"), 3: ("CONFIRMADO", None), 4: ("DIVERGENTE", None),
                   5: (None, "ValueError"), 6: (None, "UNKNOWN_FACT"), 7: (None, "UNKNOWN_FACT"), 8: ("DIVERGENTE", None)}
    assert leaves(outcomes) == 2


def test_recorded_decisions_are_those_of_the_reviewed_facts(spark):
    stored, given = reviewed_facts(spark)
    given = given.withColumn("decision", F.upper("decision"))
    recorded = review.recorded_decisions(stored.select("fact_id", "field_code", "value"), given)
    reviewed, _ = review.apply_decisions(stored, given)
    shown = ["fact_id", "revisao_status", "revisao_decisao", "revisao_por", "revisao_em"]
    expected = sorted(map(tuple, review.decision_history(reviewed).select(*shown).collect()))
    assert sorted(map(tuple, recorded.select(*shown).collect())) == expected and len(expected) == 2
    assert leaves(recorded) == 2
