import json

from pyspark.sql import functions as F

from clauselake.operators import comparison, facts, quality, responses, review
from clauselake.sources import exports

C = F.col
RESPONSE = "policy_id string, position int, field_code string, status string, value string, confidence double, evidence_ids array<string>, requires_human_review boolean"
EVIDENCE = "policy_id string, evidence_id string, quoted_text string"

# two policies with ten facts each and the comparison they imply
BUNDLE = [
    ("limite_agregado", {"amount": "5.000.000,00", "currency": "BRL"}, {"amount": "3000000.00"}, "MAIOR", "A"),
    ("limite_por_sinistro", "R$ 1.000.000,00", {"amount": 1000000, "currency": "BRL"}, "IGUAL", "igual"),
    ("franquia", {"amount": 50000}, {"amount": "25.000,00"}, "MAIOR", "A"),
    ("vigencia", {"start": "2025-01-01", "end": "01/01/2026"}, "01/01/2025 até 01/01/2027", "MENOR", "B"),
    ("prazo_notificacao_sinistro", {"number": 60}, {"number": "30"}, "MAIOR", "A"),
    ("extensao_territorial", {"text": "Mundial"}, {"text": "Brasil"}, "DIVERGENTE", "n/a"),
    ("exclusoes_chave", {"text": "Fraude; atos"}, {"text": "Fraude;  ATOS"}, "IGUAL", "igual"),
    ("limite_defesa_custos", {"amount": "500000"}, None, "AUSENTE_B", "n/a"),
    ("retroatividade", {"date": "2015-01-01"}, {"date": "01-06-2018"}, "MENOR", "B"),
    ("indice_reajuste", "4% ou 5%", {"number": 4}, "AGUARDANDO_REVISAO", "n/a"),
]


def bundle(spark, change=None):
    rows = []
    for policy, column in (("A", 1), ("B", 2)):
        for i, row in enumerate(BUNDLE):
            value = row[column]
            if value is None:
                continue
            status = "AMBIGUOUS" if policy == "A" and row[0] == "indice_reajuste" else "FOUND"
            rows.append([policy, i, row[0], status, json.dumps(value), 0.9, [f"e{policy}{i}"], status == "AMBIGUOUS"])
    for row in rows:
        if change:
            change(row)
    evidence = [(p, f"e{p}{i}", f"texto {p}{i} citado") for p in "AB" for i in range(10)]
    policies = spark.createDataFrame([("A",), ("B",)], "policy_id string")
    return facts.request_grid(policies), spark.createDataFrame(rows, RESPONSE), spark.createDataFrame(evidence, EVIDENCE)


def by_key(df):
    return {(r["policy_id"], r["field_code"]): r for r in df.collect()}


def test_bundle_compares_as_documented(spark):
    built, rejects = facts.build_facts(*bundle(spark))
    assert rejects.count() == 0
    pairs = spark.createDataFrame([("A", "B")], "policy_id_a string, policy_id_b string")
    got = comparison.compare_policies(pairs, built).orderBy("ordinal").collect()
    assert [(r["field_code"], r["resultado"], r["direcao"]) for r in got] == [(r[0], r[3], r[4]) for r in BUNDLE]
    assert got[7]["evidencias_b"] == [] and got[0]["evidencias_a"] == ["eA0"]
    markdown = exports.comparison_markdown(comparison.compare_policies(pairs, built)).first()["markdown"]
    assert "- **Valor B:** ausente" in markdown and "(`indice_reajuste`)" in markdown and markdown.count("pendente") == 10
    again = comparison.compare_policies(pairs, built, previous=comparison.compare_policies(pairs, built).withColumn("explicacao", F.lit("x")))
    assert {r["explicacao"] for r in again.collect()} == {"x"}


def test_unknown_evidence_rejects_the_whole_policy(spark):
    def change(row):
        if row[0] == "A" and row[1] == 2:
            row[6] = ["eA2", "eB2"]

    built, rejects = facts.build_facts(*bundle(spark, change))
    assert [tuple(r) for r in rejects.collect()] == [("A", "franquia", "EVIDENCE_UNKNOWN")]
    assert {r["policy_id"] for r in built.collect()} == {"B"}


def test_contract_errors_and_missing_answers(spark):
    def change(row):
        if row[0] == "A" and row[1] == 0:
            row[5] = 1.5
        if row[0] == "B" and row[1] == 4:
            row[6] = []

    built, rejects = facts.build_facts(*bundle(spark, change))
    assert {tuple(r) for r in rejects.collect()} == {
        ("A", "limite_agregado", "LLM_SCHEMA_INVALID"), ("B", "prazo_notificacao_sinistro", "LLM_SCHEMA_INVALID"),
    }
    ok, _ = facts.build_facts(*bundle(spark))
    assert by_key(ok)["B", "limite_defesa_custos"]["status"] == "NOT_FOUND"


def test_invented_quotes_and_broken_rules_are_demoted(spark):
    def change(row):
        if row[:2] == ["A", 0]:
            row[4] = json.dumps({"amount": 1, "raw_text": " A0 citado ", "trecho": "inventado"})
        if row[:2] == ["A", 6]:
            row[4] = json.dumps({"text": "diz “texto A6” e 'nada'"})
        if row[:2] == ["B", 0]:
            row[4] = json.dumps({"amount": 0})
        if row[:2] == ["B", 2]:
            row[4] = json.dumps({"amount": 0})
        if row[:2] == ["B", 5]:
            row[4] = json.dumps({"text": "Marte"})
        if row[:2] == ["B", 8]:
            row[4] = json.dumps("sem data")

    built = by_key(facts.build_facts(*bundle(spark, change))[0])
    assert built["A", "limite_agregado"]["anchor_violations"] == 1 and built["A", "limite_agregado"]["status"] == "NEEDS_REVIEW"
    assert built["A", "exclusoes_chave"]["anchor_violations"] == 1
    assert [v["rule"] for v in built["B", "limite_agregado"]["rule_violations"]] == ["valor_positivo"]
    assert built["B", "franquia"]["status"] == "FOUND"
    assert [v["rule"] for v in built["B", "extensao_territorial"]["rule_violations"]] == ["enum_base_territorial"]
    date = built["B", "retroatividade"]
    assert date["status"] == "NEEDS_REVIEW" and date["requires_human_review"] and date["normalized_value"] is None


def test_mixed_currencies_demote_all_money_facts(spark):
    def change(row):
        if row[:2] == ["A", 0]:
            row[4] = json.dumps({"amount": 1, "currency": "USD"})

    built = by_key(facts.build_facts(*bundle(spark, change))[0])
    for code in ("limite_agregado", "limite_por_sinistro", "franquia", "limite_defesa_custos"):
        assert built["A", code]["status"] == "NEEDS_REVIEW"
        assert built["A", code]["rule_violations"][-1]["rule"] == "moeda_consistente"
    assert built["B", "franquia"]["status"] == "FOUND"


def test_missing_rate_is_an_error_code_and_strict_raises(spark):
    import pytest

    def change(row):
        if row[2] in ("limite_agregado", "limite_por_sinistro", "franquia", "limite_defesa_custos"):
            row[4] = json.dumps({"amount": 10 if row[0] == "A" else 9, "currency": "EUR"})

    built, _ = facts.build_facts(*bundle(spark, change))
    pairs = spark.createDataFrame([("A", "B")], "policy_id_a string, policy_id_b string")
    rates = spark.createDataFrame([("eur", "6")], "currency string, rate string")
    without = {r["field_code"]: r for r in comparison.compare_policies(pairs, built).collect()}
    assert without["franquia"]["error_code"] == "FX_RATE_MISSING" and without["franquia"]["resultado"] is None
    with_rate = {r["field_code"]: r for r in comparison.compare_policies(pairs, built, rates).collect()}
    assert with_rate["franquia"]["resultado"] == "MAIOR"
    with pytest.raises(Exception, match="cannot compare"):
        comparison.compare_policies(pairs, built, strict=True).collect()


def test_explanations(spark):
    built, _ = facts.build_facts(*bundle(spark))
    pairs = spark.createDataFrame([("A", "B")], "policy_id_a string, policy_id_b string")
    compared = comparison.compare_policies(pairs, built)
    cid = compared.first()["comparison_id"]
    rows = [
        (cid, "franquia", "cita os dois", ["eA2", "eB2"], False), (cid, "vigencia", "um lado", ["eA3"], False),
        (cid, "limite_agregado", None, None, True), (cid, "limite_defesa_custos", "só A", ["eA7"], False), (cid, "nada", "x", ["eA0"], False), ("zz", "franquia", "x", ["eA0"], False),
    ]
    answers = spark.createDataFrame(rows, "comparison_id string, field_code string, text string, evidence_ids array<string>, failed boolean")
    written, rejects = comparison.explain(compared, answers)
    text = {r["field_code"]: r["explicacao"] for r in written.collect()}
    assert text["franquia"] == "cita os dois" and text["vigencia"] is None and text["limite_defesa_custos"] == "só A"
    assert text["limite_agregado"] == "Comparação de limite_agregado: MAIOR. Direção: A. Evidências citadas: eA0, eB0."
    assert {(r["field_code"], r["error_code"]) for r in rejects.collect()} == {
        ("vigencia", "EXPLANATION_NOT_CITED"), ("nada", "COMPARISON_FIELD_NOT_FOUND"), ("franquia", "COMPARISON_NOT_FOUND"),
    }


def test_review_decisions_merge_in_order(spark):
    built, _ = facts.build_facts(*bundle(spark))
    stored = facts.with_review_state(built, F.lit("r"))
    rows = [
        ("FAC-A-franquia", "CORRIGIDO", "ana", '"R$ 7,5"', "n", 1), ("FAC-A-franquia", "DIVERGENTE", "bia", None, None, 2),
        ("FAC-A-indice_reajuste", "CONFIRMADO", "ana", None, None, 3), ("FAC-B-vigencia", "CORRIGIDO", "ana", '"01/01/2025"', None, 4),
        ("FAC-B-franquia", "CORRIGIDO", "ana", '"-1"', None, 5), ("FAC-B-retroatividade", "CORRIGIDO", "ana", None, None, 6),
        ("FAC-X-franquia", "CONFIRMADO", "ana", None, None, 7), ("FAC-B-franquia", "TALVEZ", "ana", None, None, 8),
    ]
    decisions = spark.createDataFrame(rows, "fact_id string, decision string, decided_by string, value_json string, note string, seq int").withColumn("decided_at", F.lit("2026-01-01"))
    after, rejects = review.apply_decisions(stored, decisions)
    got = {r["fact_id"]: r for r in after.collect()}
    fact = got["FAC-A-franquia"]
    assert str(fact["normalized_value"]["amount"]) == "7.50" and fact["status"] == "FOUND" and fact["requires_human_review"]
    assert fact["revisao_status"] == "DIVERGENTE" and fact["revisao_por"] == "bia"
    assert got["FAC-A-indice_reajuste"]["status"] == "FOUND" and got["FAC-A-indice_reajuste"]["normalized_value"] is None
    assert {(r["seq"], r["reason"]) for r in rejects.collect()} == {
        (4, "NORMALIZATION_ERROR"), (5, "RULE_VIOLATION"), (6, "VALUE_REQUIRED"), (7, "UNKNOWN_FACT"), (8, "INVALID_DECISION"),
    }
    assert [r["fact_id"] for r in review.pending_queue(stored).collect()] == ["FAC-A-indice_reajuste"]
    assert review.decision_history(after).count() == 2
    pairs = spark.createDataFrame([("A", "B"), ("C", "D")], "policy_id_a string, policy_id_b string")
    assert comparison.pairs_touching(pairs, after.filter("policy_id = 'B'")).count() == 1
    # a confirmed fact without a value cannot be compared
    result = {r["field_code"]: r for r in comparison.compare_policies(pairs, after).collect() if r["policy_id_a"] == "A"}
    assert result["indice_reajuste"]["error_code"] == "NORMALIZATION_ERROR" and result["franquia"]["resultado"] == "AGUARDANDO_REVISAO"


def test_corrections_build_on_each_other(spark):
    built, _ = facts.build_facts(*bundle(spark))
    rows = [
        ("CORRIGIDO", '{"amount": "5", "currency": "USD"}', " ", 1), ("CORRIGIDO", '"7"', "", 2), ("CORRIGIDO", '{"amount": "x", "currency": "EUR"}', None, 3),
    ]
    decisions = spark.createDataFrame(
        [("FAC-A-franquia", d, "ana", v, n, "2026-01-01", i) for d, v, n, i in rows],
        "fact_id string, decision string, decided_by string, value_json string, note string, decided_at string, seq int",
    )
    stored = facts.with_review_state(built, F.lit("r"))
    for upto, amount, note in ((1, "5", " "), (3, "7", None)):
        after, rejects = review.apply_decisions(stored, decisions.filter(F.col("seq") <= upto))
        fact = after.filter("fact_id = 'FAC-A-franquia'").first()
        assert (fact["value"]["amount"], fact["value"]["currency"], fact["normalized_value"]["currency"]) == (amount, "USD", "USD")
        payload = json.loads(fact["revisao_decisao"])
        assert payload["decisao"] == "CORRIGIDO" and payload["value"] == {"amount": amount, "currency": "USD"} and payload.get("nota") == note
    assert [r["seq"] for r in rejects.collect()] == [3]


def test_bulk_feedback_defaults(spark):
    built, _ = facts.build_facts(*bundle(spark))
    rows = [("FAC-A-franquia", "corrigir", "2000000.00", 1), ("FAC-B-franquia", None, None, 2), ("zz", "CONFIRMADO", None, 3), ("FAC-B-vigencia", "CORRIGIDO", '"x"', 4)]
    fixes = spark.createDataFrame(rows, "fact_id string, decision string, value_json string, seq int").withColumn("decided_at", F.lit("t"))
    _, applied, skipped = review.bulk_feedback(facts.with_review_state(built, F.lit("r")), fixes, "agente", F.lit("nota"))
    assert {(r["fact_id"], r["decision"]) for r in applied.collect()} == {("FAC-A-franquia", "CORRIGIDO"), ("FAC-B-franquia", "DIVERGENTE")}
    assert {(r["fact_id"], r["reason"]) for r in skipped.collect()} == {("zz", "UNKNOWN_FACT"), ("FAC-B-vigencia", "NormalizationError")}


def test_issues_and_counts(spark):
    def change(row):
        if row[:2] == ["B", 0]:
            row[4] = json.dumps({"amount": 0, "currency": "XXX"})
        if row[:2] == ["A", 2]:
            row[7] = True

    built, _ = facts.build_facts(*bundle(spark, change))
    issues = quality.derive_issues(built)
    got = sorted((r["policy_id"], r["field_code"], r["severity"]) for r in issues.collect())
    assert got == [("A", "franquia", "BAIXO"), ("A", "indice_reajuste", "MÉDIO"), ("B", "limite_agregado", "ALTO"), ("B", "limite_agregado", "ALTO")]
    counts = {r["policy_id"]: tuple(r)[1:] for r in quality.issue_counts(issues).collect()}
    assert counts == {"A": (0, 0, 1, 1), "B": (0, 2, 0, 0)}
    pairs = spark.createDataFrame([("A", "B")], "policy_id_a string, policy_id_b string")
    assert tuple(quality.comparison_issue_counts(pairs, issues).first())[2:] == (0, 2, 1, 1)
    groups = {r["fact_id"]: r["severity"] for r in quality.severity_groups(built, issues).collect()}
    assert groups["FAC-B-limite_agregado"] == "ALTO" and groups["FAC-B-franquia"] == "BAIXO"
    failed = quality.failure_signals(spark.createDataFrame([("Z", "X")], "policy_id string, error_code string"), facts.request_grid(spark.createDataFrame([("Z",)], "policy_id string")))
    assert failed.count() == 10


def test_responses_and_findings(spark):
    rows = [("a", '{"facts": [{"field_code": "franquia", "value": {"amount": 1}}]}'), ("b", '[{"field_code": "x"}]'), ("c", "[1]"), ("d", "não"), ("e", '{"x": 1}'), ("f", "[]]")]
    items, rejects = responses.parse_facts(spark.createDataFrame(rows, "policy_id string, payload string"))
    assert {(r["policy_id"], r["field_code"], r["value"]) for r in items.collect()} == {("a", "franquia", '{"amount":1}'), ("b", "x", None)}
    assert {r["policy_id"] for r in rejects.collect()} == {"c", "d", "e", "f"}
    found = [(" null ", "v", None, ["e1"]), ("A", "v", "n/a", ["e1", "e1"]), ("B", None, None, ["e1"]), ("C", "v", "d", ["zz"]), ("D", "v", "d", ["e2"])]
    answers = spark.createDataFrame([("p", found)], f"policy_id string, findings array<{facts.FINDING}>")
    known = spark.createDataFrame([("p", ["e1", "e2"])], "policy_id string, evidence_ids array<string>")
    got = facts.scan_findings(facts.extra_findings(answers, known), "p").collect()
    assert [(r["finding_id"], r["label"], r["detail"], r["evidence_ids"]) for r in got] == [("EXF-p-000", "A", None, ["e1"]), ("EXF-p-001", "D", "d", ["e2"])]


def test_a_passage_that_holds_quotes_is_one_excerpt(spark):
    def change(row):
        if row[0] == "A" and row[2] == "exclusoes_chave":
            row[4] = json.dumps({"text": 'diz “fora "do texto" fora” e "nada" mais'})
        if row[0] == "B" and row[2] == "exclusoes_chave":
            row[4] = json.dumps({"text": 'diz "texto “B6” citado"'})

    built = by_key(facts.build_facts(*bundle(spark, change))[0])
    assert built["A", "exclusoes_chave"]["anchor_violations"] == 2  # the passage and the word behind it
    assert built["B", "exclusoes_chave"]["anchor_violations"] == 0
